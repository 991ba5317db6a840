"""Tables as variables: cells, chunks, fill values, flips and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.layout import Tiling, element, unravel


def from_rows(df: DataFrame, index: str, value: str | Column) -> DataFrame:
    """A one-dimensional variable over a dense key."""
    return df.select(F.col(index).cast("long").alias("d0"), (F.col(value) if isinstance(value, str) else value).alias("value"))


def from_arrays(df: DataFrame, index: str, array: str) -> DataFrame:
    """A two-dimensional variable: a row per key, a column per array position."""
    return df.select(F.col(index).cast("long").alias("d0"), F.posexplode(array).alias("d1", "value")).withColumn("d1", F.col("d1").cast("long"))


def reshape(df: DataFrame, elem: str, value: str | Column, shape: list[int]) -> DataFrame:
    """Cells of the given shape from a dense element number."""
    return df.select(*unravel(elem, shape), (F.col(value) if isinstance(value, str) else value).alias("value"))


def to_chunks(cells: DataFrame, tiling: Tiling) -> DataFrame:
    """One row per tile: t0.., cells in row-major order as data, their count."""
    tiles = [f"t{k}" for k in range(len(tiling.shape))]
    packed = F.sort_array(F.collect_list(F.struct(element(list(tiling.shape)).alias("elem"), "value")))
    return cells.select("*", *tiling.tile_cols()).groupBy(*tiles).agg(F.transform(packed, lambda x: x["value"]).alias("data"))


def fill_missing(grid: DataFrame, cells: DataFrame, keys: list[str], fill: object, value: str = "value") -> DataFrame:
    """Every grid cell, with the stored value or the fill value."""
    return grid.join(cells, keys, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def flip2d(cells: DataFrame, shape: list[int]) -> DataFrame:
    """The transpose: indices swapped, element numbers of the flipped shape."""
    rest = [c for c in cells.columns if c not in ("d0", "d1", "elem")]
    out = cells.select(F.col("d1").alias("d0"), F.col("d0").alias("d1"), *rest)
    return out.withColumn("elem", element([shape[1], shape[0]]))


def compare(a: DataFrame, b: DataFrame, keys: list[str], how: str = "full") -> DataFrame:
    """a's and b's values side by side; a cell that only one has is null in the other, or left out by an inner join."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), keys, how)


def count_diff(a: DataFrame, b: DataFrame, keys: list[str], by: tuple[str, ...] = (), how: str = "full") -> DataFrame:
    """n_diff: cells that differ, in all or for each `by`."""
    return compare(a, b, keys, how).groupBy(*by).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_diff"))


def arrays_equal(a: DataFrame, b: DataFrame, keys: list[str], by: tuple[str, ...] = (), how: str = "full") -> DataFrame:
    """equal: whether no cell differs, in all or for each `by`."""
    return compare(a, b, keys, how).groupBy(*by).agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("equal"))


def near_equal(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Relative difference below eps; absolute where both numbers are smaller than eps."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top < eps, F.abs(a - b) < eps).otherwise(F.abs(a - b) / F.when(top == 0, 1.0).otherwise(top) < eps)


def finite_sum(value: Column) -> Column:
    v = value.cast("double")
    return F.sum(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v))
