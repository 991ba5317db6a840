"""Connected components by alternating large-star and small-star steps, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialize, release

FEW_EDGES = 200_000


def _both(a: tuple[str, str], b: tuple[str, str], names: tuple[str, str]) -> Column:
    """Two rows from one."""
    return F.inline(F.array(*[F.struct(F.col(x).alias(names[0]), F.col(y).alias(names[1])) for x, y in (a, b)]))


def _large_star(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = e.select(_both(("u", "v"), ("v", "u"), ("u", "v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them. Edges have u > v."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(low, "u").select(_both(("v", "m"), ("u", "m"), ("u", "v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge between different nodes.

    No step collects nodes or edges; each round is written to the shared folder, and two numbers tell if it changed.
    Where they prove that there are at most FEW_EDGES edges, a round is one task without shuffles."""
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    old = mark(e)
    for _ in range(max_rounds):
        if not old[0]:
            break
        new = materialize(_small_star(_large_star(e.coalesce(1) if old[0] <= FEW_EDGES else e)), "edges")
        release(e)
        e, seen, old = new, old, mark(new)
        if seen == old:
            break
    else:
        raise RuntimeError("components did not settle")
    out = e.select(_both(("u", "v"), ("v", "v"), ("node", "component"))).distinct()
    out._tessella_path = e._tessella_path
    return out
