"""Columns that pass through an operator: clashes with its outputs, and hiding under safe names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def passing(keep: tuple[str, ...], outputs: tuple[str, ...]) -> tuple[str, ...]:
    """The kept columns without those that have the name of an output: the output takes their place."""
    return tuple(c for c in keep if c not in outputs)


def hide(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under names that no operator uses, and which name each column has now."""
    names = {c: f"__k{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def show(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The hidden columns under their own names, nothing else."""
    return df.select(*[F.col(h).alias(c) for c, h in names.items()])
