"""Orders with explicit places for nulls, and the first k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key(spec: str) -> Column:
    """``name``, ``name desc``; nulls come last either way."""
    name, _, direction = spec.partition(" ")
    return F.col(name).desc_nulls_last() if direction.strip().lower() == "desc" else F.col(name).asc_nulls_last()


def sort_nulls_last(df: DataFrame, *keys: str) -> DataFrame:
    """A total order: range partitions, each sorted (and spilled) on its own."""
    return df.orderBy(*[_key(k) for k in keys])


def sorted_distinct(df: DataFrame, *keys: str) -> DataFrame:
    """The merge that drops repeats: distinct rows in order."""
    return df.select(*[k.partition(" ")[0] for k in keys]).distinct().orderBy(*[_key(k) for k in keys])


def top_k(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first k: each task keeps k rows, no full sort."""
    return sort_nulls_last(df, *keys).limit(k)
