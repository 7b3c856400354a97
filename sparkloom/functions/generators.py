"""Synthetic columns and tables, made on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shifted(first: int = 0, name: str = "id") -> Column:
    """The row number of ``spark.range`` moved by ``first``."""
    return (F.col("id") + F.lit(first)).cast("int").alias(name)


def exponential(low: int, high: int, rows: int, base: float = 16.0, name: str = "id") -> Column:
    """Integers of [low, high) over ``rows`` rows, thinning out exponentially towards high."""
    x = F.col("id") / F.lit(float(rows))
    return (F.lit(low) + F.floor((F.pow(F.lit(base), x) - 1) / F.lit(base - 1) * F.lit(high - low))).cast("int").alias(name)


def alphanumeric(length: int = 32, seed: int = 42, name: str = "value") -> Column:
    """Letters and digits that follow from the row number."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    letters = [F.substring(F.lit(alphabet), F.pmod(F.xxhash64(F.lit(seed + i), "id"), F.lit(len(alphabet))).cast("int") + 1, F.lit(1)) for i in range(length)]
    return F.concat(*letters).alias(name)


def nullable(column: str, every: int = 10) -> Column:
    """The column with a null in each row whose hash is a multiple of ``every``."""
    return F.when(F.pmod(F.xxhash64(F.lit(7), column), F.lit(every)) != 0, F.col(column)).alias(column)


def base_table(spark: SparkSession, rows: int, keys: int = 4, value: str = "hello", partitions: int | None = None) -> DataFrame:
    """``id1..idk, value`` with ids moved by one from key to key."""
    ids = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return ids.select(*[shifted(k, f"id{k + 1}") for k in range(keys)], F.lit(value).alias("value"))


def small_table(spark: SparkSession, rows: int, first: int = 0, value: str | None = None, skewed: bool = False) -> DataFrame:
    """``id, value``: ids in a row or thinning out, a constant or random text."""
    key = exponential(first, first + rows, rows) if skewed else shifted(first)
    return spark.range(rows).select(key, F.lit(value).alias("value") if value is not None else alphanumeric())


def repeated_table(spark: SparkSession, ids: int, copies: int, value: str = "world") -> DataFrame:
    """Each id ``copies`` times."""
    return spark.range(ids * copies).select((F.col("id") % ids).cast("int").alias("id"), F.lit(value).alias("value"))
