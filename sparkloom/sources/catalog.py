"""Tables: folders of Parquet, rows in memory, and statistics."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    """A file or a folder of part files; columns and filters are pushed into the scan."""
    return spark.read.parquet(path)


def list_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the ``<name>.parquet`` entries of a folder, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def register_dir(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> list[str]:
    """Views named after the folder's tables."""
    found = list(names) if names is not None else list_tables(spark, path)
    for name in found:
        parquet_table(spark, f"{path}/{name}.parquet").createOrReplaceTempView(name)
    return found


def load_to_memory(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows dealt round-robin over ``partitions`` and kept; partitions beyond memory go to disk."""
    out = df.repartition(partitions) if partitions else df
    out = out.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def memory_table(spark: SparkSession, rows: Sequence, schema: str, partitions: int = 1, name: str | None = None) -> DataFrame:
    """Rows given by the caller as a table of ``partitions`` partitions."""
    df = spark.createDataFrame(rows, schema)
    df = df.repartition(partitions) if partitions > 1 else df.coalesce(1)
    if name:
        df.createOrReplaceTempView(name)
    return df


def table_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """``column, row_count, null_count, distinct_count``, one row a column.

    All columns are done in one scan.  ``exact`` counts distinct values exactly
    (an expansion of the rows by column); otherwise HyperLogLog estimates them.
    """
    if not exact:
        one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.lit(1)).cast("long").alias(f"x{i}") - F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)], *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(df.columns)])
        k = len(df.columns)
        names = one.columns
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"`{names[0]}`").alias("row_count"), F.col(f"`{names[1 + i]}`").alias("null_count"), F.col(f"`{names[1 + k + i]}`").alias("distinct_count")) for i, c in enumerate(df.columns)]
        return one.select(F.inline(F.array(*rows)))
    # Values go in by hash of their column, so equal texts of two columns stay apart.
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])))
    per = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    null = F.col("value").isNull()
    return per.groupBy("column").agg(
        F.sum("n").cast("long").alias("row_count"),
        F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).cast("long").alias("null_count"),
        F.count("value").alias("distinct_count"),
    )


def strip_namespace(sql: str, catalog: str, schema: str) -> str:
    """``catalog.schema.table`` to ``table``: views have no namespace of more parts."""
    return re.sub(rf"\b{re.escape(catalog)}\s*\.\s*{re.escape(schema)}\s*\.\s*", "", sql)
