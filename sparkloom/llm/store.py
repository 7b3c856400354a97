"""Shared scratch storage and row keys used by the operators.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, the
folder that every node of a cluster can reach, and read back.  That cuts the
lineage: an executor that is lost later costs the reread of a file, never a
recomputation of everything before it, and a value that was read once cannot
change when a task is retried.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCRATCH: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where Spark is local and none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all nodes of the cluster share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call uses.

    All paths of one application lie in one folder, deleted when the driver's
    Python ends; a result that reads one of them is valid until then.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_root(spark)}/sparkloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may already be gone at exit
        return


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        _remove(spark, path)


#: Rows of an Arrow batch where Spark's default would be used: that is made for numbers, and long texts fill hundreds of MB.
BATCH_ROWS = 1000
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and nothing reads any more."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            remove(t.sparkSession, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and return the table.

    While it is written, texts go to Python in batches of ``BATCH_ROWS`` rows
    unless the session asks for another size than the default, and what was
    shuffled is deleted as soon as the table is there, not when the driver next
    collects garbage; the session's settings are the same afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    was, kept = spark.conf.get(_BATCH), spark.conf.get(_CLEANUP, None)
    if was == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if kept is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was == _DEFAULT:
            spark.conf.set(_BATCH, was)
        if kept is not None:
            spark.conf.set(_CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """Queries that are made and run herein delete what they shuffled as soon as they end, results that come to the driver too."""
    # Asked for with a default, a setting that the session leaves alone seems not to exist.
    kept = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.get(_CLEANUP)
        there = True
    except Exception:  # Spark has no such setting
        there = False
    if there:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if there and kept is None:
            spark.conf.unset(_CLEANUP)
        elif there:
            spark.conf.set(_CLEANUP, kept)


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with whole numbers as ``key``, and the table ``number, name`` of what they stand for.

    Whole numbers stay as they are.  Keys of other types are numbered in their
    order, so the smallest number is the smallest key; null stays null.
    """
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        return df, None
    names = df.select(F.col(f"`{key}`").alias("name")).where(F.col("name").isNotNull()).distinct().orderBy("name")
    # Sorted partitions are numbered in order, so the ids rise with the names.
    names = materialize(names.select(F.monotonically_increasing_id().alias("number"), "name"), "names")
    rows = df.withColumnRenamed(key, "__name").join(names.withColumnRenamed("name", "__other"), F.col("__name") == F.col("__other"), "left")
    return rows.select(*[F.col("number").alias(key) if c == key else F.col(f"`{c}`") for c in df.columns]), names


def named(df: DataFrame, names: DataFrame | None, key: str, kind: T.DataType) -> DataFrame:
    """``df`` with the keys again that ``numbered`` replaced."""
    if names is None:
        return df.withColumn(key, F.col(key).cast(kind))
    back = names.select(F.col("number").alias("__number"), F.col("name").alias("__name"))
    out = df.join(back, F.col(key) == F.col("__number"), "left")
    return out.select(*[F.col("__name").alias(c) if c == key else F.col(c) for c in df.columns])


def small(df: DataFrame, rows: int, size: int = 64 << 20) -> bool:
    """Whether ``df`` was counted to have at most ``rows`` rows and ``size`` bytes, written out as text."""
    some = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    got = some.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return got["n"] <= rows and got["b"] <= size


def crc_bucket(key: str, modulus: int):
    """crc32 of the key's decimal text, modulo ``modulus``; -1 for a null key, which is in no bucket."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def left_out(df: DataFrame, keys: DataFrame, on: list[str], broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys``, a narrow table.

    ``keys`` is measured first: what is ``small`` is sent to every executor,
    more is joined by a shuffle.
    """
    sent = F.broadcast(keys) if small(keys, broadcast_rows) else keys.hint("merge")
    return df.join(sent, on, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
