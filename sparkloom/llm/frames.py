"""DataFrame plumbing shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def annotate(df: DataFrame, fields: T.StructType, fn: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``df`` with the columns that ``fn`` gives for each Arrow batch.

    ``fn`` returns one array for each of ``fields``, in order.  A column of
    ``df`` that has the name of a new one (in any letter case) is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(fn(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields.fields]))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
