"""Results, timings and plans as files."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame

from ..plans import introspect


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str) -> DataFrame:
    """A catalog table bucketed and sorted by ``keys``: joins and groupings on them need no shuffle.

    Two tables join without an exchange where they have the same number of
    buckets; rows are brought together by bucket before writing, so there is
    one file for each bucket.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def write_plan(df: DataFrame, path: str, physical: bool = False) -> None:
    Path(path).write_text(introspect.physical_plan(df) if physical else introspect.logical_plan(df))


def write_json(results: object, path: str) -> None:
    Path(path).write_text(json.dumps(results, indent=2) + "\n")


def write_summary(rows: list[dict], path: str) -> None:
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else ["query"])
        out.writeheader()
        out.writerows(rows)
