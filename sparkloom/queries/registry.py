"""Pairs of a Spark query and its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import TABLES, parquet_table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return parquet_table(self._spark, f"{self._path}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def frame(self, oracle: str, name: str | None = None):
        """A function of the tables that builds the query with the DataFrame API."""

        def add(build: Callable[[Tables], DataFrame]):
            key = name or build.__name__
            self.queries[key] = lambda spark, path: build(Tables(spark, path))
            self.oracles[key] = oracle
            return build

        return add

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query whose text is the same for both engines, unless ``oracle`` says otherwise."""

        def run(spark: SparkSession, path: str) -> DataFrame:
            used = {t: parquet_table(spark, f"{path}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
            return spark.sql(text, **used)

        self.queries[name] = run
        self.oracles[name] = oracle or text.format(**{t: t for t in TABLES})
