"""Sessions and their settings."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class EngineConfig:
    """What a session is made from.

    ``partitions`` is the number of shuffle partitions that adaptive execution
    starts from; it merges small ones and splits skewed ones.
    """

    partitions: int | None = None
    master: str | None = None
    app_name: str = "sparkloom"
    settings: dict[str, str] = field(default_factory=dict)

    def spark_settings(self) -> dict[str, str]:
        base = {
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.coalescePartitions.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.session.timeZone": "UTC",
        }
        if self.partitions is not None:
            base["spark.sql.shuffle.partitions"] = str(self.partitions)
        return base | self.settings


def read_settings(path: str) -> dict[str, str]:
    """``key=value`` lines; blank lines and ``#`` comments are skipped, others are warned of."""
    found: dict[str, str] = {}
    with open(path) as f:
        for number, line in enumerate(f, 1):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            key, sign, value = line.partition("=")
            if not sign or not key.strip():
                warnings.warn(f"{path}:{number}: not key=value: {line!r}", stacklevel=2)
                continue
            found[key.strip()] = value.strip()
    return found


def build_session(config: EngineConfig | None = None) -> SparkSession:
    config = config or EngineConfig()
    builder = SparkSession.builder.appName(config.app_name)
    if config.master:
        builder = builder.master(config.master)
    return builder.config(map=config.spark_settings()).getOrCreate()
