"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings for any size of cluster; partition counts stay with the deployment and AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()
