"""A Spark session with the settings that the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow for Python stages; everything else is the cluster's or conf's."""
    builder = SparkSession.builder.appName("loomwork")
    if master:
        builder = builder.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
