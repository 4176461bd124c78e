"""Spark session with the engine's defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "terrabag", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow transfer; conf overrides or adds settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
