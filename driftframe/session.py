"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "driftframe", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; whatever else is set stays."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
