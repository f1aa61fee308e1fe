"""A session with the settings that the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "sequora", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew joins and coalescing; other settings are the caller's."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=conf | settings).getOrCreate()
