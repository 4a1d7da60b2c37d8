"""Session settings for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lumenfield", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling, ANSI mode and the last side winning in map merges."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
