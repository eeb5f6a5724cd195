"""A session with the settings the plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "lodestone", **settings: str) -> SparkSession:
    """Get or make a session; shuffle partitions stay with the cluster's own setting and AQE."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
