"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "sparkloom", **more: str) -> SparkSession:
    """The running session or a new one; more: settings with _ for a dot."""
    builder = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items() | {k.replace("_", "."): v for k, v in more.items()}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
