"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "orgweave", **conf: str) -> SparkSession:
    """ANSI arithmetic, adaptive execution with skew handling, UTC; further settings as keyword a__b for a.b."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
