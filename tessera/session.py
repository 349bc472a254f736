"""Spark sessions with the settings that the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.timeType.enabled": "true",
}


def session(app: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; given settings come last. Without a master, the one that spark-submit gives holds."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **settings})
    return (builder.master(master) if master else builder).getOrCreate()


def active() -> SparkSession:
    found = SparkSession.getActiveSession()
    return found if found is not None else session()
