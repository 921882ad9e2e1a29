"""A session with the settings that change-history answers rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, so that naive times mean the same everywhere; ANSI errors rather than silent nulls; adaptive plans."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return (builder.master(master) if master else builder).getOrCreate()
