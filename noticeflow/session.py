"""Session settings that the survey plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "noticeflow", **settings: str) -> SparkSession:
    """A session with adaptive execution and a fixed zone; cluster settings come from the submit command or ``settings``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
