"""The session that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "wattline", **conf: str) -> SparkSession:
    """A session in UTC, with ANSI semantics and adaptive execution. ``conf``: further settings, ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
