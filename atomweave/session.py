"""The session the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "atomweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow on; conf overrides by underscored key."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=base | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
