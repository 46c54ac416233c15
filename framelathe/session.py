"""The session: taken if there is one, made if not, never stopped here."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(name: str = "framelathe", master: str | None = None, **conf: str) -> SparkSession:
    have = SparkSession.getActiveSession()
    if have is not None:
        return have
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map={**DEFAULTS, **conf}).getOrCreate()
