"""Session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .config import get_config


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.hadoop.fs.s3a.endpoint.region", get_config().store.region)
    if master:
        builder = builder.master(master)
    return builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()
