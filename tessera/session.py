"""Spark session defaults."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with ``DEFAULTS`` and ``conf``.

    Without ``master`` the cluster's own setting holds (``local[*]`` if there is none).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName("tessera")
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def warmup(device: str = "auto") -> float:
    """Run a tiny grouped sum so that the first real query finds a warm session; returns seconds."""
    began = time.perf_counter()
    spark = get_spark()
    spark.range(1024).selectExpr("id % 8 as g", "cast(id as double) as v").groupBy("g").sum("v").collect()
    return time.perf_counter() - began


def clear_cache() -> None:
    """Drop everything the session has cached."""
    get_spark().catalog.clearCache()
