"""Session settings that the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC, adaptive, Arrow-enabled session with ANSI casts off; keyword settings override (dots as double underscores)."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings |= {"spark.sql.shuffle.partitions": str(os.cpu_count() or 8), "spark.ui.enabled": "false"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
