"""Cutting the lineage: a table written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df, written as Parquet under spark.checkpoint.dir (else the warehouse; a temporary folder only where driver and executors are one process) and read back. Removed when the application ends."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    folder = folder or spark.conf.get("spark.sql.warehouse.dir") + "/.millrace"
    path = f"{folder.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
