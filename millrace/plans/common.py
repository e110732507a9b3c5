"""Loading of the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_SCHEMAS: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder; its schema is read from the files once a process."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)
