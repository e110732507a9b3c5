"""Shared pieces of the training-data operators: staging, loading, distributed components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
_MMAP_THRESHOLD, _ARENA_MAX = -3, -8  # fixed values: names of mallopt's parameters


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else one in the warehouse; a temporary one of our own only where driver and executors are one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.millrace"
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _OWN_DIR[app]


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Every task commits through the shared file system, so a lost executor costs only
    the tasks that were running on it.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Free a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: unless the session has a setting of its own, Python workers get some thousand rows at a time."""
    if spark.conf.get(_BATCH) == "10000":  # Spark's default
        spark.conf.set(_BATCH, _BATCH_ROWS)


def _libc(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError):  # another C library: nothing to tune
        pass


def lean(f):
    """f for mapInArrow or applyInArrow, in a worker that gives memory back: large arrays are unmapped when freed, and the rest is trimmed when f ends."""

    def begin() -> None:
        _libc("mallopt", _MMAP_THRESHOLD, 1 << 20)
        _libc("mallopt", _ARENA_MAX, 1)

    def end() -> None:
        pa.default_memory_pool().release_unused()
        _libc("malloc_trim", 0)

    def of_batches(batches):
        begin()
        yield from f(batches)
        end()

    def of_table(table: pa.Table) -> pa.Table:
        begin()
        out = f(table)
        end()
        return out

    return of_table if f.__annotations__.get("table") else of_batches


def crc32_mod(column, m: int):
    """crc32 of a key's decimal text, modulo m (the fold rule of the labelled operators)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def connected_components(links: DataFrame) -> DataFrame:
    """Components of an undirected link table (a, b) as (id, component), component = least id.

    Alternating large-star and small-star steps, each a min-aggregate and a join, so no
    neighbour list is ever gathered in one row. Rounds go on until the links no longer change, which
    they do after about as many as the number of ids has binary digits, squared at worst. Ids without
    links do not appear. Links with a null end or a = b are ignored; repeated links count once.
    """

    def digest(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    edges = staged(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "cc",
    )
    before = digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        nxt = staged(small, "cc")
        drop_stage(edges)
        edges, now = nxt, digest(nxt)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
