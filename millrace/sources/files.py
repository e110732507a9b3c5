"""Readers and writers beside Spark's own: genomics text formats, WARC-like records, and one entry point by format name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the tab-separated genomics formats.
BED = "chrom string, start long, end long, name string, score double, strand string"
GFF = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
VCF = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string"
_TABLES = {"bed": BED, "gff": GFF, "vcf": VCF}
_NATIVE = ("parquet", "orc", "csv", "json", "text", "xml", "binaryFile")


def read(spark: SparkSession, path: str | Sequence[str], format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A file, folder, glob or list of them; partition columns in paths are kept."""
    if format == "jsonl":
        format = "json"
    if format in _NATIVE:
        r = spark.read.format(format).options(**{k: str(v) for k, v in options.items()})
        return (r.schema(schema) if schema else r).load(path)
    if format in _TABLES:
        return read_table(spark, path, _TABLES[format])
    if format == "fasta":
        return read_fasta(spark, path)
    if format == "fastq":
        return read_fastq(spark, path)
    raise ValueError(f"no reader for {format}")


def read_table(spark: SparkSession, path, schema: str) -> DataFrame:
    """Tab-separated lines; comment lines (#) and BED's track and browser lines go; missing last columns are null."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track\b|browser\b)") & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return lines.select(*(F.get(parts, i).try_cast(t).alias(n) for i, (n, t) in enumerate(fields)))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """id, description, sequence: records are cut at '>' by the text reader, so that one file's records spread over tasks."""
    rows = spark.read.text(path, lineSep="\n>")
    record = F.regexp_replace("value", r"^>", "")
    head = F.split_part(record, F.lit("\n"), F.lit(1))
    body = F.substring(record, F.length(head) + 2, F.length(record))
    return rows.where(F.trim("value") != "").select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """id, description, sequence, quality of four-line records; files are read whole."""
    files = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")
    starts = F.when(F.size(lines) >= 4, F.sequence(F.lit(0), F.greatest(F.size(lines) - 4, F.lit(0)), F.lit(4)))
    records = files.select(F.explode(F.transform(starts, lambda i: F.struct(F.get(lines, i).alias("h"), F.get(lines, i + 1).alias("s"), F.get(lines, i + 3).alias("q")))).alias("r"))
    head = F.substring("r.h", 2, 1 << 30)
    return records.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), F.col("r.s").alias("sequence"), F.col("r.q").alias("quality"))


def fasta_lines(id: Column, description: Column, sequence: Column, width: int = 60) -> Column:
    head = F.concat(F.lit(">"), F.concat_ws(" ", id, F.nullif(description, F.lit(""))))
    return F.concat(head, F.lit("\n"), F.rtrim(F.regexp_replace(sequence, f"(.{{1,{width}}})", "$1\n")))


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), max_rows_per_file: int | None = None, **options) -> None:
    """Spark's committed write; mode 'replace_partitions' overwrites only the partitions that df holds."""
    if format == "fasta":
        df, format = df.select(fasta_lines(F.col("id"), F.col("description"), F.col("sequence")).alias("value")), "text"
    w = df.write.format("json" if format == "jsonl" else format).options(**{k: str(v) for k, v in options.items()})
    if mode == "replace_partitions":
        w, mode = w.option("partitionOverwriteMode", "dynamic"), "overwrite"
    if max_rows_per_file:
        w = w.option("maxRecordsPerFile", max_rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).mode(mode).save(path)
