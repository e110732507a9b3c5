"""Merkle fixity audit of WARC replicas.

An archive is a table of segments of WARC records with ordered offset ranges. A leaf hashes a
record's digest with its offset and length; leaves make a binary tree per segment, and segment roots
a tree of FAN children a node per shard. Two replicas are compared root by root, shards first, and
only mismatching branches are descended, down to the records where they differ.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

#: Records of a segment, and children of a node above the segments.
SEGMENT_RECORDS, FAN = 256, 256
_LEAF, _NODE = b"\x00", b"\x01"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 response record as bytes; a null url or body is empty."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def build_archive(pages: DataFrame, segment_records: int = SEGMENT_RECORDS) -> DataFrame:
    """shard, segment, ordinal, offset, length, page_id, record: pages in page_id order, staged in the shared folder.

    Null page_ids come first; rows that repeat a page_id stay, in the order of their digests.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    rows = rows.withColumn("tie", F.xxhash64("record")).repartitionByRange("page_id", "tie").sortWithinPartitions("page_id", "tie").drop("tie")

    @lean
    def run(batches):
        shard, n, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_pylist()
            where = []
            for s in size:
                if n % segment_records == 0:
                    offset = 0
                where.append((shard, n // segment_records, n % segment_records, offset, s))
                offset += s
                n += 1
            cols = [pa.array(c, t) for c, t in zip(zip(*where, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)] if where else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(0), batch.column(1)], ["shard", "segment", "ordinal", "offset", "length", "page_id", "record"])

    return staged(rows.mapInArrow(run, "shard int, segment int, ordinal int, offset long, length long, page_id long, record binary"), "archive")


def tree(leaves: list[bytes]) -> list[list[bytes]]:
    """Levels from leaves to root; an odd last node goes up as it is."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([hashlib.sha256(_NODE + low[i] + low[i + 1]).digest() if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    return levels


def leaf(digest: bytes, offset: int, length: int) -> bytes:
    return hashlib.sha256(_LEAF + struct.pack("<qq", offset, length) + digest).digest()


def differing(a: list[list[bytes]], b: list[list[bytes]]) -> tuple[list[int], int]:
    """Leaves at which two trees differ or only one has a leaf, and how many nodes were compared."""
    if len(a) != len(b) or len(a[0]) != len(b[0]):  # truncated or extended: the shapes differ, so leaves are compared
        n, most = min(len(a[0]), len(b[0])), max(len(a[0]), len(b[0]))
        return [i for i in range(n) if a[0][i] != b[0][i]] + list(range(n, most)), most
    todo, found, compared = [(len(a) - 1, 0)], [], 0
    while todo:
        level, i = todo.pop()
        compared += 1
        if a[level][i] == b[level][i]:
            continue
        if level == 0:
            found.append(i)
        else:
            todo += [(level - 1, j) for j in (2 * i, 2 * i + 1) if j < len(a[level - 1])]
    return sorted(found), compared


def segment_trees(replica: DataFrame) -> DataFrame:
    """shard, segment, root, leaves (32 bytes each in a row) of a table with (shard, segment, ordinal, offset, length, record)."""
    rows = replica.select("shard", "segment", "ordinal", "offset", "length", F.sha2("record", 256).alias("digest"))

    @lean
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("shard", "ascending"), ("segment", "ascending"), ("ordinal", "ascending")])
        by: dict[tuple[int, int], list[bytes]] = {}
        for shard, segment, offset, length, digest in zip(*(t[c].to_pylist() for c in ("shard", "segment", "offset", "length", "digest")), strict=True):
            by.setdefault((shard, segment), []).append(leaf(bytes.fromhex(digest or ""), offset or 0, length or 0))
        return pa.table({"shard": pa.array([k[0] for k in by], pa.int32()), "segment": pa.array([k[1] for k in by], pa.int32()), "root": pa.array([tree(v)[-1][0] for v in by.values()], pa.binary()), "leaves": pa.array([b"".join(v) for v in by.values()], pa.binary())})

    return rows.groupBy("shard", "segment").applyInArrow(run, "shard int, segment int, root binary, leaves binary")  # a segment's records


def _upper(trees: DataFrame, height: int) -> list[DataFrame]:
    """Levels from segments up: (shard, node, root), so many above the segments; a node hashes at most FAN children in order."""
    levels = [trees.select("shard", F.col("segment").alias("node"), "root")]
    for _ in range(height):
        below = levels[-1].groupBy("shard", F.expr(f"node div {FAN}").cast("int").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("below"))
        named = F.transform("below", lambda s: F.concat(s["node"].cast("string"), F.lit(":"), F.hex(s["root"])))
        levels.append(below.select("shard", "node", F.unhex(F.sha2(F.array_join(named, ","), 256)).alias("root")))
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """shard, segment, ordinal of the records at which two replicas differ, with the nodes compared in the segment.

    Records that only one replica has differ. Extra columns are ignored; empty replicas agree.
    """
    a, b = staged(segment_trees(left), "tree"), staged(segment_trees(right), "tree")
    most = max(t.agg(F.coalesce(F.max("segment"), F.lit(0))).first()[0] for t in (a, b))
    height = 1
    while most >= FAN**height:
        height += 1
    bad = None
    for x, y in zip(reversed(_upper(a, height)), reversed(_upper(b, height)), strict=True):  # from the shards' roots down
        if bad is not None:
            above = bad.select("shard", F.col("node").alias("above"))
            x, y = (t.join(above, (t["shard"] == above["shard"]) & (F.expr(f"node div {FAN}") == F.col("above")), "left_semi") for t in (x, y))
        both = x.withColumnRenamed("root", "one").join(y.withColumnRenamed("root", "two"), ["shard", "node"], "full")
        bad = staged(both.where("not (one <=> two)").select("shard", "node"), "branches")
    bad = bad.select("shard", F.col("node").alias("segment"))
    x, y = (t.join(bad, ["shard", "segment"], "left_semi") for t in (a, b))
    both = x.select("shard", "segment", F.col("leaves").alias("a")).join(y.select("shard", "segment", F.col("leaves").alias("b")), ["shard", "segment"], "full")

    @lean
    def run(batches):
        for batch in batches:
            out = []
            for shard, segment, p, q in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                one, two = ([s[i : i + 32] for i in range(0, len(s), 32)] for s in (p or b"", q or b""))
                found, compared = differing(tree(one), tree(two))
                out += [(shard, segment, i, compared) for i in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["shard", "segment", "ordinal", "compared"])

    return both.select("shard", "segment", "a", "b").mapInArrow(run, "shard int, segment int, ordinal int, compared long")


def with_faults(archive: DataFrame, every: int = 211) -> DataFrame:
    """A replica whose records are damaged in one byte where crc32 of the page_id is a multiple of `every`: what the registered query audits."""
    n = F.octet_length("record")
    at = (F.pmod(F.xxhash64("page_id"), n) + 1).cast("int")
    damaged = F.concat(F.substring("record", F.lit(1), at - 1), F.unhex(F.when(F.hex(F.substring("record", at, F.lit(1))) == "23", "24").otherwise("23")), F.substring("record", at + 1, n))
    hit = F.pmod(F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), F.lit(every)) == 0
    return archive.withColumn("record", F.when(hit, damaged).otherwise(F.col("record")))


def audit_report(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of the archive: page_id, shard, segment, ordinal, offset, length, intact (false where the audit located a difference)."""
    bad = audit(archive, replica).select("shard", "segment", "ordinal", F.lit(False).alias("intact")).distinct()
    return archive.select("page_id", "shard", "segment", "ordinal", "offset", "length").join(bad, ["shard", "segment", "ordinal"], "left").select("page_id", "shard", "segment", "ordinal", "offset", "length", F.coalesce("intact", F.lit(True)).alias("intact"))
