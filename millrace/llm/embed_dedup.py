"""Embedding near-duplicates through a pivot-permutation index.

Each vector is described by its PREFIX nearest of a bounded set of pivots. Inverted lists are kept
per pair of pivots, so two vectors meet exactly when they share at least two pivots of their
prefixes; each meeting is verified by cosine in double precision, once, in the list of their two
least shared pivots. Equal vectors are one entry with a count. Lists of any length are verified
whole: long ones are dealt out as pairs of blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, staged

COSINE = 0.9
#: Pivots: about the square root of the number of distinct vectors within these bounds, chosen from a sample of at most SAMPLE and no two closer than APART.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE, APART, PREFIX = 64, 1024, 8192, 0.7, 7
_BLOCK, _BUCKET_ROWS = 2048, 24_000


def _unit(blobs: list[bytes]) -> np.ndarray:
    """Unit vectors of blobs of one length; a first byte tells the width of their components."""
    kind = np.dtype(f"<f{blobs[0][0]}")
    x = np.frombuffer(b"".join(b[1:] for b in blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _raw(vectors: DataFrame) -> DataFrame:
    """vec_id, v (bytes: 4 or 8 for the width, then the components as the table has them; null where the vector can't be compared)."""
    wide = vectors.schema["embedding"].dataType.elementType.typeName() == "double"

    @lean
    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                good = None
                if x and None not in x:
                    a = np.array(x, np.float64)
                    if np.isfinite(a).all() and a.any():
                        good = b"\x08" + (a + 0.0).astype("<f8").tobytes() if wide else b"\x04" + (a + 0.0).astype("<f4").tobytes()
                out.append(good)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, v binary")


def _pivots(distinct: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By dimension, unit vectors spread apart: candidates in hash order, each taken if no earlier one is closer than APART."""
    want = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, round(n**0.5))))
    by_size: dict[int, list[bytes]] = {}
    # Each task sends the driver its own least SAMPLE: a bound on the hash, twice what is needed, keeps their sum from growing.
    low = distinct.select("v").where(F.xxhash64("v") < int(-(2**63) + 2**64 * (2 * SAMPLE / n))) if n > 2 * SAMPLE else distinct.select("v")
    for r in low.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect():
        by_size.setdefault(len(r.v), []).append(bytes(r.v))
    out = {}
    for size, blobs in by_size.items():
        x = _unit(blobs)
        taken: list[int] = []
        for i in range(len(x)):
            if len(taken) == want:
                break
            if not taken or (x[taken] @ x[i]).max() < APART:
                taken.append(i)
        out[size] = x[taken]
    return out


def _posted(distinct: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """An entry (list key, rep, times, v, prefix) for each pair of pivots of each vector's prefix."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)

    @lean
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                reps, times, blobs = (c.to_pylist() for c in part.columns)
                keys, rows, prefixes = [], [], []
                for size in sorted({len(b) for b in blobs}):
                    own = [i for i, b in enumerate(blobs) if len(b) == size]
                    p = shared.value.get(size)
                    if p is None:  # a dimension that the sample lacks: one list
                        near = np.zeros((len(own), 2), np.int16)
                        near[:, 1] = 1
                    else:
                        near = np.sort(np.argsort(-(_unit([blobs[i] for i in own]) @ p.T), axis=1, kind="stable")[:, : min(PREFIX, len(p))], axis=1).astype(np.int16)
                        if near.shape[1] < 2:
                            near = np.column_stack((near, np.full(len(own), MOST_PIVOTS, np.int16)))
                    for a, b in combinations(range(near.shape[1]), 2):
                        keys += ((np.int64(size) << 32) | near[:, a].astype(np.int64) << 16 | near[:, b]).tolist()
                        rows += own
                        prefixes += [r.tobytes() for r in near]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "rep": pa.array([reps[i] for i in rows], pa.int64()), "times": pa.array([times[i] for i in rows], pa.int64()), "v": pa.array([blobs[i] for i in rows], pa.binary()), "prefix": pa.array(prefixes, pa.binary())})

    return distinct.select("rep", "times", "v").mapInArrow(run, "key long, rep long, times long, v binary, prefix binary")


def _first_meeting(key: int, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Is this list the pair's first: do they share no pivot before the second of its two, but the first?"""
    lo, hi = key >> 16 & 0xFFFF, key & 0xFFFF

    def flags(prefixes: list[bytes]) -> np.ndarray:
        p = np.frombuffer(b"".join(prefixes), np.int16).reshape(len(prefixes), -1)
        m = np.zeros((len(p), hi), np.float32)
        row, col = np.nonzero((p < hi) & (p != lo))
        m[row, p[row, col]] = 1
        return m

    return flags(left) @ flags(right).T == 0 if hi > 1 else np.ones((len(left), len(right)), bool)


def _verified(blocks: DataFrame, least: float) -> DataFrame:
    """From each block: (rep, others) with the vectors linked to rep in it, and (rep, root) that spans its components."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table[c].to_numpy() for c in ("rep", "bj", "bi", "key")])
        key, bi, bj, own, rep, times = (table[c].to_numpy()[order] for c in ("key", "bi", "bj", "own", "rep", "times"))
        v, prefix = (table[c].to_pylist() for c in ("v", "prefix"))
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        a, others, root = [], [], []
        for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(key)], strict=True):
            if hi - lo < 2:
                continue
            at = np.arange(lo, hi)
            x, pre = _unit([v[order[i]] for i in at]), [prefix[order[i]] for i in at]
            link = x @ x.T >= least
            np.fill_diagonal(link, False)
            if bi[lo] != bj[lo]:
                link &= own[at][:, None] != own[at][None, :]
            if not link.any():
                continue
            some = np.flatnonzero(link.any(1))
            link, at, pre = link[np.ix_(some, some)], at[some], [pre[i] for i in some]
            link &= _first_meeting(int(key[lo]), pre, pre)
            count = link @ times[at]
            label = np.arange(len(at))
            while True:
                low = np.minimum(label, np.where(link, label[None, :], len(at)).min(1))
                low = low[low]
                if (low == label).all():
                    break
                label = low
            for i in np.flatnonzero(count):
                a.append(int(rep[at[i]]))
                others.append(int(count[i]))
                root.append(int(rep[at[label[i]]]))
        return pa.table({"rep": pa.array(a, pa.int64()), "others": pa.array(others, pa.int64()), "root": pa.array(root, pa.int64())})

    return blocks.groupBy("bucket").applyInArrow(run, "rep long, others long, root long")


def near_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components, and rows without vec_id,
    link with nothing. Vectors of different lengths never link. Rows that repeat a vec_id count as
    vectors of their own. Extra columns are ignored; an empty table gives no rows. Components are
    kept as the table has them, cosines are in double precision.
    """
    raw = staged(_raw(vectors), "vectors")
    usable = raw.where("v is not null and vec_id is not null")
    distinct = staged(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")), "distinct")
    n = distinct.count()
    posted = staged(_posted(distinct, _pivots(distinct, n)), "posted")
    sizes = posted.groupBy("key").agg(F.count("*").alias("size"))
    long_lists = staged(sizes.where(F.col("size") > _BLOCK).select("key", F.ceil(F.col("size") * 2 / F.lit(_BLOCK)).cast("int").alias("blocks")), "long")
    dealt = posted.join(long_lists, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    with_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    # Two blocks meet in the cell of both; a block's own pairs in (b, b) only.
    dealt = dealt.withColumn("other", F.explode(with_)).select("key", "rep", "times", "v", "prefix", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    replicas = sizes.agg(F.sum(F.when(F.col("size") > _BLOCK, F.col("size") * F.ceil(F.col("size") * 2 / F.lit(_BLOCK))).otherwise(F.col("size")))).first()[0] or 0
    buckets = max(4, -(-replicas // _BUCKET_ROWS))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(buckets)).cast("int"))
    found = staged(_verified(dealt, least), "links")
    counts = found.groupBy("rep").agg(F.sum("others").alias("others"))
    cells = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    whole = distinct.join(counts, "rep", "left").join(cells, F.col("rep") == F.col("id"), "left").select("v", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.join(whole, "v").select("vec_id", "n_links", "component_id")
    alone = raw.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
