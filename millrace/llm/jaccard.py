"""Exact Jaccard metric-space join on 5-word shingle sets, at similarity 0.8 or more.

Pivots create Voronoi regions and the triangle inequality decides what else must be compared.
Two unrelated texts are at Jaccard distance 1, so distances to whole-document pivots alone tie
everywhere. The first level therefore takes single shingles as pivots: a set is at distance
1 - 1/n from each of its own shingles and 1 from every other, ties go by one fixed order, and
the window of distance 0.2 replicates a set to its first n - ceil(0.8 n) + 1 pivots, which is
exactly what any pair within 0.2 must share. Inside those regions the recursion is on documents:
each region's least document is its pivot, members are compared with it, and further
comparisons are made only between members which no verified link connects yet and which the
triangle inequality on their distances to a common pivot doesn't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, small_batches, staged
from .shingles import shingle_sets

#: Rows of documents that are looked at for frequent shingles, and from how many of them on one counts as frequent. Frequent shingles come last in the order; that changes the cost, never the result.
ORDER_SAMPLE, FREQUENT = 8_000, 4
#: Id sets up to this many entries (8 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Windows from which on a pivot's region is dealt out by rows; smaller regions are lists of ids. That changes the plan, never the result.
HOT = 50_000
#: Copies from which on a set may be hot: so it is where it also has a thousandth of all documents.
HOT_COPIES = 1_000
_TEXTS, _TEXT_BYTES, _PER_SALT, _BUCKET_ENTRIES, _SEEN = 2_000, 4 << 20, 512, 100_000, 1 << 17
#: Cells with a region of so many members get all their distances to the pivot; the join radius.
_LARGE, _RADIUS = 256, 0.2


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = _TEXTS) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and, beyond one row, some megabytes of texts."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0), np.int64)
        part = np.cumsum(size) // _TEXT_BYTES
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for at in range(lo, hi, rows):
                yield batch.slice(at, min(rows, hi - at))


def _frequent(docs: DataFrame) -> np.ndarray:
    n = docs.count()
    step = max(1, n // ORDER_SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)

    @lean
    def emit(batches):
        for batch in _slices(batches):
            (texts,) = _columns(batch, "text")
            sets = [s for s in shingle_sets(texts) if len(s)]
            if sets:
                keys = np.sort(np.concatenate(sets))
                cut = np.searchsorted(keys >> np.uint64(58), np.arange(65, dtype=np.uint64))
                yield pa.RecordBatch.from_pydict({"part": pa.array(range(64), pa.int32()), "keys": pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in range(64)], pa.binary())})

    @lean
    def count(table: pa.Table) -> pa.Table:
        keys, times = np.unique(np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64), return_counts=True)
        keep = times >= FREQUENT
        return pa.table({"key": pa.array(keys[keep].view(np.int64)), "times": pa.array(times[keep].astype(np.int64))})

    found = sample.select("text").mapInArrow(emit, "part int, keys binary").groupBy("part").applyInArrow(count, "key long, times long")
    top = found.orderBy(F.desc("times"), "key").limit(BROADCAST_IDS // 2).select("key").toArrow()["key"].to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def _describe(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, s1, s2 (a 128-bit signature of the set) and, for the first of equal sets in a task, its window of pivots."""
    common = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("window", pa.binary())])

    @lean
    def run(batches):
        late, seen = common.value, {}
        for batch in _slices(batches):
            ids, texts = _columns(batch, "doc_id", "text")
            rows = []
            for i, s in zip(ids, shingle_sets(texts), strict=True):
                s1 = int(s.sum(dtype=np.uint64))
                s2 = int((s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64))
                key, window = (len(s), s1, s2), None
                if len(s) and i is not None and seen.get(key, i + 1) > i:
                    if len(seen) == _SEEN:
                        seen.clear()
                    seen[key] = i
                    take = len(s) - (8 * len(s) + 9) // 10 + 1
                    if len(late):
                        slot = np.searchsorted(late, s)
                        slot[slot == len(late)] = 0
                        is_late = late[slot] == s
                        window = np.concatenate((s[~is_late][:take], s[is_late]))[:take].tobytes()
                    else:
                        window = s[:take].tobytes()
                rows.append((i, len(s), s1 - (s1 >> 63 << 64), s2 - (s2 >> 63 << 64), window))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, window binary")


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row of each, (doc_id, s1, n) of each row) of a batch of windows."""
    ids, n, s1, windows = _columns(batch, "doc_id", "n", "s1", "window")
    arrays = [np.frombuffer(w, np.uint64) for w in windows]
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(a) for a in arrays])
    return np.concatenate(arrays) if arrays else np.empty(0, np.uint64), doc, np.array([ids, s1, n], np.int64)


def _windows(described: DataFrame) -> DataFrame:
    return described.where("window is not null").select("doc_id", "n", "s1", "window")


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some sorted ones."""
    if not len(some):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(some, keys)
    at[at == len(some)] = 0
    return some[at] == keys


def _hot_pivots(described: DataFrame, frequent: np.ndarray, most: int) -> np.ndarray:
    """The frequent shingles that more than `most` windows hold, sorted; at most as many as are looked at."""
    late = described.sparkSession.sparkContext.broadcast(frequent)

    @lean
    def run(batches):
        for batch in batches:
            keys = _entries(batch)[0]
            found, times = np.unique(keys[_among(keys, late.value)], return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(found.view(np.int64)), "times": pa.array(times.astype(np.int64))})

    counted = _windows(described).mapInArrow(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    return np.sort(counted.where(F.col("times") > most).select("key").toArrow()["key"].to_numpy().astype(np.int64).view(np.uint64))


def _hot_regions(described: DataFrame, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The regions of hot pivots by rows: (pairs as _stars has them, members as _members has them); no region is in one task."""
    some = described.sparkSession.sparkContext.broadcast(hot)

    @lean
    def run(batches):
        for batch in batches:
            keys, doc, table = _entries(batch)
            at = np.flatnonzero(_among(keys, some.value))
            own = table[:, doc[at]]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[at].view(np.int64)), "id": pa.array(own[0]), "s1": pa.array(own[1]), "n": pa.array(own[2])})

    rows = _windows(described).mapInArrow(run, "key long, id long, s1 long, n long")
    rows = staged(rows.groupBy("key", "s1", "n").agg(F.min("id").alias("id")), "hot")  # of equal sets the least id stands for all
    heads = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("size"))
    dealt = rows.join(F.broadcast(heads), "key")  # a row a hot pivot
    once = F.lit(1).cast("long").alias("times")
    pairs = dealt.where("size = 2 and id <> p.id").select(F.col("p.id").alias("a"), F.col("id").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"), once)
    members = dealt.where("size > 2").select(F.xxhash64(F.lit("hot"), "key").alias("region"), once, F.col("p.id").alias("pivot"), F.col("p.n").alias("n_pivot"), F.col("size").cast("int").alias("size"), "id", "n")
    return pairs, members


def _regions(described: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Deal the windows out by pivot, but for hot ones: (bucket, keys, doc index, doc table) blobs."""
    some = described.sparkSession.sparkContext.broadcast(hot)

    @lean
    def run(batches):
        for batch in batches:
            keys, doc, table = _entries(batch)
            rest = ~_among(keys, some.value)
            keys, doc = keys[rest], doc[rest]
            bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            keys, doc = keys[order], doc[order]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = []
            for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                own, at = np.unique(doc[cut[k] : cut[k + 1]], return_inverse=True)
                rows.append((k, keys[cut[k] : cut[k + 1]].tobytes(), at.astype(np.int32).tobytes(), table[:, own].tobytes()))
            if rows:
                yield pa.RecordBatch.from_pydict({f: pa.array(c, t) for f, c, t in zip(("bucket", "keys", "at", "docs"), zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    return _windows(described).mapInArrow(run, "bucket int, keys binary, at binary, docs binary")


def _stars(regions: DataFrame) -> DataFrame:
    """Regions of two as pairs (a < b) and larger ones as lists of ids, ascending, and set sizes; equal ones in a bucket are one row.

    a is null in rows that hold a region's members; times is the number of pivots that have the region.
    """

    @lean
    def run(table: pa.Table) -> pa.Table:
        keys, ids, s1, n = [], [], [], []
        for k, at, docs in zip(*(table[c].to_pylist() for c in ("keys", "at", "docs")), strict=True):
            own = np.frombuffer(docs, np.int64).reshape(3, -1)
            at = np.frombuffer(at, np.int32)
            keys.append(np.frombuffer(k, np.uint64))
            for out, x in zip((ids, s1, n), own, strict=True):
                out.append(x[at])
        keys, ids, s1, n = map(np.concatenate, (keys, ids, s1, n))
        _, first, counts = np.unique(keys, return_inverse=True, return_counts=True)
        keep = counts[first] > 1
        keys, ids, s1, n = keys[keep], ids[keep], s1[keep], n[keep]
        order = np.lexsort((ids, s1, keys))
        keys, ids, s1, n = keys[order], ids[order], s1[order], n[order]
        if len(keys):  # of equal sets the least id stands for all
            keep = np.r_[True, (keys[1:] != keys[:-1]) | (s1[1:] != s1[:-1])]
            keys, ids, n = keys[keep], ids[keep], n[keep]
            order = np.lexsort((ids, keys))
            keys, ids, n = keys[order], ids[order], n[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        size = np.diff(np.r_[head, len(keys)])
        two = head[size == 2]
        pair, times = np.unique(np.stack((ids[two], ids[two + 1], n[two], n[two + 1]), 1) if len(two) else np.empty((0, 4), np.int64), axis=0, return_counts=True)
        groups: dict[tuple[bytes, bytes], int] = {}
        for h, s in zip(head[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            m = (ids[h : h + s].tobytes(), n[h : h + s].tobytes())
            groups[m] = groups.get(m, 0) + 1
        k, g = len(pair), len(groups)
        with_nulls = lambda x: pa.concat_arrays([pa.array(x), pa.nulls(g, pa.int64())])
        ends = pa.array(np.cumsum([0, *(len(m) // 8 for m, _ in groups)]).astype(np.int32))
        cols = {c: with_nulls(pair[:, j]) for j, c in enumerate(("a", "b", "na", "nb"))}
        cols["times"] = pa.concat_arrays([pa.array(times.astype(np.int64)), pa.array(list(groups.values()), pa.int64())])
        for j, c in enumerate(("members", "sizes")):
            lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(m[j] for m in groups), np.int64)))
            cols[c] = pa.concat_arrays([pa.nulls(k, pa.list_(pa.int64())), lists])
        return pa.table(cols)

    return regions.groupBy("bucket").applyInArrow(run, "a long, b long, na long, nb long, times long, members array<long>, sizes array<long>")


def _members(found: DataFrame) -> DataFrame:
    """A row for each member of each region of three or more: region, times, pivot, n_pivot, size, id, n. Rows carry what is known of their region, so no table is joined on the region alone."""
    regions = staged(found.where("a is null").groupBy("members", "sizes").agg(F.sum("times").alias("times")), "regions")
    each = F.explode(F.arrays_zip(F.col("members").alias("id"), F.col("sizes").alias("n"))).alias("m")
    rows = regions.select(F.xxhash64("members").alias("region"), "times", F.col("members")[0].alias("pivot"), F.col("sizes")[0].alias("n_pivot"), F.size("members").alias("size"), each)
    return rows.select("region", "times", "pivot", "n_pivot", "size", "m.id", "m.n")


def _worth(na: str = "na", nb: str = "nb", times="times"):
    """Can sets of these sizes that share so many pivots of their windows be within 0.2?

    The overlap must be 4/9 of the sizes' sum; beyond the windows at most ceil(0.8 n) - 1 can be shared.
    """
    a, b = F.col(na), F.col(nb)
    times = F.col(times) if isinstance(times, str) else times
    most, least = F.greatest(a, b), F.least(a, b)
    need = F.ceil((a + b) * 4 / F.lit(9.0) - 1e-9)
    return (least * 10 >= most * 8) & (times >= need - (F.ceil(most * 8 / F.lit(10.0) - 1e-9) - 1))


def _small(ids: DataFrame, name: str) -> DataFrame:
    """A staged table of ids, broadcast if it has at most BROADCAST_IDS."""
    ids = staged(ids, name)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = _small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    kept = docs.where("doc_id is not null").select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return staged(kept, "texts")


def _verify(docs: DataFrame, pairs: DataFrame, every: bool = False) -> DataFrame:
    """Exact similarity of each pair (a, b): a, b, common, total for those at 0.8 or more (or for every pair), streamed pivot by pivot."""
    texts = _texts_of(docs, pairs).dropDuplicates(["doc_id"])
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(_PER_SALT)).cast("int").alias("salts"))
    dealt = pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    heads = load.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("a", F.col("a").alias("b"), "salt")
    rows = dealt.unionByName(heads).join(texts, F.col("b") == F.col("doc_id")).select("a", "salt", (F.col("a") != F.col("b")).alias("later"), "b", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("total", pa.int64())])

    @lean
    def run(batches):
        pivot, own = None, None
        for batch in _slices(batches, 500):
            a, later, b, text = _columns(batch, "a", "later", "b", "text")
            out = []
            for x, is_later, y, s in zip(a, later, b, shingle_sets(text), strict=True):
                if not is_later:
                    pivot, own = x, s
                elif x == pivot:
                    both = np.sort(np.concatenate((own, s)))
                    common = int((both[1:] == both[:-1]).sum())
                    total = len(both) - common
                    if every or 100 * common >= 80 * total:
                        out.append((x, y, common, total))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], schema=schema)

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "later").mapInArrow(run, "a long, b long, common long, total long")


def _band():
    """The band of width 0.2 that a pair's distance (total - common) / total is in; in integers, so that distances on an edge are in the upper band."""
    return F.expr("cast(5 * (total - common) div total as int)")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Extra columns of docs are ignored. Null or wordless text: n_shingles 0, its own component.
    Equal sets link (similarity 1). Rows that repeat a doc_id are documents of their own, each with
    its own links. A null doc_id keeps its row, links with nothing and gets a null component. An empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = _frequent(docs)
    described = staged(_describe(docs, frequent), "sets")
    unlike = described.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("lo"), F.max(F.struct("n", "s1", "s2")).alias("hi")).where("lo <> hi")
    if not unlike.isEmpty():  # a doc_id with several texts: rows are numbered, and the numbers stand for doc_ids
        keyed = staged(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
        of_row = _components(keyed.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text"), frequent)
        of_row = staged(of_row.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("cell")).join(keyed.select("row", "doc_id"), "row"), "rows")
        least = of_row.groupBy("cell").agg(F.min("doc_id").alias("component_id"))
        null = described.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
        return of_row.join(least, "cell").select("doc_id", "n_shingles", "component_id").unionByName(null)
    return _components(docs, frequent, described)


def _components(docs: DataFrame, frequent: np.ndarray, described: DataFrame | None = None) -> DataFrame:
    """jaccard_components of a table in which rows of one doc_id have one set."""
    described = staged(_describe(docs, frequent), "sets") if described is None else described
    n_windows, entries = described.agg(F.count("window"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    hot = _hot_pivots(described, frequent, HOT) if n_windows > HOT else np.empty(0, np.uint64)
    buckets = max(8, -(-(entries // 8) // _BUCKET_ENTRIES))
    found = staged(_stars(_regions(described, buckets, hot)), "stars")
    pairs, member = found.where("a is not null").select("a", "b", "na", "nb", "times"), _members(found)
    if len(hot):
        more_pairs, more_members = _hot_regions(described, hot)
        pairs, member = pairs.unionByName(more_pairs), member.unionByName(more_members)
    # Each region's pivot (least document) with each other member; times is the number of shared pivots, alone that of those which no other set shares.
    pairs = pairs.withColumn("alone", F.col("times"))
    pairs = pairs.unionByName(member.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"), F.col("n_pivot").alias("na"), F.col("n").alias("nb"), "times", F.lit(0).cast("long").alias("alone")))
    stars = staged(pairs.groupBy("a", "b", "na", "nb").agg(F.sum("times").alias("times"), F.sum("alone").alias("alone")), "pairs")
    links = staged(_verify(docs, stars.where(_worth()).select("a", "b")), "links")
    cells = staged(connected_components(links), "cells")
    # Recursion: in regions of three or more, members that no link connects yet. Regions with one pivot make one Voronoi cell.
    salt = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("size") / _PER_SALT)).cast("int").alias("salt")
    member = member.join(cells, "id", "left").select("region", "times", "pivot", "size", "id", F.coalesce("component", "id").alias("cell"), salt("id"))
    member = staged(member, "members")
    mixed = member.groupBy("region", "pivot", "size").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.max(F.when(F.col("id") == F.col("pivot"), F.col("cell"))).alias("home")).where("lo <> hi")
    mixed = staged(mixed.select("region", "pivot", "size", "home"), "mixed")
    held = stars.select(F.col("b").alias("id"), "times").unionByName(stars.select(F.col("a").alias("id"), F.col("alone").alias("times"))).unionByName(member.where("id = pivot").select("id", "times"))
    held = held.groupBy("id").agg(F.sum("times").alias("held"))  # how many pivots a set shares with any other
    sizes = described.where("window is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("n").alias("n"))
    shared = F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1), F.col("times")), lambda i: F.xxhash64("region", i))))  # a window's length at most
    parts = mixed.select("region", "home", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / _PER_SALT).cast("int") - 1)).alias("salt"))
    open_ = member.join(parts, ["region", "salt"]).where("id <> pivot").groupBy("pivot", "id").agg(F.first("cell").alias("cell"), F.first("home").alias("home"), shared.alias("shared"))
    large = _small(mixed.where(F.col("size") >= _LARGE).select("pivot").distinct(), "large")
    open_ = open_.join(sizes, "id").join(held, "id").join(large.withColumn("large", F.lit(True)), "pivot", "left")
    open_ = staged(open_, "open")
    far = staged(_verify(docs, open_.where("large").select(F.col("pivot").alias("a"), F.col("id").alias("b")), every=True), "far")
    far = far.select(F.col("a").alias("pivot"), F.col("b").alias("id"), (1 - F.col("common") / F.col("total")).alias("far"), _band().alias("band"))
    # The window: a pair within 0.2 has distances to the pivot within 0.2, so it meets in a band of that width or beside it.
    open_ = open_.join(far, ["id", "pivot"], "left").withColumn("band", F.coalesce("band", F.lit(0)))
    x, y = (open_.select("pivot", "home", "band", (F.col("held") - F.size("shared")).alias(f"rest_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("id", "cell", "n", "far", "shared"))) for s in "xy")
    # What is connected with the pivot has nothing to be compared with among its like: one side of a pair isn't.
    x = x.where("cell_x <> home")
    y = y.drop("home").withColumn("band", F.explode(F.when(F.col("far_y").isNull(), F.array("band")).otherwise(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))))
    window = F.coalesce(F.abs(F.col("far_x") - F.col("far_y")) <= _RADIUS + 1e-9, F.lit(True))
    here = F.size(F.array_intersect("shared_x", "shared_y")).cast("long")
    may = _worth("n_x", "n_y", here + F.least("rest_x", "rest_y"))
    once = (F.col("cell_y") == F.col("home")) | (F.col("id_x") < F.col("id_y"))
    pairs = x.join(y, ["pivot", "band"]).where((F.col("cell_x") != F.col("cell_y")) & once & window & may)
    low = F.col("id_x") < F.col("id_y")
    either = lambda c: (F.when(low, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")), F.when(low, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")))
    (a, b), (na, nb) = either("id"), either("n")
    pairs = pairs.select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb"), here.alias("times"))
    # A pair's shared pivots are split between regions whose pivot it holds and others; only their sum decides.
    cell = lambda c: cells.select(F.col("id").alias(c), F.col("component").alias(f"cell_{c}"))
    rest = stars.where(~_worth()).join(cell("a"), "a", "left").join(cell("b"), "b", "left").where("coalesce(cell_a, a) <> coalesce(cell_b, b)").select("a", "b", "na", "nb", "times")
    pairs = pairs.unionByName(rest).groupBy("a", "b", "na", "nb").agg(F.sum("times").alias("times")).where(_worth())
    more = _verify(docs, staged(pairs.select("a", "b"), "pairs"))
    final = staged(connected_components(links.select("a", "b").unionByName(more.select("a", "b"))), "cells")
    return _spread(described, final)


def _spread(described: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, from the components of the least document of each set."""
    key, out = ["n", "s1", "s2"], ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    full = described.where("n > 0 and doc_id is not null").select("doc_id", *key)
    sets = full.groupBy(*key).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    sets = staged(sets.join(cells, F.col("least") == F.col("id"), "left").select(*key, "copies", F.coalesce("component", "least").alias("component_id")), "cells")
    # Sets of very many copies, a thousand at most, are joined by broadcast.
    every = sets.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(sets.where(F.col("copies") >= max(HOT_COPIES, every // 1_000)).drop("copies"))
    sets = sets.drop("copies")
    linked = full.join(sets, key) if hot.isEmpty() else full.join(hot, key).unionByName(full.join(hot, key, "left_anti").join(sets, key))
    alone = described.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select(*out).unionByName(alone.select(*out))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents, one of its least doc_id, with docs's own columns.

    Rows with a null doc_id link with nothing and stay. Null, empty and wordless texts make groups of
    their own. Rows that repeat a doc_id are documents of their own: of equal ones one stays. Whole
    texts, whatever their length; further columns may have any names; an empty table gives none.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # no clash with names of our own
    plain = docs.toDF(*names)
    key, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    known = plain.where(key.isNotNull())
    if known.groupBy(key.cast("long").alias("doc_id")).count().where("count > 1").isEmpty():
        kept = jaccard_components(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id")
        kept = known.join(kept, key.cast("long") == F.col("doc_id"), "left_semi")
    else:  # some doc_id has several rows: rows are numbered, and the numbers stand for doc_ids
        numbered = staged(known.withColumn("row", F.monotonically_increasing_id()), "rows")
        alike = jaccard_components(numbered.select(F.col("row").alias("doc_id"), text.cast("string").alias("text")))
        first = alike.select(F.col("doc_id").alias("row"), F.col("component_id").alias("cell")).join(numbered.select("row", key.cast("long").alias("doc_id")), "row").groupBy("cell").agg(F.min(F.struct("doc_id", "row")).alias("least"))
        kept = numbered.join(first.select(F.col("least.row").alias("row")), "row", "left_semi").select(*names)
    return kept.unionByName(plain.where(key.isNull())).toDF(*docs.columns)
