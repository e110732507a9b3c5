"""Token-ID output: documents encoded, ordered by doc_id and stored as Re-Pair grammar blocks.

A dataset is a folder of Parquet files whose rows are blocks, written with Spark's task commit.
A block's payload (little-endian) is the whole grammar of some million ids:

    magic 4s "RPG2" | id width u8 (2 or 4) | pad 3 | base u32 | rounds u32 | rules u32 | docs u32 | symbols u64
    doc ids i64[docs] | is null u8[docs] | end symbol offset of each document u64[docs] | rules after each round u32[rounds]
    rules (left, right) [rules, 2] | expansion length of each rule u32[rules] | sequence [symbols]

Symbols below base are token ids, symbol base + r is rule r; rules never cross documents, so any
document decodes on its own from its offsets and the expansion lengths.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, stage_path

END_ID = 2
#: Ids of a block, and the least uses of a pair that counts as frequent. Where the vocabulary leaves room in two bytes, the least is raised so far that rules fit there: each takes so many symbols away.
BLOCK_TOKENS, LEAST_USES = 1 << 20, 32
#: A round replaces the pairs that have at least this part of the most frequent one's uses.
STEP = 1 / 24
_SPREAD = 18
_HEAD = struct.Struct("<4sB3xIIIIQ")
_ENCODERS: dict[str, "Encoder"] = {}

_CHUNK = 1 << 19
#: The table of pieces: sets of two ways, bytes of a piece that fits, and pool entries beyond which it starts anew.
_SET_BITS, _MOST_BYTES, _POOL = 19, 23, 1 << 22
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_MAY_OPEN_WHITE = _WHITE.copy()  # first bytes of the characters of white space beyond ASCII
_MAY_OPEN_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for each, in a row."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


class Encoder:
    """The tokenizers library behind a bounded table of pieces, looked up for many texts at once.

    The byte-level pre-tokenizer never joins a character with a following single space or newline,
    so a text cut before those encodes to its pieces' ids in a row; cuts are made only between
    characters that surely aren't white space. The table holds pieces byte for byte, so a hit is
    never a collision. Texts that hold an added token, and all texts under another pre-tokenizer or a
    normalizer, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # the library's own word cache: only pieces that the table lacks get there
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.base = max(vocabulary.values()) + 1
        self.bytes_of = np.ones(self.base, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a byte-level token has a character for each byte
        self.dtype = np.dtype("<u2" if self.base < 1 << 16 else "<u4")
        self._clear()

    def _clear(self) -> None:
        self.table = np.zeros((1 << _SET_BITS, 2, 4), np.uint64)  # 23 bytes and their number, then pool offset and length
        self.pool, self.fill = np.empty(1 << 16, self.dtype), 0
        self.long: dict[bytes, int] = {}

    def _kept(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Append ids to the pool: the place (offset << 32 | length) of each run of so many."""
        if self.fill + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.fill], np.empty(max(len(self.pool), len(flat)), self.dtype)))
        self.pool[self.fill : self.fill + len(flat)] = flat
        place = (self.fill + np.cumsum(size) - size) << 32 | size
        self.fill += len(flat)
        return place.astype(np.uint64)

    def _library(self, pieces: list[bytes], joins: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each piece). Pieces that may stand in a row in a text are encoded as one, and its ids dealt out by their bytes."""
        if joins and len(pieces) > 1:
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(pieces).decode("utf-8")], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(self.bytes_of[ids])
            stop = np.cumsum([len(p) for p in pieces])
            at = np.searchsorted(ends, stop)
            if at[-1] < len(ends) and (ends[at] == stop).all():
                return ids.astype(self.dtype), np.diff(at + 1, prepend=0)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), self.dtype), np.array([len(x) for x in ids], np.int64)

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The places of pieces new to the table; inner: a cut before and after."""
        place = np.empty(len(start), np.uint64)
        for part, joins in ((np.flatnonzero(inner), True), (np.flatnonzero(~inner), False)):
            if len(part):
                place[part] = self._kept(*self._library([raw[s:e].tobytes() for s, e in zip(start[part].tolist(), end[part].tolist(), strict=True)], joins))
        return place

    def _places(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The pool place of every piece, learnt where the table lacks it; inner as in _learn."""
        size = end - start
        place = np.zeros(len(start), np.uint64)
        far = size > _MOST_BYTES
        if far.any():
            which = np.flatnonzero(far)
            texts = [raw[s:e].tobytes() for s, e in zip(start[which].tolist(), end[which].tolist(), strict=True)]
            new = list({t: i for i, t in enumerate(texts) if t not in self.long}.items())
            if new:
                at = which[[i for _, i in new]]
                self.long |= zip([t for t, _ in new], self._learn(raw, start[at], end[at], inner[at]).tolist(), strict=True)
            place[which] = [self.long[t] for t in texts]
            which = np.flatnonzero(~far)
            start, end, size, inner = start[which], end[which], size[which], inner[which]
        else:
            which = slice(None)
        view = np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))
        w = [view[start + 8 * j] & _MASK[np.clip(size - 8 * j, 0, 8)] for j in range(3)]
        w[2] |= size.astype(np.uint64) << np.uint64(56)
        h = w[0] * _ODD[0] + w[1] * _ODD[1] + w[2] * _ODD[2]
        h = (h ^ h >> np.uint64(29)) * _ODD[3]
        at = (h >> np.uint64(64 - _SET_BITS)).astype(np.int64)
        row = self.table.take(at, 0)
        hit = [(row[:, k, 0] == w[0]) & (row[:, k, 1] == w[1]) & (row[:, k, 2] == w[2]) for k in range(2)]
        own = np.where(hit[0], row[:, 0, 3], row[:, 1, 3])
        miss = np.flatnonzero(~(hit[0] | hit[1]))
        if len(miss):
            order = miss[np.lexsort([x[miss] for x in w])]
            fresh = np.r_[True, np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in w])]
            first = order[fresh]
            new = self._learn(raw, start[first], end[first], inner[first])
            own[order] = new[np.cumsum(fresh) - 1]
            spot = at[first]
            full = self.table[spot, :, 2] > 0
            way = np.where(~full[:, 0], 0, np.where(~full[:, 1], 1, (h[first] >> np.uint64(8) & np.uint64(1)).astype(np.int64)))
            self.table[spot, way] = np.stack((w[0][first], w[1][first], w[2][first], new), 1)
        place[which] = own
        return place

    def _whole(self, raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._library([raw[s:e].tobytes() for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])

    def encode(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids of each) of the texts data[begin[i]:begin[i + 1]] (UTF-8 bytes)."""
        lo, n = int(begin[0]), int(begin[-1] - begin[0])
        raw = np.zeros(n + 36, np.uint8)
        raw[4 : n + 4] = data[lo : lo + n]
        begin = begin - lo + 4
        blob = raw.tobytes()
        if not self.cuts:
            return self._whole(raw, begin)
        special = np.zeros(len(begin) - 1, bool)
        for t in self.added:
            at = blob.find(t)
            while at >= 0:
                special[np.searchsorted(begin, at, side="right") - 1] = True
                at = blob.find(t, at + 1)
        if special.any():  # an added token is found before anything is cut
            parts = [self._whole(raw, begin[i : i + 2]) if s else self.encode(raw, begin[i : i + 2]) for i, s in enumerate(special.tolist())]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if self.fill > _POOL or len(self.long) > 1 << 15:
            self._clear()
        gap = np.flatnonzero((raw == 32) | (raw == 10))
        gap = gap[~_WHITE[raw[gap - 1]] & ~_MAY_OPEN_WHITE[raw[gap + 1]]]
        lead = raw[gap - 3]
        gap = gap[~((raw[gap - 1] >= 0x80) & ((raw[gap - 2] == 0xC2) | (lead >= 0xE1) & (lead <= 0xE3)))]
        is_start, is_cut = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        is_cut[gap] = True
        is_cut[begin] = False  # what a text begins or ends with isn't joined to another's
        is_start[gap] = True
        is_start[begin[:-1][begin[1:] > begin[:-1]]] = True
        start = np.flatnonzero(is_start)
        if not len(start):
            return np.empty(0, self.dtype), np.zeros(len(begin) - 1, np.int64)
        end = np.append(start[1:], n + 4)
        place = self._places(raw, start, end, is_cut[start] & is_cut[end])
        size = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids = self.pool[_ranges((place >> np.uint64(32)).astype(np.int64), size)]
        total = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, begin)]
        return ids, np.diff(total)


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file; its table outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(texts: pa.Array, enc: Encoder):
    """(first, ids with END_ID after every text, ids of each) of a column of strings, in chunks of texts; null: empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    begin = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + _CHUNK, side="right")) - 1)
        ids, size = enc.encode(data, begin[lo : hi + 1])
        yield lo, np.insert(ids, np.cumsum(size), END_ID), size + 1
        lo = hi


def least_uses(n: int, base: int) -> int:
    """The uses from which on a pair of a block of n ids is frequent."""
    room = (1 << 16) - base
    return max(LEAST_USES, -(-n // room)) if room > 256 else LEAST_USES


def re_pair(symbols: np.ndarray, last: np.ndarray, base: int, least: int | None = None) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """(rules, rules after each round, sequence, last): rounds go on until no pair has `least` uses that don't overlap.

    last marks the final symbol of each document; no pair crosses it. Pairs are counted exactly: a
    pair's uses only shrink unless it holds the newest symbols, so after the first round only places
    of frequent pairs and of new symbols are looked at. A round replaces the most frequent pairs at
    once, the more frequent first where two overlap; of runs of one pair every second is taken. Pairs
    that share a hash cell with a more frequent one wait for the next round.
    """
    n = len(symbols)
    least = least or least_uses(n, base)
    wide = base + n // least >= 1 << 16
    kind, half, low = (np.uint64, np.uint64(32), np.uint64(0xFFFFFFFF)) if wide else (np.uint32, np.uint32(16), np.uint32(0xFFFF))
    cell = lambda k: (k * _ODD[0] >> np.uint64(64 - _SPREAD)) if wide else (k * np.uint32(0x9E3779B1) >> np.uint32(32 - _SPREAD))
    seq = np.append(symbols.astype(kind), kind(0))
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # the neighbours of a place, n and -1 where none is
    stops = np.flatnonzero(last)
    after[stops] = n
    before[stops + 1] = -1
    gone = np.zeros(n + 1, bool)
    at = np.flatnonzero(~last)  # places of pairs that may be frequent
    rules, n_rules, rounds, rare = [], 0, [], np.empty(0, kind)
    while len(at) >= least:
        key = seq[at] << half | seq[after[at]]
        ordered = np.sort(key)
        edge = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
        uses = np.diff(edge)
        often = np.flatnonzero(uses >= least)
        pairs, uses = ordered[edge[often]], uses[often]
        if len(rare):
            known = np.isin(pairs, rare)
            pairs, uses = pairs[~known], uses[~known]
        if not len(pairs):
            break
        may = np.zeros(1 << _SPREAD, bool)
        may[cell(pairs)] = True
        spot = cell(key)
        stay = may[spot]
        at, key, spot = at[stay], key[stay], spot[stay]
        top = uses >= uses.max() * STEP
        pairs = pairs[top][np.argsort(-uses[top], kind="stable")]
        _, first = np.unique(cell(pairs), return_index=True)  # of pairs in one cell the more frequent
        pairs = pairs[np.sort(first)]
        rank_of = np.full(1 << _SPREAD, -1, np.int32)
        rank_of[cell(pairs)] = np.arange(len(pairs), dtype=np.int32)
        own = rank_of[spot]
        here = np.flatnonzero(own >= 0)
        here = here[pairs[own[here]] == key[here]]
        p, own = at[here], own[here]
        touch = p[1:] == after[p[:-1]]
        same = np.r_[False, touch & (own[1:] == own[:-1])]
        order = 2 * own
        if same.any():
            number = np.arange(len(p))
            order = order + (number - np.maximum.accumulate(np.where(same, 0, number)) & 1).astype(np.int32)
        good = np.ones(len(p), bool)
        good[1:] &= ~(touch & (order[:-1] < order[1:]))
        good[:-1] &= ~(touch & (order[1:] < order[:-1]))
        p, own = p[good], own[good]
        used = np.bincount(own, minlength=len(pairs))
        enough = used >= least
        if not enough.any():
            rare = np.append(rare, pairs[0])  # no better pair overlaps the first, so its uses can't grow
            continue
        keep = enough[own]
        p, own = p[keep], own[keep]
        chosen = pairs[enough]
        rules.append(np.stack((chosen >> half, chosen & low), 1).astype(np.uint32))
        q = after[p]
        seq[p] = (base + n_rules + np.cumsum(enough) - 1).astype(kind)[own]
        n_rules += len(chosen)
        rounds.append(n_rules)
        gone[q] = True
        after[p] = after[q]
        before[after[p]] = p
        live = np.zeros(n + 1, bool)
        live[at] = True
        live[p] = True
        live[before[p]] = True  # -1 is the place n, which is cleared
        live[gone] = False
        live[p[after[p] == n]] = False
        live[n] = False
        at = np.flatnonzero(live)
    stay = ~gone[:n]
    return np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), rounds, seq[:n][stay].astype(np.uint32), (after[:n] == n)[stay]


def _lengths(rules: np.ndarray, after: list[int], base: int) -> np.ndarray:
    out = np.ones(len(rules) + 1, np.int64)  # the final 1 stands for terminals
    begin = 0
    for end in after:
        child = rules[begin:end].astype(np.int64) - base
        out[begin:end] = out[np.where(child < 0, len(rules), child)].sum(1)
        begin = end
    return out[:-1]


def pack(doc_ids: list[int | None], symbols: np.ndarray, sizes: np.ndarray, base: int, dtype: np.dtype, least: int | None = None) -> bytes:
    """The payload of a block: symbols are the ids of its documents in a row, sizes how many each has (one at least)."""
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(sizes) - 1] = True
    rules, after, seq, last = re_pair(symbols, last, base, least)
    dtype = dtype if base + len(rules) <= 1 << 16 else np.dtype("<u4")
    head = _HEAD.pack(b"RPG2", dtype.itemsize, base, len(after), len(rules), len(doc_ids), len(seq))
    keys, missing = np.array([0 if i is None else i for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8)
    parts = (keys, missing, (np.flatnonzero(last) + 1).astype("<u8"), np.array(after, "<u4"), rules.astype(dtype), _lengths(rules, after, base).astype("<u4"), seq.astype(dtype))
    return head + b"".join(p.tobytes() for p in parts)


class Block:
    """A payload, opened: documents decode one by one or all at once."""

    def __init__(self, payload: bytes):
        magic, width, self.base, n_rounds, n_rules, n_docs, n_symbols = _HEAD.unpack_from(payload)
        if magic != b"RPG2":
            raise ValueError("not a grammar block")
        dtype, at, parts = np.dtype(f"<u{width}"), _HEAD.size, []
        for kind, n in (("<i8", n_docs), ("<u1", n_docs), ("<u8", n_docs), ("<u4", n_rounds), (dtype, 2 * n_rules), ("<u4", n_rules), (dtype, n_symbols)):
            kind = np.dtype(kind)
            parts.append(np.frombuffer(payload, kind, n, at))
            at += n * kind.itemsize
        self.keys, self.missing, ends, self.after, rules, self.lengths, self.sequence = parts
        self.ends = ends.astype(np.int64)
        self.rules = rules.reshape(-1, 2)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def doc_ids(self) -> list[int | None]:
        return [None if m else i for i, m in zip(self.keys.tolist(), self.missing.tolist(), strict=True)]

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules written out in a row, and where each begins; a round's rules are written from those of the rounds before."""
        if self._table is None:
            size = self.lengths.astype(np.int64)
            begins = np.cumsum(size) - size
            flat = np.empty(int(size.sum()), np.uint32)
            first = 0
            for end in self.after.tolist():
                to = begins[first:end]
                for side in range(2):
                    child = self.rules[first:end, side].astype(np.int64)
                    ends = child < self.base
                    flat[to[ends]] = child[ends]
                    rule = child[~ends] - self.base
                    flat[_ranges(to[~ends], size[rule])] = flat[_ranges(begins[rule], size[rule])]
                    step = np.ones(len(to), np.int64)
                    step[~ends] = size[rule]
                    to = to + step
                first = end
            self._table = flat, begins
        return self._table

    def decode(self, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents lo..hi in a row, and each one's end among them."""
        hi = len(self.ends) if hi is None else hi
        if hi <= lo:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        first = self.ends[lo - 1] if lo else 0
        part = self.sequence[first : self.ends[hi - 1]].astype(np.int64)
        flat, begins = self._expanded()
        rule = part >= self.base
        size = np.ones(len(part), np.int64)
        size[rule] = self.lengths[part[rule] - self.base]
        source = np.concatenate((flat, part[~rule].astype(np.uint32)))
        begin = np.empty(len(part), np.int64)
        begin[rule] = begins[part[rule] - self.base]
        begin[~rule] = len(flat) + np.arange(int((~rule).sum()))
        return source[_ranges(begin, size)], np.cumsum(size)[self.ends[lo:hi] - first - 1]


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode every whole text (null: empty), append END_ID to each, and write blocks in ascending doc_id order.

    Null doc_ids come first; rows that repeat a doc_id stay, in the order of a hash of their texts.
    Extra columns are ignored. An empty table writes a dataset without blocks.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    @lean
    def run(batches):
        shard, block = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_path)
        keys, ids, sizes, n = [], [], [], 0

        def full():
            payload = pack(keys, np.concatenate(ids), np.concatenate(sizes), enc.base, enc.dtype)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((shard, block, len(keys), n, payload), schema.types, strict=True)], schema=schema)

        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, some, size in encoded(batch.column(1), enc):
                keys += own[first : first + len(size)]
                ids.append(some)
                sizes.append(size)
                n += len(some)
                if n >= BLOCK_TOKENS:
                    yield full()
                    keys, ids, sizes, n, block = [], [], [], 0, block + 1
        if keys:
            yield full()

    rows.mapInArrow(run, "shard int, block int, n_docs long, n_tokens long, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a dataset, decoded from its blocks."""
    blocks = spark.read.schema("shard int, block int, n_docs long, n_tokens long, payload binary").parquet(path)
    totals, before = {}, 0
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("blocks")).orderBy("shard").collect():  # a row a shard
        totals[r.shard] = before
        before += r.n
    places = spark.createDataFrame(list(totals.items()) or [(0, 0)], "shard int, before long")
    w = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", "n_tokens").withColumn("own", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(places, "shard").select("shard", "block", (F.col("before") + F.col("own")).alias("block_start"))

    @lean
    def run(batches):
        for batch in batches:
            for shard, block, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = Block(payload)
                ids, ends = b.decode()
                raw = memoryview(ids.astype("<u4").tobytes())
                begins = np.concatenate(([0], ends[:-1]))
                crcs = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), "doc_id": pa.array(b.doc_ids, pa.int64()), "begin": pa.array(begins, pa.int64()), "n_tokens": pa.array(ends - begins, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    decoded = blocks.select("shard", "block", "payload").mapInArrow(run, "shard int, block int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def read_document_ids(payload: bytes, n: int) -> np.ndarray:
    """Random access: the ids of the n-th document of a block."""
    return Block(payload).decode(n, n + 1)[0]


def token_digest(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write docs as a token dataset (in the shared folder unless a path is given) and describe every document read back from it."""
    path = path or stage_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return read_tokens(docs.sparkSession, path)
