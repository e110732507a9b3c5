"""Benchmark decontamination by pigeonhole edit matching.

An item of length m may be met with up to k = floor(rate * m) edits. Cut into k + 1 pieces, at
least one piece then stands unedited in the text: one automaton finds all pieces of all items
exactly, and Myers' bit-parallel distance verifies each hit in a window around its diagonal.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, staged

#: Edits allowed per character; items (normalized) shorter than MIN_CHARS must stand unedited, as words of their own.
RATE, MIN_CHARS = 0.06, 24
#: Characters of items that one automaton may hold; larger benchmarks are matched block by block, a pass over the texts each.
BLOCK_CHARS = 16_000_000
_SPACES = re.compile(r"\s+")


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def edit_distance_within(pattern: str, text: str, most: int, masks: dict[str, int] | None = None) -> int | None:
    """The least edit distance from pattern to any substring of text, or None if above most (Myers 1999)."""
    m = len(pattern)
    if masks is None:
        masks = char_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best if best <= most else None


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """All items of one block: the automaton over their pieces and the masks for verification."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, min_chars: int = MIN_CHARS):
        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        self.min_chars = min_chars
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            s = normalized(text)
            if item_id is None or not s:
                continue
            k = int(rate * len(s)) if len(s) >= min_chars else 0
            cuts = [len(s) * j // (k + 1) for j in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(s[lo:hi], []).append((len(self.items), lo))
            self.items.append((item_id, s, k, char_masks(s)))
        self.machine = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.machine.add_word(p, (len(p), where))
        if pieces:
            self.machine.make_automaton()

    def find(self, text: str | None) -> dict[int, int]:
        """item_id -> least edit distance found, for the items that the text holds within their budget."""
        found: dict[int, int] = {}
        if not self.items or not text:
            return found
        t, tried = normalized(text), set()
        for end, (size, where) in self.machine.iter(t):
            for n, offset in where:
                item_id, s, k, masks = self.items[n]
                if found.get(item_id) == 0:
                    continue
                begin = end + 1 - size - offset
                if len(s) < self.min_chars:
                    if not (t[begin - 1 : begin].isalnum() or t[end + 1 : end + 2].isalnum()):
                        found[item_id] = 0
                    continue
                cell = (n, begin // (k + 1))
                if cell in tried:
                    continue
                tried.add(cell)
                lo = max(0, cell[1] * (k + 1) - k)
                window = t[lo : (cell[1] + 1) * (k + 1) + len(s) + k]
                d = 0 if s in window else edit_distance_within(s, window, k, masks)
                if d is not None and d < found.get(item_id, k + 1):
                    found[item_id] = d
        return found


def _blocks(benchmark: DataFrame):
    """The benchmark's items in blocks of a bounded number of characters."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (ascending), least_distance (null if none).

    Texts and items are compared in lower case with runs of white space as one space, whole
    texts, no prefix. Items that normalize to fewer than min_chars characters are found where they
    stand unedited between characters that are neither letters nor digits; null and empty items are
    never found; null or empty texts hold nothing; repeated rows of documents give repeated rows,
    repeated items count once by item_id. Extra columns are ignored; empty tables are fine.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.array().cast("array<long>").alias("items"), F.lit(None).cast("long").alias("least_distance"))
    types, names = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64()], ["doc_id", "text", "items", "least_distance"]
    sc = docs.sparkSession.sparkContext
    for n, block in enumerate(_blocks(benchmark)):
        items = sc.broadcast(block)

        @lean
        def run(batches, items=items):
            matcher = Matcher(items.value, rate, min_chars)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    rows = []
                    for i, text, known, least in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        hit = matcher.find(text)
                        rows.append((i, text, sorted({*known, *hit}), min((*hit.values(), *([] if least is None else [least])), default=None)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        found = (staged(found, "blocks") if n else found).mapInArrow(run, "doc_id long, text string, items array<long>, least_distance long")
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items", "least_distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs that hold no item, with docs's own columns, in one pass over the texts for each block of items.

    Rows with null or empty texts and null doc_ids stay, repeated rows stay or go together, texts are
    read whole whatever their length, and further columns may have any names. An empty table gives
    none, an empty benchmark drops nothing.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index("text")
    kept = docs
    for n, block in enumerate(_blocks(benchmark)):
        items = sc.broadcast(block)

        @lean
        def run(batches, items=items):
            matcher = Matcher(items.value, rate, min_chars)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(at).cast(pa.string()).to_pylist()], pa.bool_()))

        kept = (staged(kept, "blocks") if n else kept).mapInArrow(run, docs.schema)
    return kept
