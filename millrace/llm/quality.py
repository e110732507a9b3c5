"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every token class has a fixed sparse random index vector; a token's vector is the sum of the index
vectors met around it over the whole corpus, added up per task and then per vector block. Documents
are the means of their tokens' vectors; a numpy network with one hidden layer is trained on a
bounded sample of labelled rows and its probabilities are calibrated by a temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, lean, small_batches
from .shingles import _BASE, _BYTE, _INVERSE, _powers, mix

#: Token cells, vector length, entries of an index vector, and tokens to either side that count as context.
CELLS, DIM, ENTRIES, REACH = 1 << 12, 32, 2, 2
#: The most labelled rows the network is trained on, its hidden units and passes.
TRAIN_ROWS, HIDDEN, PASSES = 10_000, 24, 400
_BLOCKS = 16
_CHUNK = 1 << 18
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_WIDTH = DIM + 3
_rng = np.random.Generator(np.random.PCG64(7))
_PLACE = _rng.integers(0, DIM, (CELLS, ENTRIES))
_SIGN = _rng.choice([-1.0, 1.0], (CELLS, ENTRIES))


def _tokens(texts: list[str | None]):
    """(cells, document numbers) of the runs of one character class, for texts in bounded chunks."""
    at = 0
    while at < len(texts):
        blobs, size, first = [], 0, at
        while at < len(texts) and (not blobs or size < _CHUNK):
            blobs.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            size += len(blobs[-1]) + 1
            at += 1
        b = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
        kind = _CLASS[b]
        edge = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(b)]))
        start, end = edge[:-1], edge[1:]
        real = kind[start] > 0
        start, end = start[real], end[real]
        total = np.empty(len(b) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[b] * _powers(_BASE, len(b)), out=total[1:])
        h = mix((total[end] - total[start]) * _powers(_INVERSE, len(b))[start])
        doc = np.searchsorted(np.cumsum([len(x) + 1 for x in blobs]), start, side="right")
        yield first, len(blobs), (h >> np.uint64(52)).astype(np.int64), doc


def word_vectors(docs: DataFrame) -> np.ndarray:
    """CELLS x DIM context sums over every text of docs, each row scaled to length one."""

    @lean
    def run(batches):
        total = np.zeros(CELLS * DIM)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                for _, _, cell, doc in _tokens(batch.column(0).slice(at, 2000).to_pylist()):
                    for o in range(1, REACH + 1):
                        same = doc[o:] == doc[:-o]
                        left, right = cell[:-o][same], cell[o:][same]
                        for x, y in ((left, right), (right, left)):
                            for k in range(ENTRIES):
                                total += np.bincount(x * DIM + _PLACE[y, k], weights=_SIGN[y, k], minlength=CELLS * DIM)
        parts = total.astype(np.float32).reshape(_BLOCKS, -1)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(_BLOCKS), pa.int32()), "sums": pa.array([p.tobytes() for p in parts], pa.binary())})

    @lean
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(s, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "sums": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    rows = docs.select("text").mapInArrow(run, "block int, sums binary").repartition(_BLOCKS, "block").mapInArrow(add, "block int, sums binary").collect()
    whole = np.zeros((_BLOCKS, CELLS * DIM // _BLOCKS))
    for r in rows:
        whole[r.block] += np.frombuffer(r.sums, np.float64)
    whole = whole.reshape(CELLS, DIM)
    return whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean token vector, its length, log of the tokens, and the mean agreement of neighbours."""
    out = np.zeros((len(texts), _WIDTH))
    for first, n, cell, doc in _tokens(texts):
        count = np.bincount(doc, minlength=n).astype(float)
        safe = np.maximum(count, 1)
        own = out[first : first + n]
        v = vectors[cell]
        begin = np.searchsorted(doc, np.arange(n))
        has = count > 0
        if has.any():
            own[has, :DIM] = np.add.reduceat(v, begin[has], axis=0) / safe[has, None]
            near = np.einsum("ij,ij->i", v[1:], v[:-1]) * (doc[1:] == doc[:-1])
            own[:, DIM + 2] = np.bincount(doc[1:], weights=near, minlength=n) / safe
        own[:, DIM] = np.linalg.norm(own[:, :DIM], axis=1)
        own[:, DIM + 1] = np.log1p(count)
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(texts, self.vectors)) / self.temperature, -30, 30)))


def _train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Full-batch Adam on the logistic loss."""
    rng = np.random.Generator(np.random.PCG64(11))
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, PASSES + 1):
        h = np.tanh(x @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y) / len(y)
        gh = g[:, None] * p[2] * (1 - h * h)
        for i, d in enumerate((x.T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()]))):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.999 * s[i] + 0.001 * d * d
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss, on a grid from 1/4 to 8."""
    grid = 2.0 ** np.arange(-2, 3.01, 0.05)
    loss = [np.logaddexp(0, np.where(y > 0, -z, z) / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Vectors from every text; the network from at most about `rows` labelled documents, chosen by a hash of doc_id, whose crc32 fold isn't 0.

    A fifth of these only calibrates the temperature. Null labels are ignored, of several labels of
    one doc_id the least counts. With no labelled rows every score is one half.
    """
    small_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).where(crc32_mod("doc_id", 5) != 0)
    step = max(1, -(-known.count() // rows))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).limit(2 * rows)
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")
    shared = train.sparkSession.sparkContext.broadcast(vectors)

    @lean
    def run(batches):
        for batch in batches:
            x = pooled(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(1), "x": pa.array(list(x), pa.list_(pa.float64()))})

    got = train.mapInArrow(run, "doc_id long, y int, x array<double>").orderBy("doc_id", "y").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, _WIDTH)
    y = (np.array(got["y"].to_pylist(), float) > 0).astype(float)
    if not len(y):
        return QualityModel(vectors, np.zeros(_WIDTH), np.ones(_WIDTH), (np.zeros((_WIDTH, 1)), np.zeros(1), np.zeros(1), 0.0), 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.ones(len(y), bool)
    fit_on = ~held if len(y) >= 50 else held
    layers = _train((x[fit_on] - mean) / scale, y[fit_on])
    model = QualityModel(vectors, mean, scale, layers, 1.0)
    model.temperature = _temperature(model.logits(x[held]), y[held])
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Whole texts; null and empty texts are scored as a document without tokens. Extra columns are
    ignored, repeated rows are scored alike, an empty table gives no rows, a null doc_id is kept with
    a null held_out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(shared.value.scores(part.column(1).to_pylist()))})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
