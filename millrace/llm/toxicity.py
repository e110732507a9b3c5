"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into classes (insult, threat, target, negation, reporting verb)
with weights; three grammar transducers (negation, reported speech, target) are composed with it
and rewrite each insult or threat by the clause it stands in. A document is scored by what its
clauses match, not by isolated words: a negated or quoted insult and one aimed at somebody are
different symbols with weights of their own. Lexical arcs and the weights of the symbols are
fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, lean, small_batches

#: The most labelled rows that the fit looks at, lexical arcs that it keeps, and frequent word beginnings of toxic rows that it weighs for them.
TRAIN_ROWS, LEXICON, STEMS = 8_000, 500, 30_000
_SEEDS = {
    "insult": "idiot moron imbecile scumbag bastard loser dumbass jackass halfwit degenerate",
    "threat": "kill murder strangle stab behead lynch exterminate",
}
_CLASSES = {
    "target": "you your yours yourself u ur he she him her they them their this that these those "
    "tú tu tus usted ustedes él ella ellos ellas este esta estos estas ese esa du dich dir dein deine ihr euch sie er ihm ihn diese dieser dieses toi tu te ton ta tes vous votre vos il elle ils elles ce cet cette ces",
    "negation": "not no never neither nor without hardly isn't aren't wasn't don't doesn't didn't won't "
    "nunca jamás ni sin tampoco ningún ninguna nicht kein keine keinen keiner nie niemals ohne weder noch ne pas jamais aucun aucune sans",
    "report": "said says say told tells wrote writes claimed claims quoted quotes alleged reported reportedly according called "
    "dijo dice dicen escribió afirmó según citó sagte sagt schrieb schreibt behauptete laut zitierte dit disait écrit écrivit affirma selon cita",
}
_HITS = ("insult", "threat")
_FORMS = ("bare", "aimed", "negated", "reported")
_CLAUSE_END = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Transducer:
    """A sequential transducer over class symbols; arcs not listed copy their symbol and follow otherwise."""

    start: object = 0
    arcs: dict = field(default_factory=dict)  # (state, symbol) -> (output, weight, state)
    otherwise: dict = field(default_factory=dict)  # state -> state

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (symbol, 0.0, self.otherwise.get(state, state))

    def __call__(self, symbols: Iterable[str]) -> Iterator[tuple[str, float]]:
        state = self.start
        for s in symbols:
            out, weight, state = self.step(state, s)
            yield out, weight


def compose(a: Transducer, b: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that feeds a's output to b; only state pairs that can be reached are built."""
    alphabet = list(alphabet)
    made, todo, seen = Transducer((a.start, b.start)), [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        x, y = state = todo.pop()
        for s in alphabet:
            mid, w, x2 = a.step(x, s)
            out, v, y2 = b.step(y, mid)
            made.arcs[state, s] = (out, w + v, (x2, y2))
            if (x2, y2) not in seen:
                seen.add((x2, y2))
                todo.append((x2, y2))
    return made


def _scope(trigger: str, form: str, reach: int | None, symbols: Iterable[str]) -> Transducer:
    """After a trigger, hits become form:hit; for reach further words, or to the clause's end."""
    t = Transducer()
    last = reach if reach is not None else 1
    for state in range(last + 1):
        t.otherwise[state] = max(0, state - 1) if reach is not None else state
        t.arcs[state, trigger] = (trigger, 0.0, last)
        if state:
            for s in symbols:
                t.arcs[state, s] = (f"{form}:{s}", 0.0, t.otherwise[state])
    return t


def grammar() -> Transducer:
    """Negation, then reported speech, then target; what an earlier one has rewritten the later ones leave."""
    alphabet = [*_HITS, *_CLASSES, "other"]
    full = compose(_scope("negation", "negated", 3, _HITS), _scope("report", "reported", None, _HITS), alphabet)
    return compose(full, _scope("target", "aimed", 4, _HITS), alphabet)


_GRAMMAR = grammar()
_WORD_CLASS = {w: c for c, ws in _CLASSES.items() for w in ws.split()}


class Lexicon:
    """The lexical transducer: whole words and word beginnings (written with a final *) with weights, found in a text by one automaton."""

    def __init__(self, learned: dict[str, float]):
        self.entries = {w: (c, 1.0) for c, ws in _SEEDS.items() for w in ws.split()}
        self.entries |= {w: ("insult", x) for w, x in learned.items()}
        self.machine = ahocorasick.Automaton()
        for w in self.entries:
            key = w.rstrip("*")
            self.machine.add_word(key, (*(self.machine.get(key) if key in self.machine else ()), w))
        self.machine.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[str, float]]:
        """Word start -> class and the greatest weight among the entries that match there."""
        found: dict[int, tuple[str, float]] = {}
        for end, words in self.machine.iter(text):
            for w in words:
                at = end + 1 - len(w.rstrip("*"))
                if at and text[at - 1].isalpha() or w[-1] != "*" and text[end + 1 : end + 2].isalpha():
                    continue
                kind, weight = self.entries[w]
                if at not in found or weight > found[at][1]:
                    found[at] = (kind, weight)
        return found

    def clauses(self, text: str) -> Counter:
        """Total weight by form and class over the clauses that hold a hit."""
        hits, total, done = self.hits(text), Counter(), -1
        ends = [m.start() for m in _CLAUSE_END.finditer(text)] if hits else []
        for at in sorted(hits):
            if at < done:
                continue
            n = bisect_left(ends, at)
            begin = ends[n - 1] + 1 if n else 0
            done = ends[n] if n < len(ends) else len(text)
            words = [(m.start(), m.group()) for m in _WORD.finditer(text, begin, done)]
            symbols = [hits[s][0] if s in hits else _WORD_CLASS.get(w, "other") for s, w in words]
            for (s, _), (out, weight) in zip(words, _GRAMMAR(symbols), strict=True):
                if s in hits:
                    form, _, kind = out.rpartition(":")
                    total[form or "bare", kind] += hits[s][1] + weight
        return total

    def features(self, text: str) -> list[float]:
        total = self.clauses(text.lower())
        row = [math.log1p(total[f, k]) for f in _FORMS for k in _HITS]
        return [*row, sum(total.values()) / math.sqrt(len(text) / 100 + 1)]


@dataclass
class ToxicityModel:
    """What the fit gives: lexical arcs, and a logistic weighting of the matched forms."""

    lexicon: dict[str, float]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], lexicon: Lexicon | None = None) -> np.ndarray:
        lex = lexicon or Lexicon(self.lexicon)
        x = np.array([lex.features(t or "") for t in texts], float).reshape(len(texts), len(self.weights))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _stems(text: str) -> set[str]:
    found = set(_LETTERS.findall(text.lower()))
    return {w for w in found if 2 < len(w) < 40} | {w[:k] + "*" for w in found for k in range(4, 9) if len(w) > k}


def _counted(rows: DataFrame, keep: dict[str, int] | None = None) -> DataFrame:
    @lean
    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0).to_pylist():
                seen.update(_stems(t or "") if keep is None else _stems(t or "") & keep.keys())
            if seen:
                yield pa.RecordBatch.from_pydict({"stem": pa.array(list(seen)), "n": pa.array(list(seen.values()), pa.int64())})

    return rows.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method for ridge logistic regression."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge * max(1, len(x)) / 100)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen + 1e-9), a.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most about `rows` labelled documents, chosen by a hash of doc_id, whose crc32 fold isn't 2.

    Labels that are null are ignored; if one doc_id has several, the greatest counts. Without
    labelled rows of both kinds, the seed words alone score.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.where(crc32_mod("doc_id", 4) != 2)
    step = max(1, -(-known.count() // rows))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).limit(2 * rows)
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y").persist()
    try:
        totals = {int(r.y > 0): r.n for r in train.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
        p, n = totals.get(1, 0), totals.get(0, 0)
        learned: dict[str, float] = {}
        if p and n:
            pos = {r.stem: r.n for r in _counted(train.where("y > 0")).where(F.col("n") >= max(3, p // 200)).orderBy(F.desc("n"), "stem").limit(STEMS).collect()}
            neg = {r.stem: r.n for r in _counted(train.where("y <= 0"), pos).collect()}
            odds = {s: math.log((k + 0.5) / (p + 1) / ((neg.get(s, 0) + 0.5) / (n + 1))) for s, k in pos.items()}
            ranked = sorted((s for s in odds if odds[s] >= 2.5), key=lambda s: (-odds[s] * math.sqrt(pos[s]), -len(s.rstrip("*")), s))
            for s in ranked:
                stem = s.rstrip("*")
                if not any(stem[:k] + "*" in learned for k in range(4, len(stem) + 1)):
                    learned[s] = odds[s]
                    if len(learned) == LEXICON:
                        break
        lexicon = train.sparkSession.sparkContext.broadcast(learned)

        @lean
        def run(batches):
            lex = Lexicon(lexicon.value)
            for batch in batches:
                texts, y = batch.column(0).to_pylist(), batch.column(1)
                yield pa.RecordBatch.from_pydict({"x": pa.array([lex.features(t or "") for t in texts], pa.list_(pa.float64())), "y": y})

        got = train.mapInArrow(run, "x array<double>, y int").toArrow()
    finally:
        train.unpersist()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(_FORMS) * len(_HITS) + 1)
    y = (np.array(got["y"].to_pylist(), float) > 0).astype(float)
    if not (p and n):
        return ToxicityModel(learned, np.ones(x.shape[1]), -2.0)
    return ToxicityModel(learned, *_logistic(x, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Reads whole texts; null and empty texts are scored like a text without matches. Extra
    columns are ignored, repeated rows are scored alike, an empty table gives no rows; a null
    doc_id is kept with a null held_out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        m = shared.value
        lex = Lexicon(m.lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(m.scores(part.column(1).to_pylist(), lex))})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the score doesn't reject, with docs's own columns, in one pass over the texts.

    Null and empty texts are scored like a text without matches, repeated rows stay or go together,
    rows with a null doc_id are scored like others, texts are read whole whatever their length, and
    further columns may have any names. An empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    @lean
    def run(batches):
        m = model.value
        lex = Lexicon(m.lexicon)
        for batch in batches:
            keep = m.scores(batch.column(at).cast(pa.string()).to_pylist(), lex) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
