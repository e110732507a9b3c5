"""Soft-membership mixing to target weights.

A multinomial classifier fitted on a labelled table predicts each document's domain posterior.
Document rates r >= floor then solve

    min_r  sum_k ((A r)_k - T_k)^2 / (2 S_k) + RIDGE sum_d n_d (r_d - r0)^2 / 2

where n_d are word tokens, (A r)_k = sum_d n_d p_dk r_d, T_k the target token totals, S_k the totals
at rate 1 and r0 the larger of 1 and the floor. At the optimum r_d = max(floor, r0 - sum_k p_dk y_k)
with RIDGE S_k y_k = (A r)_k - T_k, so the K numbers y are sought, by Newton steps on the concave
dual with a line search. A step needs A r and a K x K matrix, which one aggregate gives; the rates
are one expression of the posteriors that doesn't grow. Steps end when the gradient, the distance of
the totals to those of the optimum, is within TOLERANCE; totals that stay off their target are
named in a warning. All of it over the table is DataFrame expressions.
"""

from __future__ import annotations

import math
import warnings

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: The most labelled rows the classifier is fitted on, its vocabulary, and the most distinct domains.
TRAIN_ROWS, VOCABULARY, MOST_DOMAINS = 4_000, 768, 256
TOLERANCE, RIDGE = 1e-6, 1e-9
_CELLS = 1 << 12


def _words(text: Column) -> Column:
    """Words between the six ASCII white-space characters (empty strings may remain at the ends)."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "), " ")


def _list(values: list[float]) -> Column:
    """A constant array of any length as one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


class DomainModel:
    """Domains, log priors, and the vocabulary: log weights by word, and the cell that a word's hash gives it."""

    def __init__(self, domains: list[str], priors: list[float], weights: dict[str, list[float]], cells: dict[str, int]):
        self.domains, self.priors, self.weights, self.cells = domains, priors, weights, cells

    def vocabulary(self) -> Column:
        return F.split(F.lit(" ".join(self.weights) or "\x00"), " ")

    def table(self, k: int) -> Column:
        """The k-th domain's log weights by cell."""
        cells = [0.0] * _CELLS
        for w, x in self.weights.items():
            cells[self.cells[w]] = x[k]
        return _list(cells)


def _cell(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(_CELLS)).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS) -> DomainModel:
    """A Bernoulli-style naive Bayes over the most informative words of at most about `rows` labelled documents.

    labelled: (doc_id, domain). Null domains are ignored; a doc_id with several domains counts for
    its least. Without labelled rows there is one domain that holds everything.
    """
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("domain"))
    step = max(1, -(-known.count() // rows))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).limit(2 * rows)
    train = staged(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("domain", F.array_distinct(_words(F.col("text"))).alias("words")), "labelled")
    totals = train.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(MOST_DOMAINS + 1).collect()
    if len(totals) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    if not totals:
        return DomainModel(["all"], [0.0], {}, {})
    totals.sort(key=lambda r: r.domain)
    domains, n = [r.domain for r in totals], {r.domain: r.n for r in totals}
    everything = sum(n.values())
    counts = train.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy("word", "domain").agg(F.count("*").alias("n"))
    by_word = counts.groupBy("word").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("domain", "n"))).alias("by"))  # a pair a domain at most
    rate = [(F.coalesce(F.col("by")[d], F.lit(0)) + 0.5) / (n[d] + 1.0) for d in domains]
    overall = (F.col("all") + 0.5) / (everything + 1.0)
    gain = sum((F.abs(F.log(r / overall)) * r * (n[d] / everything) for d, r in zip(domains, rate, strict=True)), F.lit(0.0))
    top = by_word.where("all >= 3").select("word", _cell(F.col("word")).alias("cell"), F.array(*(F.log(r) for r in rate)).alias("w"), gain.alias("gain")).orderBy(F.desc("gain"), "word").limit(VOCABULARY).collect()
    first: dict[int, str] = {}
    for r in top:
        first.setdefault(r.cell, r.word)
    chosen = [r for r in top if first[r.cell] == r.word]
    return DomainModel(domains, [math.log(n[d] / everything) for d in domains], {r.word: [x - max(r.w) for x in r.w] for r in chosen}, {r.word: r.cell for r in chosen})


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n_tokens (words), posterior array<double> for every row of docs, whole texts.

    Null and empty texts: no tokens and the prior as posterior. Extra columns are ignored.
    """
    k = len(model.domains)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text").cast("string")).alias("words"))
    seen = words.select("doc_id", (F.size("words") - F.coalesce(F.size(F.filter("words", lambda w: w == "")), F.lit(0))).cast("long").alias("n_tokens"), F.array_intersect("words", model.vocabulary()).alias("seen"))
    at = seen.select("doc_id", "n_tokens", F.transform("seen", lambda w: _cell(w) + 1).alias("at"))
    columns = [model.table(j) for j in range(k)]

    def log_joint(j: int) -> Column:
        return F.aggregate("at", F.lit(float(model.priors[j])), lambda total, i: total + F.element_at(columns[j], i))

    logs = [log_joint(j) for j in range(k)]
    scored = at.select("doc_id", "n_tokens", F.array(*logs).alias("logs"))
    raised = scored.select("doc_id", "n_tokens", F.transform("logs", lambda x: F.exp(F.greatest(x - F.array_max("logs"), F.lit(-60.0)))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return raised.select("doc_id", "n_tokens", F.transform("e", lambda x: x / total).alias("posterior"))


def solve_rates(members: DataFrame, k: int, weights: list[float], budget: float | None = None, floor: float = 0.0) -> tuple[DataFrame, list[list[float]]]:
    """members with column rate, and the domain token totals at the start and after every step.

    Every step is one aggregate over the (staged) table; K x K numbers reach the driver. Steps end
    when the totals are within TOLERANCE of the optimum's, as parts of the domains' totals at rate 1.
    Where no rates reach the targets, or floating point ends the steps before that, a warning gives
    the distance. budget: the total of the targets, in tokens; by default the least at which no
    domain must shrink.
    """
    members = staged(members, "members")
    p = [F.col("posterior")[j] for j in range(k)]
    start = max(1.0, floor)

    def state(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, the K x K matrix over the documents above the floor, and the documents' part of the dual, at y."""
        if not y.any():
            rate, pull = F.lit(start), F.lit(0.0)
        else:
            pull = F.aggregate(F.zip_with("posterior", _list(list(y)), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
            rate = F.greatest(F.lit(float(floor)), F.lit(start) - F.col("pull"))
        rated = members.select("posterior", "n_tokens", pull.alias("pull")).withColumn("rate", rate)
        value = F.col("n_tokens") * ((F.col("rate") - start) ** 2 / 2 + F.col("pull") * F.col("rate"))
        free = F.col("rate") > floor if y.any() else F.lit(True)
        rows = rated.select("posterior", "n_tokens", "rate", value.alias("value"), free.alias("free"), F.posexplode("posterior").alias("at", "x"))
        mass = F.col("n_tokens") * F.col("x")
        sums = [F.sum(mass * F.col("rate")).alias("total"), F.sum("value").alias("value"), *(F.sum(F.when(F.col("free"), mass * p[j]).otherwise(0.0)).alias(f"h{j}") for j in range(k))]
        total, matrix, worth = np.zeros(k), np.zeros((k, k)), 0.0
        for r in rows.groupBy("at").agg(*sums).collect():
            total[r["at"]] = r["total"] or 0.0
            matrix[r["at"]] = [r[f"h{j}"] or 0.0 for j in range(k)]
            worth = (r["value"] or 0.0) if r["at"] == 0 else worth
        return total, matrix, worth

    y = np.zeros(k)
    now, matrix, worth = state(y)
    have = now / start
    held = have > 0
    share = [max(0.0, w) / (sum(max(0.0, x) for x in weights) or 1.0) for w in weights]
    if budget is None:
        budget = max((h / s for h, s in zip(have, share, strict=True) if s > 0), default=0.0)
    target = np.array([budget * s for s in share])
    unit = np.where(held, have, 1.0)

    def gradient(y: np.ndarray, now: np.ndarray) -> np.ndarray:
        return np.where(held, now - target - RIDGE * have * y, 0.0)

    def dual(y: np.ndarray, worth: float) -> float:
        return worth - float(target[held] @ y[held]) - RIDGE / 2 * float((have * y) @ y)

    trace, g, best = [now.tolist()], gradient(y, now), dual(y, worth)
    while (np.abs(g) / unit).max(initial=0.0) > TOLERANCE:
        scale = 1 / np.sqrt(unit)
        curved = scale[:, None] * (matrix + matrix.T) / 2 * scale + RIDGE * np.eye(k)
        step = scale * np.linalg.solve(curved, scale * g)
        slope, part = float(g @ step), 1.0
        while part > 1e-9:
            after = y + part * step
            now, matrix, worth = state(after)
            found, reached = gradient(after, now), dual(after, worth)
            # near the optimum the dual is flat to rounding, but its gradient is not
            if reached >= best + 1e-4 * part * slope or (reached >= best - 1e-12 * abs(best) and (np.abs(found) / unit).max() < (np.abs(g) / unit).max()):
                break
            part /= 2
        else:
            now, matrix, worth = state(y)
            break
        y, g, best = after, found, reached
        trace.append(now.tolist())
    off = np.where(held, np.abs(now - target), target) / unit
    if off.max(initial=0.0) > 10 * TOLERANCE:
        worst = int(off.argmax())
        warnings.warn(f"mixing: the tokens of domain number {worst} are {now[worst]:.6g}, its target is {target[worst]:.6g}; the optimum is {(np.abs(g) / unit).max():.3g} of a domain away", stacklevel=2)
    pulls = F.aggregate(F.zip_with("posterior", _list(list(y)), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return members.withColumn("rate", F.greatest(F.lit(float(floor)), F.lit(start) - pulls)), trace


def tempered(have: list[float], power: float = 0.7) -> list[float]:
    """Target weights between the corpus's own shares (power 1) and equal ones (power 0)."""
    raised = [h**power if h > 0 else 0.0 for h in have]
    return [r / (sum(raised) or 1.0) for r in raised]


def copies_of(rate: Column, *keys: str) -> Column:
    """A rate rounded up or down by a hash of the keys, so that the expected count is the rate."""
    u = F.pmod(F.xxhash64(*keys, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, floor: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior, rate, copies: one row per row of docs.

    weights: target token share by domain (those not named: 0); by default tempered shares. Null
    and empty texts have no tokens: they move no total and get the rate of their prior posterior.
    Repeated rows get equal rates. An empty table gives no rows. Extra columns are ignored.
    """
    model = fit_domains(docs, labelled)
    members = staged(memberships(docs, model), "posteriors")
    k = len(model.domains)
    if weights is None:
        have = members.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col("posterior")[j]), F.lit(0.0)).alias(f"s{j}") for j in range(k))).first()
        aims = tempered([float(x) for x in have])
    else:
        aims = [weights.get(d, 0.0) for d in model.domains]
    rated, _ = solve_rates(members, k, aims, budget, floor)
    best = F.element_at(F.split(F.lit("\x00".join(model.domains)), "\x00"), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    return rated.select("doc_id", "n_tokens", best.alias("domain"), "posterior", "rate").withColumn("copies", copies_of(F.col("rate"), "doc_id"))


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the registered query: the language of those documents that `labels` covers."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def repeat_to_rates(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs with every row repeated as often as its copies say; the floor of 1 keeps each at least once.

    Rows with a null doc_id are rated like others; null and empty texts have no tokens and the rate
    of their prior posterior. Rows that repeat a doc_id get the most copies of any of them. Ties
    between domains don't matter: rates follow the posteriors. Texts count whole, further columns may
    have any names, and an empty table gives none.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # no clash with names of our own
    plain, key = docs.toDF(*names), names[docs.columns.index("doc_id")]
    rates = mix(docs.select("doc_id", "text"), labelled, floor=1.0).groupBy("doc_id").agg(F.max("copies").alias("copies"))
    joined = plain.join(rates, F.col(key).cast("long").eqNullSafe(F.col("doc_id")), "left")
    times = F.explode(F.array_repeat(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))).alias("time")
    return joined.select(*names, times).select(*names).toDF(*docs.columns)
