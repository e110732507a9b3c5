"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

The base rules always stand. Further generators propose spans that may overlap; a span is redacted
when the trees' probability reaches its kind's threshold and no base span or likelier span overlaps
it. The trees learn from evidence that their features don't show: checksums and value ranges of
cards, addresses, bank and social security numbers, and, for kinds without any, whether the same
value stands elsewhere in the corpus in a base rule's notation. Candidates without evidence are
scored but not learnt from. The trees are grown on aggregated counts of binned features and applied
as a sum of CASE expressions. Everything runs as DataFrame expressions: every feature cell stays in a
staged table of counts, and only sums per feature and bin (at most 72 bins) and a threshold per kind
reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .spans import Kind, candidates, joined

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "local_phone", "masked_email", "ssn")
#: The precision that thresholds keep on the held-out fold, and the trees' number, depth and rate.
PRECISION, TREES, DEPTH, SHRINK = 0.97, 24, 2, 0.3

_LOCAL = "A-Za-z0-9._%+-"
#: Contract patterns, written so that a run is entered once and never backtracked into.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,5}){2,4}(?![0-9A-Za-z])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot)\x20?[A-Za-z]{2,12}(?![A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
_CUES = {
    1: "mail|e-mail|contact|write to|reach",
    2: "tel|phone|call|fax|mobile|cell|whatsapp",
    3: "card|visa|credit|debit|iban|account|bank",
    4: "ip|host|server|address|addr",
    5: "ssn|social security|tax id",
    6: "version|isbn|order|invoice|page|section|score",
}
FEATURES = ("kind", "digits", "seps", "length", "before", "after", "cue")


def kinds() -> list[Kind]:
    text = F.col("text")
    digit = text.rlike("[0-9]{2}")
    may = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": F.contains(text, F.lit("+")),
        "iban": text.rlike("[A-Z]{2}[0-9]{2}"),
        "local_phone": digit,
        "masked_email": text.rlike(r"[\x20(\[]dot[\x20)\]]"),
        "ssn": text.rlike("[0-9]-[0-9]{2}-[0-9]"),
    }
    return [Kind(k, i, PATTERNS[k], may[k]) for i, k in enumerate((*BASE, *EXTRA))]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_holds(digits: Column) -> Column:
    """The Luhn sum of a digit string is a multiple of ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda total, i: total + F.coalesce(value(i), F.lit(1))) % 10 == 0


def iban_holds(match: Column) -> Column:
    """The number with its first four characters last, letters as 10 to 35, leaves 1 by 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    letters = lambda c: F.ascii(c) - 55
    step = lambda left, c: F.when(c.rlike("[0-9]"), (left * 10 + c.cast("int")) % 97).otherwise((left * 100 + letters(c)) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def is_valid() -> Column:
    """What the rule of a kind says of a match beyond its pattern, on (kind, match); null for kinds without such a rule."""
    m, digits = F.col("match"), _digits(F.col("match"))
    n = F.length(digits)
    octets = F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255))
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "card", n.between(16, 19) & F.when(n.between(16, 19), luhn_holds(digits)).otherwise(False))
        .when(F.col("kind") == "phone", n.between(8, 15))
        .when(F.col("kind") == "ssn", ~m.rlike("^(000|666|9)|-00-|-0000$"))
        .when(F.col("kind") == "iban", iban_holds(m))
    )


def value_key() -> Column:
    """What a phone number or mail address has in common with other notations of it: its last seven digits, or local part and domain."""
    m = F.lower(F.col("match"))
    mail = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, r"\x20?(?:\(at\)|\[at\]|\x20at)\x20?", "@"), r"\x20?(?:\(dot\)|\[dot\]|\x20dot)\x20?", "."), " ", "")
    return F.when(F.col("kind").isin("phone", "local_phone"), F.concat(F.lit("t:"), F.substring(_digits(m), -7, 7))).when(F.col("kind").isin("email", "masked_email"), F.concat(F.lit("m:"), mail))


def evidence_cells(tested: DataFrame) -> DataFrame:
    """f_<feature>..., held, p, n: candidates with evidence for and against them, counted by feature cell and fold.

    tested: featured candidates with valid. A value is counted before it is looked up among the
    base spans' values, so one that very many documents hold is a few rows of that join.
    """
    features = [f"f_{f}" for f in FEATURES]
    fold = (F.pmod(F.xxhash64("rid"), F.lit(4)) == 0).cast("int").alias("held")
    wanted = F.when(F.col("valid").isNull(), value_key()).alias("wanted")
    counted = tested.groupBy(*features, fold, "valid", wanted).agg(F.count("*").alias("times"))
    known = tested.where(F.col("kind").isin("phone", "email") & F.col("valid")).select(value_key().alias("wanted")).distinct().withColumn("known", F.lit(True))
    said = F.coalesce("valid", F.col("known"), F.when(F.col("f_cue") == 6, F.lit(False)))
    told = counted.join(known, "wanted", "left").withColumn("said", said).where("said is not null")
    return told.groupBy(*features, "held").agg(F.sum(F.when(F.col("said"), F.col("times")).otherwise(0)).alias("p"), F.sum(F.when(F.col("said"), 0).otherwise(F.col("times"))).alias("n"))


def featured(found: DataFrame) -> DataFrame:
    """Binned format and context features as small ints."""
    m, digits = F.col("match"), _digits(F.col("match"))
    edge = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike("^[A-Za-z]"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^\s"), 3).otherwise(4)
    cue = F.lit(0)
    for k, words in _CUES.items():
        cue = F.when(F.lower(F.col("before")).rlike(words), k).otherwise(cue)
    return found.select(
        "*",
        F.col("place").alias("f_kind"),
        F.least(F.length(digits), F.lit(24)).alias("f_digits"),
        F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(8)).alias("f_seps"),
        F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("int").alias("f_length"),
        edge(F.substring("before", -1, 1)).alias("f_before"),
        edge(F.substring("after", 1, 1)).alias("f_after"),
        cue.alias("f_cue"),
    )


def grow(cells: DataFrame) -> tuple[float, list]:
    """(bias, trees) of boosted trees with logistic loss over cells (f_<feature>..., p positives, n negatives); a tree is a leaf value or (feature, most, low, high).

    A level of a tree is one aggregate: sums of gradients by node, feature and bin, over every cell.
    """
    p, n = (float(x or 0) for x in cells.agg(F.sum("p"), F.sum("n")).first())
    bias = math.log((p + 1) / (n + 1))
    binned = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"f_{f}").cast("int").alias("v")) for k, f in enumerate(FEATURES)))).alias("bin")

    def sums(trees: list, paths: list[list[tuple[int, int, bool]]]) -> list[dict[int, dict[int, tuple[float, float]]]]:
        """For each node, given by its path of (feature, most, is low): by feature and bin the sums of the gradient and of its derivative."""
        node = F.lit(None).cast("int")
        for k, path in enumerate(paths):
            inside = F.lit(True)
            for f, most, low in path:
                inside = inside & ((F.col(f"f_{FEATURES[f]}") <= most) if low else (F.col(f"f_{FEATURES[f]}") > most))
            node = F.when(inside, F.lit(k)).otherwise(node)
        scored = cells.select("*", probability(bias, trees).alias("q"), node.alias("node"))
        graded = scored.select("node", (F.col("p") * (1 - F.col("q")) - F.col("n") * F.col("q")).alias("g"), ((F.col("p") + F.col("n")) * F.col("q") * (1 - F.col("q"))).alias("h"), binned)
        out = [{f: {} for f in range(len(FEATURES))} for _ in paths]
        for r in graded.where("node is not null").groupBy("node", "bin.f", "bin.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[r.node][r.f][r.v] = (r.g, r.h)
        return out

    def split(by: dict[int, dict[int, tuple[float, float]]]) -> tuple[int, int] | None:
        """The feature and bin of most gain; None where nothing is gained."""
        g, h = (sum(by[0][v][k] for v in sorted(by[0])) for k in (0, 1))
        most, best = 1e-9, None
        for f in range(len(FEATURES)):
            gl = hl = 0.0
            for v in sorted(by[f])[:-1]:
                gl, hl = gl + by[f][v][0], hl + by[f][v][1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > most * (1 + 1e-9) + 1e-12:  # sums come in any order
                    most, best = gain, (f, v)
        return best

    def value(parts) -> float:
        g, h = (sum(x[k] for x in parts) for k in (0, 1))
        return SHRINK * g / (h + 1)

    def level(trees: list, paths: list, depth: int) -> list:
        """The trees below the nodes at the paths, which have cells."""
        found, below, shapes = sums(trees, paths), [], []
        for path, by in zip(paths, found, strict=True):
            cut = split(by)
            shapes.append(cut)
            if cut and depth > 1:
                below += [[*path, (*cut, True)], [*path, (*cut, False)]]
        under = iter(level(trees, below, depth - 1) if below else ())
        out = []
        for by, cut in zip(found, shapes, strict=True):
            if not cut:
                out.append(value(by[0].values()))
                continue
            f, most = cut
            sides = [next(under), next(under)] if depth > 1 else [value([x for v, x in sorted(by[f].items()) if (v <= most) == low]) for low in (True, False)]
            out.append((f, most, *sides))
        return out

    trees: list = []
    for _ in range(TREES if p and n else 0):
        trees += level(trees, [[]], DEPTH)
    return bias, trees


def probability(bias: float, trees: list) -> Column:
    def of(t) -> Column:
        return F.when(F.col(f"f_{FEATURES[t[0]]}") <= t[1], of(t[2])).otherwise(of(t[3])) if isinstance(t, tuple) else F.lit(float(t))

    return 1 / (1 + F.exp(-sum((of(t) for t in trees), F.lit(float(bias)))))


def thresholds(bias: float, trees: list, held: DataFrame) -> dict[int, float]:
    """By kind the least probability from which on the held-out fold, over all its cells, is PRECISION right; a kind that the fold lacks has that of all kinds together, and 1.01 (nothing) stands where none reaches it."""
    scored = held.select(F.col("f_kind").alias("place"), probability(bias, trees).alias("q"), "p", "n")
    scored = scored.unionByName(scored.withColumn("place", F.lit(-1))).groupBy("place", "q").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = Window.partitionBy("place").orderBy(F.desc("q"))
    right = scored.select("place", "q", F.sum("p").over(above).alias("good"), F.sum(F.col("p") + F.col("n")).over(above).alias("all"))  # a row for each kind and sum of leaves
    found = {r.place: 1.01 if r.q is None else r.q for r in right.groupBy("place").agg(F.min(F.when(F.col("good") >= PRECISION * F.col("all"), F.col("q"))).alias("q")).collect()}
    return {place: found.get(place, found.get(-1, 1.01)) for place in range(len(BASE) + len(EXTRA))}


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more (spans the method adds).

    Whole texts; null and empty texts hold nothing (base_sha256 of the empty string). Repeated
    rows are described alike, each on its own; extra columns are ignored; an empty table gives no
    rows. Positions are code points, ends exclusive.
    """
    rows, found = candidates(docs, kinds())
    tested = featured(found).withColumn("valid", is_valid())
    cells = staged(evidence_cells(tested), "cells")
    bias, trees = grow(cells.where("held = 0"))
    cut = thresholds(bias, trees, cells.where("held = 1"))
    least = F.lit(1.01)
    for place, q in cut.items():
        least = F.when(F.col("place") == place, F.lit(q)).otherwise(least)
    is_base = F.col("place") < len(BASE)
    chosen = tested.withColumn("p", probability(bias, trees)).where(F.when(is_base, F.col("valid")).otherwise(F.col("p") >= least - 1e-12))
    span = F.struct("place", "start", "end", "kind", "p")
    per = chosen.groupBy("rid").agg(F.collect_list(F.when(is_base, span)).alias("base"), F.collect_list(F.when(~is_base, span)).alias("more"))  # one text's spans
    over = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    ahead = lambda b, a: (b["p"] > a["p"]) | ((b["p"] == a["p"]) & (F.struct(b["start"], b["place"]) < F.struct(a["start"], a["place"])))
    free = per.select("rid", "base", F.filter("more", lambda a: ~F.exists("base", lambda b: over(a, b))).alias("more"))
    free = free.select("rid", "base", F.filter("more", lambda a: ~F.exists("more", lambda b: over(a, b) & ahead(b, a))).alias("more"))
    out = rows.join(free, "rid", "left")
    none = F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string,p:double>>")
    out = out.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("more", none).alias("more"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    order = ("place", "start")
    return out.select("doc_id", *counts, F.sha2(joined("base", order), 256).alias("base_sha256"), F.concat("base", "more").alias("all"), F.size("more").cast("long").alias("n_more")).select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", joined("all", order).alias("spans"), "n_more")


def _is(kind: str):
    return lambda s: s["kind"] == kind
