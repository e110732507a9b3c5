"""Positions of regular-expression matches, found with SQL functions alone.

A row's matches and the pieces between them come from regexp_extract_all and split, which walk the
same matches; running sums of their lengths give code-point positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CONTEXT = 28


@dataclass(frozen=True)
class Kind:
    """name, place in orderings, Java pattern (never empty matches), and a cheap necessary condition."""

    name: str
    place: int
    pattern: str
    may_hold: Column


def candidates(docs: DataFrame, kinds: list[Kind], keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows has (rid, doc_id, *keep) for every row of docs; found has (rid, doc_id, *keep, kind, place, start, end, match, before, after).

    Texts are read once, whole; both tables come from one staged table without texts. Null texts hold nothing.
    """
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    per_kind = []
    for k in kinds:
        found = F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))
        pieces = F.split("text", k.pattern, -1)
        cells = F.transform(
            F.arrays_zip(pieces.alias("piece"), found.alias("match")),
            lambda z: F.struct(
                F.length(z["piece"]).alias("gap"),
                z["match"].alias("match"),
                F.substring(z["piece"], -CONTEXT, CONTEXT).alias("tail"),
                F.substring(z["piece"], 1, CONTEXT).alias("head"),
            ),
        )
        per_kind.append(F.when(k.may_hold, cells).alias(k.name))
    wide = base.select("rid", "doc_id", *keep, *per_kind)
    wide = staged(wide.select("rid", "doc_id", *keep, *(F.when(F.size(k.name) > 1, F.col(k.name)).alias(k.name) for k in kinds)), "candidates")
    rows = wide.select("rid", "doc_id", *keep)
    tagged = F.array_compact(F.array(*(F.when(F.col(k.name).isNotNull(), F.struct(F.lit(k.name).alias("kind"), F.lit(k.place).alias("place"), F.col(k.name).alias("cells"))) for k in kinds)))
    lists = wide.select("rid", "doc_id", *keep, F.explode(tagged).alias("k")).select("rid", "doc_id", *keep, "k.kind", "k.place", F.posexplode("k.cells").alias("i", "c"))
    w = Window.partitionBy("rid", "kind").orderBy("i")
    own = F.coalesce(F.length("c.match"), F.lit(0))
    placed = lists.withColumn("start", F.sum(F.col("c.gap") + own).over(w) - own).withColumn("after", F.lead("c.head").over(w)).where("c.match is not null")
    found = placed.select("rid", "doc_id", *keep, "kind", "place", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("c.match")).cast("long").alias("end"), F.col("c.match").alias("match"), F.col("c.tail").alias("before"), "after")
    return rows, found


def joined(spans: str, order: tuple[str, str]) -> Column:
    """kind:start:end, comma-joined, of an array of (place, start, kind, end) sorted by the two named fields."""
    a, b = order
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s[a].cast("long").alias("x"), s[b].cast("long").alias("y"), s["end"].alias("end"), s["kind"].alias("kind"), s["start"].alias("start"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
