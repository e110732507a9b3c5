"""Secret scanning with corpus-wide ownership frequency.

Candidate values are hashed and counted over the whole corpus by distinct repositories (documents)
and owners (sources): a value that many owners hold is a copied example, one that stays with its
owner looks live. Base rules always stand; further patterns count only where their value is
owner-specific. DataFrame expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .spans import Kind, candidates, joined

BASE = ("assign", "access", "hex")
EXTRA = ("key_block", "named", "prefixed")
#: A value with more distinct owners than this is a widely copied example.
FEW_OWNERS = 2
#: Repositories from which on a value may be hot: then it is joined by broadcast if it also holds a thousandth of all (value, repository) pairs, so that there are at most a thousand such values.
HOT_REPOS = 1_000

_NAME = r"(?i:password|passwd|secret|token|api_?key)"
PATTERNS = {
    "assign": rf"""{_NAME}["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
    "key_block": r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----",
    "named": r"""(?i:auth|credential|private_key|access_key|client_key|pwd|bearer)["']?\x20{0,4}[:=]\x20{0,4}["'][A-Za-z0-9+/_.=-]{12,}+["']""",
    "prefixed": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{20,}+|sk_live_[A-Za-z0-9]{16,}+|xox[abpr]-[A-Za-z0-9-]{16,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)",
}


def kinds() -> list[Kind]:
    text = F.col("text")
    may = {
        "assign": text.rlike(rf"""{_NAME}["']?\x20*[:=]"""),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{32}"),
        "key_block": F.contains(text, F.lit("PRIVATE KEY-----")),
        "named": text.rlike(r"""[:=]\x20{0,4}["']"""),
        "prefixed": text.rlike("gh[pousr]_|sk_live_|xox[abpr]-|eyJ"),
    }
    return [Kind(k, i, PATTERNS[k], may[k]) for i, k in enumerate((*BASE, *EXTRA))]


def _value() -> Column:
    """What of a match is the secret itself."""
    return F.when(F.col("kind").isin("assign", "named"), F.regexp_extract("match", r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)["']?$""", 1)).otherwise(F.col("match"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners of every candidate value: distinct pairs first, so that a hot value is spread by its repositories."""
    pairs = found.select("hash", "repo", "owner").distinct()
    repos = pairs.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    owners = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "hash")


def with_ownership(found: DataFrame) -> DataFrame:
    """found with n_repos and n_owners of its hash; no hot value lands in one task."""
    owned = staged(ownership(found), "owned")
    every = owned.agg(F.sum("n_repos")).first()[0] or 0
    hot = F.broadcast(owned.where(F.col("n_repos") >= max(HOT_REPOS, every // 1_000)))
    if hot.isEmpty():
        return found.join(owned, "hash")
    return found.join(hot, "hash").unionByName(found.join(hot, "hash", "left_anti").join(owned, "hash"))


def find_secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_more.

    A repository is a document, its owner the named column; a null owner is an owner of its own.
    Whole texts; null and empty texts hold nothing. Repeated rows are described each on its own and
    count as one repository; extra columns are ignored; an empty table gives no rows. Positions are
    code points, ends exclusive.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    rows, found = candidates(docs, kinds(), keep=("owner",))
    found = found.withColumn("value", _value())
    size = F.length("value")
    valid = F.when(F.col("kind") == "assign", size >= 8).when(F.col("kind") == "access", size >= 16).when(F.col("kind") == "hex", size >= 32).otherwise(F.lit(True))
    found = found.where(valid).select("rid", "kind", "place", "start", "end", F.sha2("value", 256).alias("hash"), F.coalesce("doc_id", "rid").alias("repo"), "owner")
    counted = with_ownership(found)
    is_base = F.col("place") < len(BASE)
    live = F.col("n_owners") <= FEW_OWNERS
    span = F.struct("place", "start", "end", "kind")
    per = counted.groupBy("rid").agg(  # one text's spans
        F.collect_list(F.when(is_base, span)).alias("base"),
        F.collect_list(F.when(~is_base & live, span)).alias("more"),
        F.sum((is_base & live).cast("long")).alias("n_live"),
        F.sum((is_base & ~live).cast("long")).alias("n_copied"),
    )
    none = F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string>>")
    free = F.filter("more", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    out = rows.join(per, "rid", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce(free, none).alias("more"), "n_live", "n_copied")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    order = ("start", "place")
    out = out.select("doc_id", *counts, F.sha2(joined("base", order), 256).alias("base_sha256"), F.concat("base", "more").alias("all"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied")), F.size("more").cast("long").alias("n_more"))
    return out.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", joined("all", order).alias("spans"), "n_live", "n_copied", "n_more")


def _is(kind: str):
    return lambda s: s["kind"] == kind
