"""Joins that have no single Spark operator: as-of, band and interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), direction: str = "backward", tolerance: Column | None = None, allow_exact: bool = True, right_on: str | None = None, suffix: str = "_right") -> DataFrame:
    """Each left row with the nearest right row of its by-group, or nulls.

    Both sides are put in one sorted sequence and the last (or next) right row is carried along a
    window, so each by-group is shuffled and sorted once and no pair is ever formed. Null by-keys or
    null times match nothing. tolerance is the greatest distance, comparable with the difference of
    the two times.
    """
    right_on, by = right_on or on, list(by)
    if direction == "nearest":
        near = [asof_join(left.withColumn("_row", F.monotonically_increasing_id()), right, on, by, d, tolerance, allow_exact, right_on, suffix) for d in ("backward", "forward")]
        time = right_on + suffix if right_on in left.columns else right_on
        gap = F.abs(F.unix_micros(F.col(on).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) if left.schema[on].dataType.typeName().startswith(("timestamp", "date")) else F.abs(F.col(on) - F.col(time))
        both = near[0].withColumn("_side", F.lit(0)).unionByName(near[1].withColumn("_side", F.lit(1)))
        w = Window.partitionBy("_row").orderBy(gap.asc_nulls_last(), "_side")
        return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_row", "_side")
    right_cols = [c for c in right.columns if c not in by]
    names = {c: c + suffix if c in left.columns else c for c in right_cols}
    payload = F.struct(*(F.col(c).alias(names[c]) for c in right_cols))
    # At equal times a right row goes before a left one exactly when an exact match counts (backward), or after (forward).
    first = 0 if (direction == "backward") == allow_exact else 2
    a = left.select(*(F.col(b).alias(f"_by{i}") for i, b in enumerate(by)), F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_right"))
    b = right.where(F.col(right_on).isNotNull()).select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(by)), F.col(right_on).alias("_t"), F.lit(first).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_left"), payload.alias("_right"))
    both = a.unionByName(b)
    w = Window.partitionBy(*(f"_by{i}" for i in range(len(by)))).orderBy(F.col("_t").asc_nulls_first(), "_side")
    if direction == "backward":
        found = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    else:
        found = F.first("_right", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = both.withColumn("_found", found).where("_left is not null")
    good = F.col("_t").isNotNull()
    for i in range(len(by)):
        good = good & F.col(f"_by{i}").isNotNull()
    if tolerance is not None:
        gap = F.col("_t") - F.col(f"_found.{names[right_on]}")
        good = good & ((gap if direction == "backward" else -gap) <= tolerance)
    out = out.withColumn("_found", F.when(good, F.col("_found")))
    return out.select("_left.*", *(F.col(f"_found.{names[c]}").alias(names[c]) for c in right_cols))


def band_join(left: DataFrame, right: DataFrame, on: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= on <= high (numbers), by buckets of a width: an equi-join and a filter, whatever the intervals' number.

    An interval is put in every bucket it reaches; choose width near the intervals' usual length.
    """
    l = left.withColumn("_bucket", F.floor(F.col(on) / width))  # noqa: E741
    r = right.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return l.join(r, "_bucket").where(F.col(on).between(F.col(low), F.col(high))).drop("_bucket")


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, within: str, how: str = "inner") -> DataFrame:
    """Equal keys and times at most an interval apart ('5 minutes')."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    gap = F.expr(f"INTERVAL {within}")
    cond = F.col(f"r.{right_time}").between(F.col(f"l.{left_time}") - gap, F.col(f"l.{left_time}") + gap)
    for k in on:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, cond, how)
