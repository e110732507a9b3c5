"""Window expressions: running, rolling, fills, runs, sessions, GROUPS frames and exponential means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .relational import ordering


def spec(partition_by: Sequence = (), order_by: Sequence = (), descending=False) -> WindowSpec:
    w = Window.partitionBy(*partition_by)
    return w.orderBy(*ordering(order_by, descending)) if order_by else w


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(aggregate: Column, x: str, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """Over the last n rows; null with fewer than min_periods (n) values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if min_periods is None else min_periods), aggregate.over(frame))


def rolling_by(aggregate: Column, partition_by: Sequence, time: str, micros: int) -> Column:
    """Over the rows at most so many microseconds before (and at) the row's time."""
    return aggregate.over(Window.partitionBy(*partition_by).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-micros, 0))


def forward_fill(x: str, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(running(w))


def backward_fill(x: str, w: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def interpolate(x: str, position: Column, w: WindowSpec) -> Column:
    """Linear in the position between the nearest values on both sides."""
    known = F.struct(position.alias("p"), F.col(x).alias("v"))
    seen = F.when(F.col(x).isNotNull(), known)
    a = F.last(seen, ignorenulls=True).over(running(w))
    b = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.when(F.col(x).isNotNull(), F.col(x).cast("double")).otherwise(a["v"] + (b["v"] - a["v"]) * (position - a["p"]) / (b["p"] - a["p"]))


def diff(x: str, w: WindowSpec, n: int = 1) -> Column:
    return F.col(x) - F.lag(x, n).over(w)


def pct_change(x: str, w: WindowSpec, n: int = 1) -> Column:
    return F.try_divide(F.col(x), F.lag(x, n).over(w)) - 1


def rle_flag(x: str, w: WindowSpec) -> Column:
    """1 where a run ends and another begins; rle_id is its running sum."""
    return (~F.col(x).eqNullSafe(F.lag(x).over(w)) & (F.row_number().over(w) > 1)).cast("int")


def with_rle_id(df: DataFrame, x: str, w: WindowSpec, name: str = "rle_id") -> DataFrame:
    return df.withColumn("_flag", rle_flag(x, w)).withColumn(name, F.sum("_flag").over(running(w))).drop("_flag")


def peak_max(x: str, w: WindowSpec) -> Column:
    return F.coalesce((F.col(x) > F.lag(x).over(w)) & (F.col(x) > F.lead(x).over(w)), F.lit(False))


def zscore(x: str, partition_by: Sequence = ()) -> Column:
    w = Window.partitionBy(*partition_by)
    return (F.col(x) - F.avg(x).over(w)) / F.stddev_samp(x).over(w)


def minmax_scale(x: str, partition_by: Sequence = ()) -> Column:
    w = Window.partitionBy(*partition_by)
    return F.try_divide(F.col(x) - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w))


def mean_center(x: str, partition_by: Sequence = ()) -> Column:
    return F.col(x) - F.avg(x).over(Window.partitionBy(*partition_by))


def pct_of_total(x: str, partition_by: Sequence = ()) -> Column:
    return F.col(x) / F.sum(x).over(Window.partitionBy(*partition_by))


def rank_pct(w: WindowSpec, partition_by: Sequence = ()) -> Column:
    return F.rank().over(w) / F.count("*").over(Window.partitionBy(*partition_by))


def with_groups_frame(df: DataFrame, aggregate: Column, name: str, partition_by: Sequence, order_by: Sequence, before: int, after: int) -> DataFrame:
    """A frame of whole peer groups: a range over their dense rank."""
    ranked = df.withColumn("_group", F.dense_rank().over(spec(partition_by, order_by)))
    return ranked.withColumn(name, aggregate.over(Window.partitionBy(*partition_by).orderBy("_group").rangeBetween(-before, after))).drop("_group")


def sessions(df: DataFrame, time: str, gap: str, partition_by: Sequence, aggregates: Sequence[Column] = ()) -> DataFrame:
    """One row a session: a gap longer than the interval starts a new one; session_start and session_end are its first and last times."""
    w = Window.partitionBy(*partition_by).orderBy(time)
    begins = (F.col(time) - F.lag(time).over(w) > F.expr(f"INTERVAL {gap}")).cast("int")
    marked = df.withColumn("_new", F.coalesce(begins, F.lit(0))).withColumn("_session", F.sum("_new").over(running(w)))
    return marked.groupBy(*partition_by, "_session").agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), *aggregates).drop("_session")


def ewm_mean(x: str, w: WindowSpec, alpha: float) -> Column:
    """Adjusted exponential mean over the running frame, nulls skipped but counted in the decay.

    Weights below 1e-18 can't move a double, so the frame is cut where they end: memory and work a
    row are bounded whatever the partition's length.
    """
    import math

    reach = max(1, math.ceil(math.log(1e-18) / math.log(1 - alpha))) if alpha < 1 else 1
    frame = w.rowsBetween(-reach, 0)
    values = F.collect_list(F.struct(F.col(x).cast("double").alias("v"))).over(frame)
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    step = lambda s, e: F.struct((s["n"] * (1 - alpha) + F.coalesce(e["v"], F.lit(0.0))).alias("n"), (s["d"] * (1 - alpha) + e["v"].isNotNull().cast("double")).alias("d"))
    return F.aggregate(values, start, step, lambda s: F.try_divide(s["n"], s["d"]))


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a window expression holds."""
    return df.withColumn("_q", condition).where("_q").drop("_q")
