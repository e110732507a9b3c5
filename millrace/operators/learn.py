"""Statistics, encoders, features and scores of models over a table, fitted by aggregates and applied by joins with what was fitted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

MAD_SCALE = 1.4826  # fixed value: makes the median absolute deviation a normal column's standard deviation


# Order statistics without a global window: values are counted, ranged over tasks and numbered by the totals of the ranges before.


def cumulative(df: DataFrame, by: Column | str, **sums: Column) -> DataFrame:
    """value, and for each sum its total at the value and, as before_<name>, below it; n counts rows. Null values go.

    The sums of a range of values are one row, so only as many rows as there are ranges are numbered in one task.
    """
    sums = {"n": F.lit(1), **sums}
    by = F.col(by) if isinstance(by, str) else by
    counted = df.select(by.alias("value"), *(x.alias(k) for k, x in sums.items())).where("value is not null").groupBy("value").agg(*(F.sum(k).alias(k) for k in sums))
    ranged = staged(counted.repartitionByRange("value").withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = ranged.groupBy("_range").agg(*(F.sum(k).alias(k) for k in sums))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in sums))
    own = Window.partitionBy("_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(ranges), "_range").select("value", *sums, *((F.col(f"_{k}") + F.coalesce(F.sum(k).over(own), F.lit(0))).alias(f"before_{k}") for k in sums))  # a row a range


def quantiles(df: DataFrame, by: Column | str, shares: Sequence[float]) -> DataFrame:
    """One row: q0, q1, ..., the interpolated quantiles of the shares, exact; null without values."""
    c = cumulative(df, by)
    total = c.agg(F.sum("n").alias("total"))
    held = c.join(F.broadcast(total))  # one row
    at = lambda k: F.max(F.when((F.col("before_n") <= k) & (k < F.col("before_n") + F.col("n")), F.col("value").cast("double")))
    out = []
    for i, p in enumerate(shares):
        place = (F.col("total") - 1) * F.lit(float(p))
        out += [at(F.floor(place)).alias(f"lo{i}"), at(F.ceil(place)).alias(f"hi{i}"), F.max(place - F.floor(place)).alias(f"w{i}")]
    row = held.agg(*out)
    return row.select(*((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}") for i in range(len(shares))))


def _with(df: DataFrame, row: DataFrame) -> DataFrame:
    return df.join(F.broadcast(row))  # one row


def trimmed_mean(df: DataFrame, column: str, share: float = 0.1) -> DataFrame:
    """The mean of what lies between the quantiles share and 1 - share."""
    cut = staged(quantiles(df, column, [share, 1 - share]), "cuts")
    return _with(df, cut).where(F.col(column).between(F.col("q0"), F.col("q1"))).agg(F.avg(column).alias("trimmed_mean"))


def winsorized_mean(df: DataFrame, column: str, share: float = 0.1) -> DataFrame:
    """The mean after what lies beyond the quantiles is drawn in to them."""
    cut = staged(quantiles(df, column, [share, 1 - share]), "cuts")
    inside = F.when(F.col(column).isNotNull(), F.greatest("q0", F.least(F.col(column).cast("double"), "q1")))
    return _with(df, cut).agg(F.avg(inside).alias("winsorized_mean"))


def median_abs_deviation(df: DataFrame, column: str, scale: float = MAD_SCALE) -> DataFrame:
    mid = staged(quantiles(df, column, [0.5]), "median")
    away = _with(df, mid).select(F.abs(F.col(column).cast("double") - F.col("q0")).alias("away"))
    return quantiles(away, "away", [0.5]).select((F.col("q0") * scale).alias("median_abs_deviation"))


def mean_abs_deviation(df: DataFrame, column: str) -> DataFrame:
    """The mean distance from the mean."""
    mean = df.agg(F.avg(column).alias("_mean"))
    return _with(df, mean).agg(F.avg(F.abs(F.col(column) - F.col("_mean"))).alias("mean_abs_deviation"))


def rank_transform(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the share of the other rows that are below: 0 for the least, ties alike, null for null."""
    c = cumulative(df, column)
    total = c.agg(F.sum("n").alias("total"))
    ranks = _with(c, total).select(F.col("value").alias(column), F.coalesce(F.try_divide(F.col("before_n").cast("double"), F.col("total") - 1), F.lit(0.0)).alias(out))
    return df.join(ranks, column, "left")


def concentration(df: DataFrame, column: str, base: float = 2.0) -> DataFrame:
    """One row: entropy, normalized_entropy, gini_impurity, herfindahl_index, mode_share of a column's values; nulls don't count."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    share = _with(sizes, sizes.agg(F.sum("n").alias("total"))).select((F.col("n") / F.col("total")).alias("p"))
    bits, hhi = -F.sum(F.col("p") * F.log("p")), F.sum(F.col("p") * F.col("p"))
    return share.agg(
        (bits / F.log(F.lit(float(base)))).alias("entropy"),
        F.coalesce(F.try_divide(bits, F.log(F.count("*").cast("double"))), F.lit(0.0)).alias("normalized_entropy"),
        (1 - hhi).alias("gini_impurity"),
        hhi.alias("herfindahl_index"),
        F.max("p").alias("mode_share"),
    )


def bartlett(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: statistic, df, of Bartlett's test that the groups have one variance; groups of one row don't count."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.var_samp(value).alias("v")).where("n > 1")
    free = F.sum(F.col("n") - 1)
    pooled = F.sum((F.col("n") - 1) * F.col("v")) / free
    top = free * F.ln(pooled) - F.sum(F.when(F.col("v") > 0, (F.col("n") - 1) * F.ln("v")).otherwise(0.0))
    correction = 1 + (F.sum(1 / (F.col("n") - 1)) - 1 / free) / (3 * (F.count("*") - 1))
    return g.agg((top / correction).alias("statistic"), (F.count("*") - 1).alias("df"))


def f_classif_scores(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """column, f: variance between classes over variance within, from sums gathered in one pass."""
    sums = df.groupBy(label).agg(*(f(F.col(x).cast("double")).alias(f"{x}_{k}") for x in columns for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))))
    long = sums.select(F.inline(F.array(*(F.struct(F.lit(x).alias("column"), *(F.col(f"{x}_{k}").alias(k) for k in "nmv")) for x in columns)))).where("n > 0")
    n, classes = F.sum("n"), F.count("*")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / n
    return long.groupBy("column").agg(F.try_divide(between / (classes - 1), F.sum(F.col("n") * F.col("v")) / (n - classes)).alias("f"))


def f_regression_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """column, f = r^2 / (1 - r^2) * (n - 2)."""
    row = df.agg(*(F.struct(F.lit(x).alias("column"), F.corr(x, target).alias("r"), F.count_if(F.col(x).isNotNull() & F.col(target).isNotNull()).alias("n")).alias(x) for x in columns))
    return row.select(F.inline(F.array(*columns))).select("column", F.try_divide(F.col("r") * F.col("r") * (F.col("n") - 2), 1 - F.col("r") * F.col("r")).alias("f"))


def partial_correlation(df: DataFrame, x: str, y: str, given: str) -> DataFrame:
    """The correlation of x and y that a third column doesn't explain."""
    a, b, d = F.corr(x, y), F.corr(x, given), F.corr(y, given)
    return df.agg(F.try_divide(a - b * d, F.sqrt((1 - b * b) * (1 - d * d))).alias("partial_correlation"))


# Encoders.


def woe_encode(df: DataFrame, column: str, label: Column, out: str) -> DataFrame:
    """df with the weight of evidence of its category for a boolean label; 0 for a category of one class."""
    by = df.groupBy(column).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("q"))
    all_ = by.agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))
    score = F.when((F.col("p") > 0) & (F.col("q") > 0), F.ln((F.col("p") / F.col("ps")) / (F.col("q") / F.col("qs")))).otherwise(0.0)
    return _apply(df, column, _with(by, all_).select(column, score.alias(out)))


def _apply(df: DataFrame, column: str, fitted: DataFrame) -> DataFrame:
    """df with the columns fitted for its category; null is a category of its own."""
    fitted = fitted.withColumnRenamed(column, "_key")
    return df.join(fitted, F.col(column).eqNullSafe(F.col("_key")), "left").drop("_key")


def leave_one_out_encode(df: DataFrame, column: str, target: str, out: str) -> DataFrame:
    """df with the mean target of the other rows of its category; of all rows for a category of one."""
    by = df.groupBy(column).agg(F.sum(target).alias("_sum"), F.count(target).alias("_n"))
    by = _with(by, df.agg(F.avg(target).alias("_prior")))
    others = F.coalesce(F.try_divide(F.col("_sum") - F.col(target), F.col("_n") - 1), F.col("_prior"))
    return _apply(df, column, by).withColumn(out, others).drop("_sum", "_n", "_prior")


def binary_encode(df: DataFrame, column: str, bits: int) -> DataFrame:
    """df with column_0 (lowest) ... of the category's place among the sorted ones, from 1; zeros for null. Categories that bits can't tell apart are an error."""
    c = cumulative(df.select(column).distinct(), column)
    code = c.select(F.col("value").alias(column), (F.col("before_n") + 1).cast("long").alias("_code"))
    wide = F.when(F.coalesce("_code", F.lit(0)) >= 1 << bits, F.raise_error(F.lit(f"more categories than {bits} bits hold")).cast("long")).otherwise(F.coalesce("_code", F.lit(0)))
    out = df.join(code, column, "left").withColumn("_code", wide)
    return out.withColumns({f"{column}_{i}": F.shiftright("_code", i).bitwiseAND(1).cast("int") for i in range(bits)}).drop("_code")


def group_stats(df: DataFrame, group: str, column: str, stats: Sequence[str] = ("mean", "std", "min", "max", "count")) -> DataFrame:
    """df with figures of its group as group_<column>_<stat>."""
    f = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
    return _apply(df, group, df.groupBy(group).agg(*(f[s](column).alias(f"group_{column}_{s}") for s in stats)))


def group_impute(df: DataFrame, group: str, column: str) -> DataFrame:
    """df with nulls replaced by their group's mean, or the table's where a group has none."""
    by = _with(df.groupBy(group).agg(F.avg(column).alias("_own")), df.agg(F.avg(column).alias("_all")))
    return _apply(df, group, by).withColumn(column, F.coalesce(F.col(column).cast("double"), "_own", "_all")).drop("_own", "_all")


def bin_uniform(df: DataFrame, column: str, bins: int, out: str) -> DataFrame:
    """df with the number, from 0, of its bin among bins of equal width from the least to the greatest value."""
    ends = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    place = F.floor(F.coalesce(F.try_divide((F.col(column) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    return _with(df, ends).withColumn(out, F.when(F.col(column).isNotNull(), F.least(place, F.lit(bins - 1)).cast("int"))).drop("_lo", "_hi")


def bin_quantile(df: DataFrame, column: str, bins: int, out: str) -> DataFrame:
    """df with the number of inner quantile edges at or below its value: bins of about as many rows each."""
    cut = staged(quantiles(df, column, [k / bins for k in range(1, bins)]), "cuts")
    place = sum((F.when(F.col(column) >= F.col(f"q{k}"), 1).otherwise(0) for k in range(bins - 1)), F.lit(0))
    return _with(df, cut).withColumn(out, F.when(F.col(column).isNotNull(), place)).drop(*(f"q{k}" for k in range(bins - 1)))


# Features of time and text.


def calendar_features(df: DataFrame, column: str) -> DataFrame:
    """df with <column>_year, _month, _day, _dayofweek (Monday 0), _dayofyear, _hour, _quarter, _is_weekend."""
    t = F.col(column)
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t), "dayofyear": F.dayofyear(t), "hour": F.hour(t), "quarter": F.quarter(t), "is_weekend": F.weekday(t) >= 5}
    return df.withColumns({f"{column}_{k}": x for k, x in parts.items()})


def cyclical(df: DataFrame, column: str, period: float) -> DataFrame:
    """df with the sine and cosine of the column's place in its period."""
    turn = F.col(column) * (2 * F.pi() / period)
    return df.withColumns({f"{column}_sin": F.sin(turn), f"{column}_cos": F.cos(turn)})


def lags(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """df with the value so many rows earlier within its key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(w) for k in steps})


def rolling(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """df with mean, min and max of the rows before, its own left out so that nothing leaks."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumns({f"{column}_roll_{k}": f(column).over(w) for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))})


def tfidf(df: DataFrame, key: str, text: str, pattern: str = r"\b\w\w+\b") -> DataFrame:
    """key, term, weight: counts times ln((1 + documents) / (1 + documents with the term)) + 1, each document scaled to length one; documents without terms have no row."""
    terms = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    terms = staged(terms, "terms")
    held = _with(terms.groupBy("term").agg(F.count("*").alias("df")), df.agg(F.count("*").alias("docs")))
    raw = terms.join(held, "term").select(key, "term", (F.col("tf") * (F.ln((F.col("docs") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("weight"))


# Scores of models.


def calibration(df: DataFrame, label: Column, score: Column, bins: int = 10) -> DataFrame:
    """One row: expected and maximum calibration error over bins of equal width, and the Brier skill against the base rate."""
    rows = df.select(label.cast("double").alias("y"), score.cast("double").alias("s"))
    brier = rows.agg(F.avg((F.col("s") - F.col("y")) ** 2).alias("_loss"), F.avg("y").alias("_base"))
    b = rows.groupBy(F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("s") - F.avg("y")).alias("gap"))
    e = b.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("expected_calibration_error"), F.max("gap").alias("maximum_calibration_error"))
    return _with(e, brier).select("expected_calibration_error", "maximum_calibration_error", (1 - F.try_divide("_loss", F.col("_base") * (1 - F.col("_base")))).alias("brier_skill_score"))


def fairness(df: DataFrame, group: str, label: Column, predicted: Column) -> DataFrame:
    """group, n, selection_rate, true_positive_rate, false_positive_rate, precision."""
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(predicted.cast("int")).alias("selection_rate"),
        F.avg(F.when(label, predicted.cast("int"))).alias("true_positive_rate"),
        F.avg(F.when(~label, predicted.cast("int"))).alias("false_positive_rate"),
        F.avg(F.when(predicted, label.cast("int"))).alias("precision"),
    )


def fairness_gaps(df: DataFrame, group: str, label: Column, predicted: Column) -> DataFrame:
    """One row: differences between the groups' greatest and least rates, and the ratio of their selection rates."""
    gap = lambda x: F.max(x) - F.min(x)
    return fairness(df, group, label, predicted).agg(
        gap("selection_rate").alias("demographic_parity_difference"),
        F.try_divide(F.min("selection_rate"), F.max("selection_rate")).alias("disparate_impact_ratio"),
        gap("true_positive_rate").alias("equal_opportunity_difference"),
        F.greatest(gap("true_positive_rate"), gap("false_positive_rate")).alias("equalized_odds_difference"),
        gap("precision").alias("predictive_parity_difference"),
    )


def ranked(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row: roc_auc, gini_coefficient, average_precision, ks_statistic, best_f1 and best_threshold (score at or above it is positive; of equal ones the least)."""
    c = cumulative(df.select(score.alias("s"), label.cast("int").alias("y")), "s", p=F.col("y"))
    rows = _with(c, c.agg(F.sum("p").alias("ps"), F.sum("n").alias("ns")))
    p, n, ps, ns = (F.col(x).cast("double") for x in ("p", "n", "ps", "ns"))
    above_p, above = ps - F.col("before_p"), ns - F.col("before_n")  # at or above the score
    q, qs, below_q = n - p, ns - ps, F.col("before_n") - F.col("before_p")
    f1 = 2 * above_p / (above + ps)
    auc = F.sum(F.try_divide(p * (below_q + q / 2), ps * qs))
    return rows.agg(
        auc.alias("roc_auc"),
        (2 * auc - 1).alias("gini_coefficient"),
        F.sum(F.try_divide(p, ps) * above_p / above).alias("average_precision"),
        F.max(F.abs(F.try_divide(F.col("before_p") + p, ps) - F.try_divide(below_q + q, qs))).alias("ks_statistic"),
        F.max(f1).alias("best_f1"),
        (-F.max(F.struct(F.round(f1, 12).alias("f"), (-F.col("value")).alias("v")))["v"]).alias("best_threshold"),
    )


def blend(*scores: Column, weights: Sequence[float] | None = None) -> Column:
    """The weighted mean of several models' scores; weights need not sum to one."""
    weights = weights or [1.0] * len(scores)
    return sum((w * s for w, s in zip(weights[1:], scores[1:], strict=True)), weights[0] * scores[0]) / sum(weights)


def majority(*votes: Column) -> Column:
    """The commonest vote; of equally common ones the least. Nulls don't vote."""
    cast = F.array_compact(F.array(*votes))
    ranked_ = F.transform(F.array_distinct(cast), lambda v: F.struct((-F.size(F.filter(cast, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(ranked_)["v"]


def packed(df: DataFrame, key: str, tokens: Column, length: int) -> DataFrame:
    """key, sequence, offset, start, n: the pieces of each document when all, in the order of their keys, are laid end to end and cut into sequences of a length; documents without tokens have none."""
    c = cumulative(df, key, t=tokens.cast("long")).where("t > 0")
    first, last = F.floor(F.col("before_t") / length), F.floor((F.col("before_t") + F.col("t") - 1) / length)
    each = c.select(F.col("value").alias(key), "t", "before_t", F.explode(F.sequence(first, last)).alias("sequence"))
    begin, end = F.greatest("before_t", F.col("sequence") * length), F.least(F.col("before_t") + F.col("t"), (F.col("sequence") + 1) * length)
    return each.select(key, "sequence", (begin - F.col("sequence") * length).alias("offset"), (begin - F.col("before_t")).alias("start"), (end - begin).alias("n"))
