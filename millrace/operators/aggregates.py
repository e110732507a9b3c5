"""Aggregates beyond the built-in ones, as Columns for agg() or as DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def skewness(x) -> Column:
    """Sample-corrected."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x) -> Column:
    """Sample excess."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def geometric_mean(x) -> Column:
    return F.exp(F.avg(F.ln(_c(x))))


def harmonic_mean(x) -> Column:
    return F.count(x) / F.sum(1 / _c(x))


def rms(x) -> Column:
    return F.sqrt(F.avg(_c(x) * _c(x)))


def cv(x) -> Column:
    return F.stddev_samp(x) / F.avg(x)


def sem(x) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x).cast("double"))


def midrange(x) -> Column:
    return (F.max(x) + F.min(x)) / 2


def value_range(x) -> Column:
    return F.max(x) - F.min(x)


def q1(x) -> Column:
    return F.percentile(x, 0.25)


def q3(x) -> Column:
    return F.percentile(x, 0.75)


def iqr(x) -> Column:
    return q3(x) - q1(x)


def midhinge(x) -> Column:
    return (q1(x) + q3(x)) / 2


def trimean(x) -> Column:
    return (q1(x) + 2 * F.median(x) + q3(x)) / 4


def quartile_dispersion(x) -> Column:
    return iqr(x) / (q3(x) + q1(x))


def bowley_skew(x) -> Column:
    return (q3(x) + q1(x) - 2 * F.median(x)) / iqr(x)


def interdecile_range(x) -> Column:
    return F.percentile(x, 0.9) - F.percentile(x, 0.1)


def decile_ratio(x) -> Column:
    return F.percentile(x, 0.9) / F.percentile(x, 0.1)


def index_of_dispersion(x) -> Column:
    return F.var_samp(x) / F.avg(x)


def signal_to_noise(x) -> Column:
    return F.avg(x) / F.stddev_samp(x)


def studentized_range(x) -> Column:
    return value_range(x) / F.stddev_samp(x)


def relative_range(x) -> Column:
    return value_range(x) / F.avg(x)


def geometric_std(x) -> Column:
    return F.exp(F.stddev_samp(F.ln(_c(x))))


def moors_kurtosis(x) -> Column:
    e = [F.percentile(x, k / 8) for k in range(1, 8)]
    return ((e[6] - e[4]) + (e[2] - e[0])) / (e[5] - e[1])


def jarque_bera(x) -> Column:
    return F.count(x) / 6 * (F.skewness(x) * F.skewness(x) + F.kurtosis(x) * F.kurtosis(x) / 4)


def null_rate(x) -> Column:
    return F.avg(_c(x).isNull().cast("double"))


def non_null_rate(x) -> Column:
    return F.avg(_c(x).isNotNull().cast("double"))


def nunique_ratio(x) -> Column:
    return F.count_distinct(_c(x)) / F.count(x)


def _both(x, w) -> tuple[Column, Column]:
    ok = _c(x).isNotNull() & _c(w).isNotNull()
    return F.when(ok, _c(x)), F.when(ok, _c(w))


def weighted_mean(x, w) -> Column:
    x, w = _both(x, w)
    return F.sum(x * w) / F.sum(w)


def weighted_var(x, w) -> Column:
    m = weighted_mean(x, w)
    return weighted_mean(_c(x) * _c(x), w) - m * m


def weighted_std(x, w) -> Column:
    return F.sqrt(weighted_var(x, w))


def weighted_covariance(x, y, w) -> Column:
    return weighted_mean(_c(x) * _c(y), w) - weighted_mean(x, w) * weighted_mean(y, w)


def weighted_correlation(x, y, w) -> Column:
    return weighted_covariance(x, y, w) / F.sqrt(weighted_var(x, w) * weighted_var(y, w))


def array_agg(x, order_by=None) -> Column:
    """Nulls stay; in an order where one is given."""
    if order_by is None:
        return F.transform(F.collect_list(F.struct(_c(x).alias("x"))), lambda s: s["x"])
    return F.transform(F.array_sort(F.collect_list(F.struct(_c(order_by).alias("o"), _c(x).alias("x")))), lambda s: s["x"])


def string_agg(x, separator: str, order_by) -> Column:
    return F.array_join(array_agg(x, order_by), separator)


def mode(df: DataFrame, keys: Sequence[str], x: str, name: str = "mode") -> DataFrame:
    """Most frequent value of each group, the least among equals; counts are aggregated before they are compared."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(x, F.struct(-F.col("_n"), F.col(x))).alias(name))


def entropy(df: DataFrame, keys: Sequence[str], x: str, name: str = "entropy") -> DataFrame:
    """Bits of the distribution of values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    n = F.sum("_n")
    return counts.groupBy(*keys).agg((F.log2(n.cast("double")) - F.sum(F.col("_n") * F.log2(F.col("_n").cast("double"))) / n).alias(name))


def histogram(df: DataFrame, keys: Sequence[str], x: str, name: str = "histogram") -> DataFrame:
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(x, "_n")))).alias(name))


def top_values(df: DataFrame, keys: Sequence[str], x: str, k: int, name: str = "top") -> DataFrame:
    """The k most frequent values of each group, exactly, in a list."""
    counts = df.groupBy(*keys, x).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.asc(x))
    best = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", x))), lambda s: s[x]).alias(name))


def mad(df: DataFrame, keys: Sequence[str], x: str, name: str = "mad") -> DataFrame:
    """Median distance from the median."""
    m = df.groupBy(*keys).agg(F.median(x).alias("_m"))
    joined = df.join(m, list(keys)) if keys else df.join(F.broadcast(m))  # one row
    return joined.groupBy(*keys).agg(F.median(F.abs(F.col(x) - F.col("_m"))).alias(name))


def assembly(df: DataFrame, keys: Sequence[str], length: str, share: float = 0.5) -> DataFrame:
    """N (the length at which the longest sequences hold the share) and L (how many they are), with auN."""
    w = Window.partitionBy(*keys).orderBy(F.desc(length))
    every = Window.partitionBy(*keys)
    run = df.withColumn("_sum", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(length).over(every)).withColumn("_rank", F.row_number().over(w))
    hit = F.col("_sum") >= F.col("_all") * share
    return run.groupBy(*keys).agg(F.max(F.when(hit, F.col(length))).alias("n"), F.min(F.when(hit, F.col("_rank"))).alias("l"), (F.sum(F.col(length) * F.col(length)) / F.sum(length)).alias("aun"))
