"""Data quality: named rules counted in one pass, rows set apart or refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rules:
    """Row rules by name; a rule holds where its expression is true, and null breaks it."""

    def __init__(self) -> None:
        self.rules: dict[str, Column] = {}

    def check(self, name: str, condition: Column) -> Rules:
        self.rules[name] = F.coalesce(condition, F.lit(False))
        return self

    def not_null(self, column: str) -> Rules:
        return self.check(f"{column} not null", F.col(column).isNotNull())

    def in_range(self, column: str, low, high) -> Rules:
        return self.check(f"{column} in range", F.col(column).between(low, high))

    def accepted(self, column: str, values: Sequence) -> Rules:
        return self.check(f"{column} accepted", F.col(column).isin(*values))

    def matches(self, column: str, pattern: str) -> Rules:
        return self.check(f"{column} matches", F.col(column).rlike(pattern))

    def validate(self, df: DataFrame) -> DataFrame:
        """rule, failed, total: one aggregate over df."""
        rows = [F.struct(F.lit(n).alias("rule"), F.count_if(~c).alias("failed"), F.count("*").alias("total")) for n, c in self.rules.items()]
        return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that keep every rule; the others with the names of those they break."""
        broken = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in self.rules.items())), lambda x: x.isNotNull())
        marked = df.withColumn("broken_rules", broken)
        return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)

    def fail(self, df: DataFrame) -> DataFrame:
        """df itself, or an error that names broken rules."""
        bad = [f"{r.rule}: {r.failed} of {r.total}" for r in self.validate(df).where("failed > 0").collect()]
        if bad:
            raise ValueError("; ".join(bad))
        return df


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("times")).where("times > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference isn't in the parent table; null references are none."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows beyond k interquartile ranges from the quartiles."""
    q = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    span = (F.col("q")[1] - F.col("q")[0]) * k
    return df.join(F.broadcast(q)).where((F.col(column) < F.col("q")[0] - span) | (F.col(column) > F.col("q")[1] + span)).drop("q")  # one row


class Facts:
    """Checks of a whole table: each compares one aggregate with bounds, and all are computed in one pass."""

    def __init__(self) -> None:
        self.facts: list[tuple[str, Column, float | None, float | None]] = []

    def between(self, name: str, value: Column, low: float | None, high: float | None) -> Facts:
        self.facts.append((name, value.cast("double"), low, high))
        return self

    def row_count_between(self, low, high) -> Facts:
        return self.between("row_count", F.count("*"), low, high)

    def mean_between(self, column: str, low, high) -> Facts:
        return self.between(f"mean {column}", F.avg(column), low, high)

    def sum_between(self, column: str, low, high) -> Facts:
        return self.between(f"sum {column}", F.sum(column), low, high)

    def stddev_between(self, column: str, low, high) -> Facts:
        return self.between(f"stddev {column}", F.stddev_samp(column), low, high)

    def median_between(self, column: str, low, high) -> Facts:
        return self.quantile_between(column, 0.5, low, high)

    def quantile_between(self, column: str, q: float, low, high) -> Facts:
        return self.between(f"quantile {q} {column}", F.percentile(column, F.lit(q)), low, high)

    def min_between(self, column: str, low, high) -> Facts:
        return self.between(f"min {column}", F.min(column), low, high)

    def max_between(self, column: str, low, high) -> Facts:
        return self.between(f"max {column}", F.max(column), low, high)

    def null_rate_below(self, column: str, high: float) -> Facts:
        return self.between(f"null rate {column}", F.avg(F.col(column).isNull().cast("double")), None, high)

    def distinct_count_between(self, column: str, low, high) -> Facts:
        return self.between(f"distinct {column}", F.count_distinct(column), low, high)

    def unique_ratio_above(self, column: str, low: float) -> Facts:
        return self.between(f"unique ratio {column}", F.try_divide(F.count_distinct(column), F.count(column)), low, None)

    def validate(self, df: DataFrame) -> DataFrame:
        """fact, value, holds: a null value (as of an empty table) doesn't hold."""

        def holds(value: Column, low, high) -> Column:
            ok = value.isNotNull()
            ok = ok if low is None else ok & (value >= low)
            return F.coalesce(ok if high is None else ok & (value <= high), F.lit(False))

        rows = [F.struct(F.lit(n).alias("fact"), v.alias("value"), holds(v, low, high).alias("holds")) for n, v, low, high in self.facts]
        return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def str_length_between(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def not_empty(column: str) -> Column:
    return F.col(column).rlike(r"\S")


def not_matches(column: str, pattern: str) -> Column:
    return ~F.col(column).rlike(pattern)


def positive(column: str) -> Column:
    return F.col(column) > 0


def not_in_future(column: str, now: Column | None = None) -> Column:
    return F.col(column) <= (F.current_timestamp() if now is None else now)


def fresh_within(column: str, seconds: int, now: Column | None = None) -> Column:
    """Is the time at most so many seconds before now?"""
    now = F.current_timestamp() if now is None else now
    return F.col(column).cast("timestamp") >= now.cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))


def compare_columns(left: str, op: str, right: str) -> Column:
    """Row by row: op is one of = <> < <= > >=."""
    if op not in ("=", "<>", "<", "<=", ">", ">="):
        raise ValueError(f"no comparison {op}")
    return F.expr(f"`{left}` {op} `{right}`")


def schema_faults(df: DataFrame, types: dict[str, str], extra: bool = True) -> list[str]:
    """Columns that are missing or of another type, and unless extra those that nobody named."""
    have = dict(df.dtypes)
    faults = [f"{c} is missing" if c not in have else f"{c} is {have[c]}, not {t}" for c, t in types.items() if have.get(c) != t]
    return faults + ([] if extra else [f"{c} is unexpected" for c in have if c not in types])
