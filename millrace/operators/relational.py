"""Dataset verbs as functions from DataFrames to DataFrames (usable with df.transform)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def as_column(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def ordering(by: Sequence, descending=False, nulls_first=False) -> list[Column]:
    """Sort keys with nulls last in both directions unless asked otherwise."""
    by = [by] if isinstance(by, str | Column) else list(by)
    flags = lambda v: list(v) if isinstance(v, list | tuple) else [v] * len(by)
    out = []
    for c, down, first in zip(map(as_column, by), flags(descending), flags(nulls_first), strict=True):
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


def sort(df: DataFrame, by, descending=False, nulls_first=False) -> DataFrame:
    return df.orderBy(*ordering(by, descending, nulls_first))


def top_k(df: DataFrame, k: int, by) -> DataFrame:
    return sort(df, by, descending=True).limit(k)


def bottom_k(df: DataFrame, k: int, by) -> DataFrame:
    return sort(df, by).limit(k)


def distinct(df: DataFrame, subset: Sequence[str] | None = None, order_by=None, descending=False) -> DataFrame:
    """All columns, or the first row of each subset in an order (DISTINCT ON)."""
    if subset is None:
        return df.distinct()
    if order_by is None:
        return df.dropDuplicates(list(subset))
    w = Window.partitionBy(*subset).orderBy(*ordering(order_by, descending))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def with_row_index(df: DataFrame, name: str = "index", offset: int = 0, order_by=None) -> DataFrame:
    """Consecutive numbers in the order's (or the input's) sequence, without gathering rows in one task.

    Rows are numbered in their partition and shifted by the sizes of those before, one number a
    partition. Both come from one staged table: a second run of a range partitioning may deal rows
    otherwise.
    """
    ordered = sort(df, order_by) if order_by is not None else df
    if order_by is not None:
        ordered = df.repartitionByRange(*ordering(order_by)).sortWithinPartitions(*ordering(order_by))
    tagged = staged(ordered.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33).cast("int")
    sizes = sorted((r.p, r.n) for r in tagged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, shifts = 0, {}
    for p, n in sizes:
        shifts[p] = before
        before += n
    place = F.create_map(*(F.lit(x) for kv in shifts.items() for x in kv)) if shifts else F.create_map(F.lit(-1), F.lit(0))
    return tagged.withColumn(name, (place[part] + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + offset).cast("long")).drop("_id")


def gather_every(df: DataFrame, n: int, order_by, offset: int = 0) -> DataFrame:
    return with_row_index(df, "_index", order_by=order_by).where(F.col("_index") % n == offset).drop("_index")


def slice_rows(df: DataFrame, offset: int, n: int, order_by) -> DataFrame:
    return sort(df, order_by).offset(offset).limit(n)


def sample(df: DataFrame, fraction: float | None = None, n: int | None = None, seed: int = 0) -> DataFrame:
    """By a seeded hash of the row's values: the same rows however the table is partitioned."""
    h = F.xxhash64(F.lit(seed), *(F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType.typeName(), str) and df.schema[c].dataType.typeName() == "map" else F.col(c) for c in df.columns))
    if n is not None:
        return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")
    return df.where(F.pmod(h, F.lit(1 << 30)) < int(fraction * (1 << 30)))


def split_by_hash(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0, name: str = "split") -> DataFrame:
    """A column that names each row's split; rows of one key stay together."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out, upper = F.lit(list(shares)[-1]), 1.0
    for k, share in reversed(list(shares.items())):
        upper -= share
        out = F.when(u >= upper, F.lit(k)).otherwise(out) if k == list(shares)[-1] else F.when(u < upper + share, F.lit(k)).otherwise(out)
    return df.withColumn(name, out)


def explode(df: DataFrame, column: str, alias: str | None = None, outer: bool = False, index: str | None = None) -> DataFrame:
    """Null and empty lists go, unless outer."""
    others = [c for c in df.columns if c != column]
    alias = alias or column
    if index:
        return df.select(*others, (F.posexplode_outer if outer else F.posexplode)(column).alias(index, alias))
    return df.select(*others, (F.explode_outer if outer else F.explode)(column).alias(alias))


def unnest(df: DataFrame, column: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != column), f"{column}.*")


def unpivot(df: DataFrame, index: Sequence[str], on: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(index), list(on), variable, value)


def pivot(df: DataFrame, index: Sequence[str], on: str, aggregate: Column, values: Sequence) -> DataFrame:
    return df.groupBy(*index).pivot(on, list(values)).agg(aggregate)


def fill_null(df: DataFrame, columns: Sequence[str], value=None, strategy: str | None = None, order_by=None, partition_by: Sequence[str] = ()) -> DataFrame:
    """A value, or the last (forward) or next (backward) value in an order."""
    if strategy is None:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})
    w = Window.partitionBy(*partition_by).orderBy(*ordering(order_by))
    if strategy == "forward":
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for c in columns})


def union(*dfs: DataFrame, distinct: bool = False, by_name: bool = False) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True) if by_name else a.union(b), dfs)
    return out.distinct() if distinct else out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def null_count(df: DataFrame) -> DataFrame:
    return df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: count, nulls, mean, std, min, quartiles, max; one pass over the table."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.percentile(c, 0.25).alias("q1"), F.median(c).alias("median"), F.percentile(c, 0.75).alias("q3"), F.max(c).cast("double").alias("max")) for c in columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of every pair; one pass."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a in columns for b in columns]
    return df.agg(F.array(*cells).alias("s")).select(F.inline("s"))


def cov_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("cov")) for a in columns for b in columns]
    return df.agg(F.array(*cells).alias("s")).select(F.inline("s"))


def class_balance(df: DataFrame, column: str) -> DataFrame:
    counts = value_counts(df, column)
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(column, "count", (F.col("count") / F.col("total")).alias("share"))  # one row


def balance_classes(df: DataFrame, column: str, order_by) -> DataFrame:
    """As many rows of each class as the smallest has, first in an order."""
    least = value_counts(df, column).agg(F.min("count")).first()[0] or 0
    w = Window.partitionBy(column).orderBy(*ordering(order_by))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= least).drop("_rank")


def get_dummies(df: DataFrame, column: str, values: Sequence, prefix: str | None = None) -> DataFrame:
    return df.withColumns({f"{prefix or column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}).drop(column)


def drop_constant_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*(F.min(c).eqNullSafe(F.max(c)).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if counts[c]))


def rename_right(right: DataFrame, left: DataFrame, keys: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Non-key columns that the left side has too get a suffix."""
    return right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c not in keys})


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Keys once, in front; clashing right columns with a suffix. A full join reads its sides more than once, so they must be the same each time."""
    on = [on] if isinstance(on, str) else list(on)
    if how.replace("_", "").lower() in ("full", "outer", "fullouter"):
        return _full_join(left, rename_right(right, left, on, suffix), on)
    return left.join(right if how in ("left_semi", "left_anti", "semi", "anti") else rename_right(right, left, on, suffix), on, how)


#: Rows of a side in a cell of _full_join, about.
CELL = 1024


def _full_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The pairs, then the rows of each side whose key the other side lacks.

    Spark's own full join holds all pairs of a key in one task. Here the pairs of a key with many of
    them are dealt out as a grid of cells: a left row goes to a row of cells, a right row to a column.
    """
    counts = left.groupBy(on).agg(F.count("*").alias("_l")).join(right.groupBy(on).agg(F.count("*").alias("_r")), on)
    large = F.broadcast(counts.where(F.col("_l").cast("double") * F.col("_r") > CELL * CELL).select(*on, F.ceil(F.col("_l") / CELL).alias("_rows"), F.ceil(F.col("_r") / CELL).alias("_columns")))
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * left.sparkSession.sparkContext.defaultParallelism)

    def dealt(side: DataFrame, own: str, size: str, other: str, across: str) -> DataFrame:
        """A row's own place by its hash, which a task that runs again finds again; its copies go across."""
        hashed = F.xxhash64(*(f.name for f in side.schema if "map<" not in f.dataType.simpleString()))
        rows = side.join(large, on, "left").withColumn(own, F.pmod(hashed, F.coalesce(size, F.lit(1))))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(across, F.lit(1)) - 1))).drop("_rows", "_columns")
        return rows.repartition(n, *on, "_i", "_j")  # the number keeps cells apart that are small in bytes

    pairs = dealt(left, "_i", "_rows", "_j", "_columns").join(dealt(right, "_j", "_columns", "_i", "_rows"), [*on, "_i", "_j"]).drop("_i", "_j")
    only = [a.join(b.select(on).distinct(), on, "left_anti") for a, b in ((left, right), (right, left))]
    return pairs.unionByName(only[0], allowMissingColumns=True).unionByName(only[1], allowMissingColumns=True)


def equals(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
