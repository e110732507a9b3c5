"""Verbs over whole tables: Python over batches and groups, splits, budgets and facts about a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import with_row_index


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, retries: int = 0) -> DataFrame:
    """f over Arrow batches; a batch that fails is tried again so many times before its task fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for attempt in range(retries + 1):
                try:
                    out = f(batch)
                except Exception:
                    if attempt == retries:
                        raise
                else:
                    yield out
                    break

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: Sequence[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f over the rows of each group as an Arrow table: a group must fit in a task's memory, so split or pre-aggregate hot ones first."""
    return df.groupBy(*keys).applyInArrow(lambda table: f(table), schema)


def uniform(keys: Sequence[str], seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, whatever the partitions."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def split_proportionately(df: DataFrame, parts: Sequence[float], keys: Sequence[str], seed: int = 0) -> list[DataFrame]:
    """Disjoint parts of about the given shares, by a hash of the keys."""
    total, low, out = sum(parts), 0.0, []
    u = uniform(keys, seed)
    for k, p in enumerate(parts):
        high = 2.0 if k == len(parts) - 1 else low + p / total
        out.append(df.where((u >= low) & (u < high)))
        low = high
    return out


def train_val_test_split(df: DataFrame, keys: Sequence[str], val: float = 0.1, test: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, v, t = split_proportionately(df, [1 - val - test, val, test], keys, seed)
    return train, v, t


def stratified_split(df: DataFrame, by: str, share: float, keys: Sequence[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Exactly ceil(share * n) rows of each stratum, the least by hash, and the rest."""
    order = Window.partitionBy(by).orderBy(uniform(keys, seed), *keys)
    size = Window.partitionBy(by)
    ranked = df.withColumn("_rank", F.row_number().over(order)).withColumn("_size", F.count("*").over(size))
    first = F.col("_rank") <= F.ceil(F.col("_size") * share)
    return ranked.where(first).drop("_rank", "_size"), ranked.where(~first).drop("_rank", "_size")


def split_at_indices(df: DataFrame, at: Sequence[int], order_by) -> list[DataFrame]:
    """The rows before at[0] in the order, from there to at[1], ..., and the rest."""
    numbered = with_row_index(df, "_index", order_by=order_by)
    cuts = [0, *at, None]
    return [numbered.where((F.col("_index") >= lo) & (F.lit(True) if hi is None else F.col("_index") < hi)).drop("_index") for lo, hi in zip(cuts, cuts[1:], strict=False)]


def filter_by_length(df: DataFrame, column: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Rows whose text has so many characters; null texts go."""
    n = F.length(column)
    return df.where((n >= least) & (F.lit(True) if most is None else n <= most))


def filter_by_token_budget(df: DataFrame, column: str, budget: int, characters_a_token: float = 4.0) -> DataFrame:
    """Rows whose text is estimated to have at most so many tokens; null texts go."""
    return df.where(F.ceil(F.length(column) / characters_a_token) <= budget)


def drop_empty(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text holds something but white space."""
    return df.where(F.col(column).rlike(r"\S"))


def reverse(df: DataFrame, order_by) -> DataFrame:
    """The rows from the last in an order to the first."""
    return df.orderBy(*(F.desc(c) for c in ([order_by] if isinstance(order_by, str) else order_by)))


def select_dtypes(df: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The columns whose type names (as in dtypes) begin with one of the given ones."""
    return df.select(*(n for n, t in df.dtypes if any(t.startswith(k) for k in kinds)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, weight: rows / (classes * rows of the class), so that all classes weigh alike."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    all_ = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return sizes.join(F.broadcast(all_)).select(label, (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))  # one row


def column_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_null, has_nulls, all_null, n_unique: one pass, distinct values counted exactly."""
    parts = [F.struct(F.lit(x).alias("column"), F.count_if(F.col(x).isNull()).alias("n_null"), (F.count_if(F.col(x).isNull()) > 0).alias("has_nulls"), (F.count(x) == 0).alias("all_null"), F.count_distinct(x).alias("n_unique")) for x in columns]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))
