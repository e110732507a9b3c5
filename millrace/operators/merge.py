"""Upserts, change data and slowly changing dimensions as joins of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Merge:
    """MERGE INTO target USING source ON keys, in the order of the clauses; result() is the new table."""

    def __init__(self, target: DataFrame, source: DataFrame, keys: Sequence[str]):
        self.target, self.source, self.keys = target, source, list(keys)
        self.matched: list[tuple[Column, dict[str, Column] | None]] = []
        self.unmatched: list[Column] = []
        self.orphaned: list[tuple[Column, dict[str, Column] | None]] = []

    @staticmethod
    def t(column: str) -> Column:
        return F.col(f"t.{column}")

    @staticmethod
    def s(column: str) -> Column:
        return F.col(f"s.{column}")

    def when_matched_update(self, values: dict[str, Column] | None = None, condition: Column | None = None) -> Merge:
        """values by column; by default every column of the source."""
        values = values if values is not None else {c: self.s(c) for c in self.source.columns if c not in self.keys}
        self.matched.append((F.lit(True) if condition is None else condition, values))
        return self

    def when_matched_delete(self, condition: Column | None = None) -> Merge:
        self.matched.append((F.lit(True) if condition is None else condition, None))
        return self

    def when_not_matched_insert(self, condition: Column | None = None) -> Merge:
        self.unmatched.append(F.lit(True) if condition is None else condition)
        return self

    def when_not_matched_by_source_delete(self, condition: Column | None = None) -> Merge:
        self.orphaned.append((F.lit(True) if condition is None else condition, None))
        return self

    def when_not_matched_by_source_update(self, values: dict[str, Column], condition: Column | None = None) -> Merge:
        self.orphaned.append((F.lit(True) if condition is None else condition, values))
        return self

    def result(self) -> DataFrame:
        """Raises while running if one target row matches several source rows."""
        w = Window.partitionBy(*self.keys)
        source = self.source.withColumn("_times", F.count("*").over(w)).withColumn("_in_s", F.lit(True))
        target = self.target.withColumn("_in_t", F.lit(True))
        on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in self.keys]
        both = target.alias("t").join(source.alias("s"), on, "full")
        in_t, in_s = F.col("t._in_t").isNotNull(), F.col("s._in_s").isNotNull()
        twice = F.when(in_t & in_s & (F.col("s._times") > 1), F.raise_error(F.lit("a row matches several source rows")).isNotNull()).otherwise(F.lit(True))
        keep = F.lit(True)
        for cond, values in reversed(self.matched):
            keep = F.when(in_t & in_s & cond, F.lit(values is not None)).otherwise(keep)
        for cond, values in reversed(self.orphaned):
            keep = F.when(in_t & ~in_s & cond, F.lit(values is not None)).otherwise(keep)
        insert = F.lit(False)
        for cond in self.unmatched:
            insert = insert | cond
        keep = F.when(~in_t, insert).otherwise(keep)
        out = []
        for c in self.target.columns:
            new = self.t(c)
            for cond, values in reversed(self.matched):
                if values is not None and c in values:
                    new = F.when(in_t & in_s & cond, values[c]).otherwise(new)
                else:
                    new = F.when(in_t & in_s & cond, self.t(c)).otherwise(new)
            for cond, values in reversed(self.orphaned):
                new = F.when(in_t & ~in_s & cond, values[c] if values and c in values else self.t(c)).otherwise(new)
            fresh = self.s(c) if c in self.source.columns else F.lit(None)
            out.append(F.when(in_t, new).otherwise(fresh).alias(c))
        return both.where(twice & keep).select(*out)


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], order_by: str, operation: str = "op") -> DataFrame:
    """The last change of each key: 'D' deletes, anything else replaces the row."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order_by))
    last = changes.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    kept = target.join(last.select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(last.where(F.col(operation) != "D").select(*target.columns))


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys with change: insert, delete or update."""
    others = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*others).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(*keys, F.struct(*others).alias("_b"), F.lit(True).alias("_in_b"))
    kind = F.when(F.col("_in_a").isNull(), "insert").when(F.col("_in_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return a.join(b, list(keys), "full").select(*keys, kind.alias("change")).where("change is not null")


def scd2(history: DataFrame, snapshot: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """Type-2 history (valid_from, valid_to, is_current) after a snapshot: changed and vanished rows close, changed and new ones open."""
    attributes = [c for c in snapshot.columns if c not in keys]
    current, past = history.where("is_current"), history.where("not is_current")
    change = diff(current.select(*snapshot.columns), snapshot, keys)
    touched = current.join(change.where("change <> 'insert'").select(*keys), list(keys), "left_semi").withColumns({"valid_to": at, "is_current": F.lit(False)})
    same = current.join(change.select(*keys), list(keys), "left_anti")
    opened = snapshot.join(change.where("change <> 'delete'").select(*keys), list(keys), "left_semi").select(*keys, *attributes, at.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"), F.lit(True).alias("is_current"))
    return past.unionByName(touched.select(*past.columns)).unionByName(same.select(*past.columns)).unionByName(opened.select(*past.columns))
