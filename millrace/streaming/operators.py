"""Streaming forms of the event-time operators; each also runs on a batch DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, width: str, aggregates: Sequence[Column], by: Sequence[str] = (), slide: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """window_start and window_end with aggregates of tumbling or sliding windows."""
    marked = events.withWatermark(time, lateness) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return marked.groupBy(w.alias("w"), *by).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "*").drop("w")


def session_windows(events: DataFrame, time: str, gap: str, aggregates: Sequence[Column], by: Sequence[str], lateness: str = "0 seconds") -> DataFrame:
    """Sessions end a gap after their last event; session_end is that event's time."""
    marked = events.withWatermark(time, lateness) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), *aggregates)
    return grouped.drop("w")


def deduplicated(events: DataFrame, keys: Sequence[str], time: str, lateness: str) -> DataFrame:
    """Within the watermark on a stream, overall on a batch."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def interval_joined(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, within: str, lateness: str = "0 seconds", how: str = "inner") -> DataFrame:
    """Events with equal keys at most an interval apart; state is kept only as long as the watermarks need it."""
    a, b = (d.withWatermark(t, lateness) if d.isStreaming else d for d, t in ((left, left_time), (right, right_time)))
    a, b = a.alias("l"), b.alias("r")
    gap = F.expr(f"INTERVAL {within}")
    cond = (F.col(f"r.{right_time}") >= F.col(f"l.{left_time}") - gap) & (F.col(f"r.{right_time}") <= F.col(f"l.{left_time}") + gap)
    for k in on:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return a.join(b, cond, {"inner": "inner", "left": "leftOuter", "right": "rightOuter", "full": "fullOuter"}[how])


def run_available(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> DataFrame:
    """Process what a stream has now into Parquet, exactly once under its checkpoint, and read it back."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
