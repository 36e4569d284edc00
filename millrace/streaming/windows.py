"""Event-time windows, for streams and, with the same code, for batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def windowed(df: DataFrame, time: str, size: str, slide: str | None, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Tumbling (no slide) or sliding windows; `late` is how long late rows are waited for."""
    if late and df.isStreaming:
        df = df.withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(w.alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    if late and df.isStreaming:
        df = df.withWatermark(time, late)
    out = df.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *[c for c in out.columns if c != "_w"])


def first_only(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; on a stream, among rows that arrive within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
