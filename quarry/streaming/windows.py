"""Streaming forms of the grouped operators: the same results as in batch, kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and keys; a window is final once the watermark passes it."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def rolled_up(stream: DataFrame, ts: str, size: str, by: list[str], aggregates: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w, *by).agg(*[c.alias(k) for k, c in aggregates.items()]).select(F.col("window.start").alias("start"), *by, *aggregates)


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key's first row within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
