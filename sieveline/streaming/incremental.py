"""Extensions for unbounded input: incremental exact dedup and overlap with a static corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dedup_stream(rows: DataFrame, key: str = "h", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First row of each key; state older than the delay is dropped."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def overlap_stream(rows: DataFrame, known: DataFrame, key: str = "h") -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_semi")
