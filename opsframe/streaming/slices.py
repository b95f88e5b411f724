"""Windowed counts, boundary de-duplication and first-time-true, on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_log_slices(
    logs: DataFrame, slice_length: str = "5 minutes", delay: str = "10 minutes", key: str = "pod_name"
) -> DataFrame:
    """Logs per pod and slice; a slice is final once the watermark has passed its end.

    Counts are partial before the exchange, so a busy pod costs one row per task and slice.
    """
    counted = logs.withWatermark("ts", delay).groupBy(F.window("ts", slice_length), key).agg(
        F.count(F.lit(1)).alias("log_count")
    )
    return counted.select(
        F.unix_seconds(F.col("window.start")).alias("slice_start"), key, "log_count"
    )


def stream_dedupe(
    logs: DataFrame, keys: Sequence[str] = ("log_id",), delay: str | None = None
) -> DataFrame:
    """Rows repeated at the closed ends of neighbouring pulls, kept once.

    Every key comes out once whatever the order of arrival; the keys seen are kept for that. With
    ``delay`` they are forgotten after so long, and rows that arrive later than that are dropped.
    """
    if delay is None:
        return logs.dropDuplicates(list(keys))
    return logs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def first_true(rows: DataFrame, keys: Sequence[str], condition: Column, ts: str = "ts") -> DataFrame:
    """When the condition first held, per key; keys for which it has not yet are left out.

    The stream form of polling until something is seen; runs in update or complete mode.
    """
    return rows.filter(condition).groupBy(*keys).agg(F.min(ts).alias("since"))
