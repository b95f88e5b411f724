"""Operators that carry the previous row of each key between micro-batches.

Only the last row of a key is state. Within a micro-batch the neighbour comparison is done by the
engine's state operator on the rows of that key, so a batch's size bounds the memory of a task; set
``maxFilesPerTrigger`` (``max_files`` of the source) accordingly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsframe.functions.lines import TIMESTAMP_PATTERN, masked_key
from opsframe.functions.time import MICROS, epoch_micros

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LINE_OUT = "stream STRING, seq LONG, line STRING"
_PENDING = "seq LONG, line STRING, mask STRING"
_LAST_SAMPLE = "us LONG, value DOUBLE"


def use_state_store(spark) -> None:
    """The stateful processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _HoldLine(StatefulProcessor):
    """Keeps one line per stream back until the next one shows that it is not a repeat.

    Streams are many and have few lines each in a micro-batch, so lines are taken as plain rows: a
    frame per stream would cost more than its lines.
    """

    def __init__(self, flush_after_ms: int | None):
        self.flush_after_ms = flush_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", _PENDING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(((r.seq, r.line, r.mask) for r in rows), key=lambda line: line[0])
        held = self.pending.get()
        if held is not None:
            batch.insert(0, tuple(held))
        self.pending.update(batch[-1])
        self._arm(timerValues)
        for (seq, line, mask), (_, _, following) in zip(batch, batch[1:]):
            if mask is None or mask != following:
                yield Row(stream=key[0], seq=seq, line=line)

    def _arm(self, timerValues) -> None:
        if self.flush_after_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.flush_after_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            seq, line, _ = self.pending.get()
            self.pending.clear()
            yield Row(stream=key[0], seq=seq, line=line)

    def close(self) -> None:
        pass


def stream_compress(
    lines: DataFrame, flush_after_ms: int | None = None, pattern: str = TIMESTAMP_PATTERN
) -> DataFrame:
    """Single-line compression on a stream of ``(stream, seq, line)`` that arrives in ``seq`` order.

    One line per stream is held back; a stream that stays silent for ``flush_after_ms`` gives it
    out. Masks are computed before the state operator, by the engine.
    """
    keyed = lines.select("stream", "seq", "line", masked_key(F.col("line"), pattern).alias("mask"))
    return keyed.groupBy("stream").transformWithState(
        _HoldLine(flush_after_ms),
        outputStructType=LINE_OUT,
        outputMode="Append",
        timeMode="none" if flush_after_ms is None else "processingTime",
    )


class _LastSample(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _LAST_SAMPLE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        order = ["us", "sample_id"]
        batch = pd.concat(list(rows)).sort_values(order, kind="stable")
        us, value = batch["us"].astype("int64"), batch["value"].astype("float64")
        before_us, before = us.shift(1), value.shift(1)
        if self.last.exists():
            held_us, held = self.last.get()
            before_us.iloc[0], before.iloc[0] = held_us, held
        gap = us - before_us
        rise = (value - before).where(value >= before, value)
        out = pd.DataFrame({
            "series": key[0], "us": us, "sample_id": batch["sample_id"], "rate": rise * MICROS / gap,
        })
        # A late sample is rated against nothing newer, and never takes the place of a newer one.
        if not self.last.exists() or int(us.iloc[-1]) >= held_us:
            self.last.update((int(us.iloc[-1]), float(value.iloc[-1])))
        yield out[gap > 0]

    def close(self) -> None:
        pass


def stream_counter_rate(samples: DataFrame, series: str = "series") -> DataFrame:
    """Per-second rate of each sample against the one before it, whenever that arrived."""
    named = samples.select(
        F.col(series).cast("string").alias("series"),
        epoch_micros(F.col("ts")).alias("us"),
        F.col("sample_id").cast("long").alias("sample_id"),
        F.col("value").cast("double").alias("value"),
    )
    return named.groupBy("series").transformWithStateInPandas(
        _LastSample(),
        outputStructType="series STRING, us LONG, sample_id LONG, rate DOUBLE",
        outputMode="Append",
        timeMode="none",
    )
