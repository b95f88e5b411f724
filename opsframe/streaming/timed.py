"""Stateful operators driven by event time: what they hold back comes out once the watermark says so.

All of them take rows with a ``ts``. A row whose key is null is a *tick*: it moves the watermark on and
is otherwise ignored, so that a feed that falls silent can still be brought to its end. Output depends
on the rows and on how they were dealt to micro-batches, never on the time of day.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsframe.functions.lines import TIMESTAMP_PATTERN, masked_key
from opsframe.streaming.stateful import LINE_OUT

#: Numbers of a stream that form one key. It bounds the rows that a call of the processor sees.
LINES_PER_KEY = 4_096
_HELD = "seq LONG, line STRING, mask STRING"


def _milliseconds(df: DataFrame, duration: str) -> int:
    """A duration as text, in milliseconds; months have no fixed length and are refused by the cast."""
    spark = df.sparkSession
    micros = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL '{duration}')").first()[0]
    return micros // 1000


def _rearm(handle: StatefulProcessorHandle, at: int | None) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if at is not None:
        handle.registerTimer(at)


class _HoldLine(StatefulProcessor):
    """One stretch of a stream: the last line is kept until its successor or a long silence."""

    def __init__(self, flush_after_ms: int, lines_per_key: int):
        self.flush_after_ms, self.lines_per_key = flush_after_ms, lines_per_key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", _HELD)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        held = self.pending.get()
        if held is None or initialState.seq >= held[0]:
            self.pending.update((initialState.seq, initialState.line, initialState.mask))
            _rearm(self.handle, initialState.ms + self.flush_after_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        lines, latest = [], None
        for row in rows:
            if key[0] is not None:
                lines.append((row.seq, row.line, row.mask))
                latest = row.ms if latest is None else max(latest, row.ms)
        if not lines:
            return
        if len(lines) > self.lines_per_key + 1:
            raise ValueError(f"numbers of stream {key[0]!r} repeat: {len(lines)} lines in {self.lines_per_key} numbers")
        held = self.pending.get()
        if held is not None:
            lines.insert(0, tuple(held))
        lines.sort(key=lambda line: line[0])
        last = lines[-1]
        if last[0] // self.lines_per_key != key[1]:  # the next stretch has begun
            self.pending.clear()
            _rearm(self.handle, None)
        else:
            self.pending.update(last)
            _rearm(self.handle, latest + self.flush_after_ms)
        for (seq, line, mask), (_, _, following) in zip(lines, lines[1:]):
            if (mask is None or mask != following) and seq != last[0]:
                yield Row(stream=key[0], seq=seq, line=line)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            seq, line, _ = self.pending.get()
            self.pending.clear()
            yield Row(stream=key[0], seq=seq, line=line)

    def close(self) -> None:
        pass


def _stretches(lines: DataFrame, lines_per_key: int, pattern: str) -> DataFrame:
    """Lines by stretches of numbers; the first line of a stretch also ends the one before it."""
    own = F.floor(F.col("seq") / lines_per_key)
    both = F.when(F.col("seq") % lines_per_key == 0, F.array(own - 1, own)).otherwise(F.array(own))
    return lines.select(
        "stream", "seq", "line", masked_key(F.col("line"), pattern).alias("mask"),
        F.unix_millis("ts").alias("ms"), "ts", F.explode(F.coalesce(both, F.array(F.lit(0).cast("long")))).alias("stretch"),
    ).filter("stretch >= 0")


def stream_compress_flushed(
    lines: DataFrame,
    flush_after: str,
    delay: str = "10 minutes",
    before: DataFrame | None = None,
    lines_per_key: int = LINES_PER_KEY,
    pattern: str = TIMESTAMP_PATTERN,
) -> DataFrame:
    """Single-line compression of ``(stream, seq, line, ts)``, numbered without gaps, in order of arrival.

    A stream is dealt in stretches of its numbers, so a busy stream is many keys and no call sees more
    than a stretch; a stretch forgets its state once the next has begun. The last line of all comes out
    when the watermark has passed it by ``flush_after``. ``before``, of the same columns, are lines that
    were held back elsewhere (a batch answer's last line per stream), to go on from.
    """
    held = None
    if before is not None:
        last = before.select("stream", "seq", "line", "ts")
        shaped = _stretches(last, lines_per_key, pattern).filter(F.col("stretch") == F.floor(F.col("seq") / lines_per_key))
        held = shaped.drop("ts").groupBy("stream", "stretch")
    return _stretches(lines.withWatermark("ts", delay), lines_per_key, pattern).groupBy("stream", "stretch").transformWithState(
        _HoldLine(_milliseconds(lines, flush_after), lines_per_key),
        outputStructType=LINE_OUT,
        outputMode="Append",
        timeMode="eventTime",
        initialState=held,
    )


class _TellOnce(StatefulProcessor):
    """Tells of a key the first time it is met, and forgets it after a while without news."""

    def __init__(self, forget_after_ms: int, columns: list[str]):
        self.forget_after_ms, self.columns = forget_after_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "since LONG")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, latest = None, None
        for row in rows:  # one row at a time; only two numbers are carried on
            first = row.us if first is None else min(first, row.us)
            latest = row.us if latest is None else max(latest, row.us)
        if first is None or key[0] is None:
            return
        new = not self.told.exists()
        if new:
            self.told.update((first,))
        _rearm(self.handle, latest // 1000 + self.forget_after_ms)
        if new:
            yield Row(**dict(zip([*self.columns, "since_us"], [*key, first])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.told.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_true_once(
    rows: DataFrame, keys: Sequence[str], condition: Column, forget_after: str, delay: str = "10 minutes"
) -> DataFrame:
    """When the condition first held, one row per key as soon as it does and none after.

    Rows arrive in order of time up to ``delay``. A key for which the condition has not held for
    ``forget_after`` leaves the state, so that a later rise is told anew. Ticks pass whatever the
    condition says of them.
    """
    kinds = dict(rows.dtypes)
    wanted = rows.withWatermark("ts", delay).filter(condition | F.col(keys[0]).isNull())
    return (
        wanted.select(*keys, "ts", F.unix_micros("ts").alias("us")).groupBy(*keys)
        .transformWithState(
            _TellOnce(_milliseconds(rows, forget_after), list(keys)),
            outputStructType=", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "since_us LONG"]),
            outputMode="Append",
            timeMode="eventTime",
        )
        .select(*keys, F.timestamp_micros("since_us").alias("since"))
    )
