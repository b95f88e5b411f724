"""Timestamps: parsing, zones and epoch numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

DEFAULT_ZONE = "Asia/Shanghai"
MICROS = 1_000_000


def to_ts(value: Column, kind: str) -> Column:
    """Timestamp from ``kind`` = ``epoch`` (number), ``digits`` (text of a number) or ``timestamp``."""
    if kind == "epoch":
        return F.timestamp_seconds(value.cast("long"))
    if kind == "digits":
        return F.timestamp_seconds(F.trim(value).try_cast("long"))
    if kind == "timestamp":
        return value.cast("timestamp")
    raise ValueError(f"unknown timestamp kind: {kind}")


def bound(value, like: DataType) -> Column:
    """A range bound in the type of the column it is compared with, so that the scan gets the filter.

    A naive ``datetime`` is read in the session zone, not in that of the driver's machine.
    """
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast(like)
    return F.lit(value)


def in_zone(ts: Column, zone: str = DEFAULT_ZONE, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Wall-clock text of an instant in a named zone (session zone is UTC)."""
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def parse_landed(text: Column) -> Column:
    """Instant from ISO text ``2024-01-01T00:00:00.123Z``; NULL when it does not have that shape.

    Any 1-6 digit fraction is accepted, as is none of the looser forms a plain cast would take.
    """
    shaped = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}Z$")
    return F.when(shaped, text.try_cast("timestamp"))
