"""Log operators: flattening, selection, volume counts and day partitions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from opsframe.functions.logs import has_error_text, normalize_message
from opsframe.functions.time import MICROS, bound, parse_landed
from opsframe.operators.ordered import first_n, number_rows

SLICE_ROWS = 7_500

# period -> (days back from now, counting unit)
VOLUME_PERIODS = {"one_day": (1, "hour"), "one_week": (7, "day"), "two_weeks": (14, "day")}

LOG_COLUMNS = [
    "log_id", "timestamp", "date", "pod_name", "container_name", "namespace", "node_name", "message",
]


def _flat(hits: DataFrame) -> DataFrame:
    source = F.col("_source")
    k8s = source["kubernetes"]
    at = parse_landed(source["@timestamp"])
    flat = hits.select(
        F.col("_id").alias("log_id"),
        (F.unix_micros(at) / MICROS).alias("timestamp"),
        source["@timestamp"].alias("date"),
        k8s["pod"]["name"].alias("pod_name"),
        k8s["container"]["name"].alias("container_name"),
        k8s["namespace"].alias("namespace"),
        k8s["node"]["name"].alias("node_name"),
        source["message"].alias("message"),
    )
    missing = [
        F.when(F.col(c).isNull(), F.lit(c)) for c in LOG_COLUMNS if c != "timestamp"
    ]
    reason = F.coalesce(
        F.concat(F.lit("missing "), F.coalesce(*missing)),
        F.when(F.col("timestamp").isNull(), F.lit("bad timestamp")),
    )
    return flat.withColumn("reason", reason)


def flatten_log_hits(hits: DataFrame) -> DataFrame:
    """Complete hits as the 8-column log table."""
    return _flat(hits).filter(F.col("reason").isNull()).drop("reason")


def rejected_log_hits(hits: DataFrame) -> DataFrame:
    """The other hits, each with the first reason it was turned down for."""
    return _flat(hits).filter(F.col("reason").isNotNull())


def logs_of_known_pods(logs: DataFrame, inventory: DataFrame) -> DataFrame:
    """5-column form of the logs of inventoried pods, with shortened messages."""
    pods = inventory.select(F.col("pod").alias("pod_name"))
    return logs.join(pods, "pod_name", "left_semi").select(
        "log_id",
        "timestamp",
        "date",
        F.col("pod_name").alias("cmdb_id"),
        normalize_message(F.col("message")).alias("message"),
    )


def error_streams(logs: DataFrame, stream: str = "pod_name") -> DataFrame:
    """Per stream: does any message speak of an error, and since when."""
    bad = has_error_text(F.col("message"))
    return logs.groupBy(stream).agg(
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("has_error"),
        F.min(F.when(bad, F.col("timestamp"))).alias("first_error"),
    )


def log_volume(logs: DataFrame, now: datetime, period: str, ts: str = "ts") -> DataFrame:
    """Log counts per hour (one day back) or per day (one or two weeks back); else no rows.

    Whole hours are counted: an hour takes part when it *starts* inside the window.
    """
    at = F.col(ts).cast("timestamp")
    if period not in VOLUME_PERIODS:
        return logs.groupBy(F.date_trunc("hour", at).alias("date")).agg(
            F.count(F.lit(1)).alias("log_count")
        ).limit(0)
    days, unit = VOLUME_PERIODS[period]
    since = now - timedelta(days=days)
    # The first condition follows from the second, and is one the scan can use.
    recent = logs.filter(
        (F.col(ts) >= bound(since, logs.schema[ts].dataType))
        & (F.date_trunc("hour", at) >= bound(since, TimestampType()))
    )
    return recent.groupBy(F.date_trunc(unit, at).alias("date")).agg(
        F.count(F.lit(1)).alias("log_count")
    )


def expand_days(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per calendar day an interval touches, with the interval cut to that day."""
    first, last = F.col(start).cast("timestamp"), F.col(end).cast("timestamp")
    midnight = F.col("_day").cast("timestamp")
    day_end = midnight + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    days = F.sequence(F.to_date(first), F.to_date(last), F.expr("INTERVAL 1 DAY"))
    return (
        spans.filter(first <= last)
        .withColumn("_day", F.explode(days))
        .withColumn("day", F.date_format("_day", "yyyy-MM-dd"))
        .withColumn("day_start", F.greatest(first, midnight))
        .withColumn("day_end", F.least(last, day_end))
        .drop("_day")
    )


def select_days(logs: DataFrame, start: datetime, end: datetime, day: str = "day") -> DataFrame:
    """Day partitions overlapping ``[start, end]``; a plain range, so the scan prunes folders."""
    return logs.filter(F.col(day).between(F.lit(start.date()), F.lit(end.date())))


def logs_of_spans(logs: DataFrame, spans: DataFrame, ts: str = "ts", day: str = "day") -> DataFrame:
    """Logs inside any of the intervals (``start``, ``end``, closed), of day folders found at run time.

    The days come from the intervals themselves, which may be the answer of another query. Joined on
    the folder column, the scan lists and reads only these days once they are known. Intervals are cut
    by the hour and overlapping ones merged, so that a log comes out once and meets those of its hour.
    """
    whole, hour = F.expr("INTERVAL 1 HOUR"), F.col("_hour")
    hours = F.sequence(F.date_trunc("hour", "day_start"), F.date_trunc("hour", "day_end"), whole)
    cut = expand_days(spans).withColumn("_hour", F.explode(hours)).select(
        F.col("day").cast("date").alias(day),
        "_hour",
        F.greatest("day_start", hour).alias("_from"),
        F.least("day_end", hour + whole - F.expr("INTERVAL 1 MICROSECOND")).alias("_to"),
    ).distinct()
    order = Window.partitionBy(day, "_hour").orderBy("_from", "_to")
    reached = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = cut.withColumn("_new", (reached.isNull() | (F.col("_from") > reached)).cast("int"))
    parted = parted.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parted.groupBy(day, "_hour", "_run").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    wanted = merged.groupBy(day, "_hour").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))
    at = F.col(ts).cast("timestamp")
    inside = F.exists("_spans", lambda s: (at >= s["_from"]) & (at <= s["_to"]))
    placed = logs.withColumn("_hour", F.date_trunc("hour", at))
    return placed.join(wanted, [day, "_hour"]).filter(inside).select(*logs.columns)


def first_n_per_day(
    logs: DataFrame, n: int = SLICE_ROWS, ts: str = "ts", tie: str = "log_id"
) -> DataFrame:
    """The ``n`` oldest logs of each day."""
    dated = logs.withColumn("day", F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd"))
    return first_n(dated, ["day"], [F.col(ts), F.col(tie)], n)


def _slice_start(ts: str, slice_length: str):
    return F.window(F.col(ts).cast("timestamp"), slice_length)["start"]


def first_n_per_slice(
    logs: DataFrame, n: int = SLICE_ROWS, slice_length: str = "5 minutes", ts: str = "ts", tie: str = "log_id"
) -> DataFrame:
    """The ``n`` oldest logs of each slice of each day, so that no slice loses rows to an earlier one."""
    dated = logs.withColumn("day", F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd")).withColumn(
        "slice_start", _slice_start(ts, slice_length)
    )
    return first_n(dated, ["day", "slice_start"], [F.col(ts), F.col(tie)], n)


def renumber_slices(
    logs: DataFrame, slice_length: str = "5 minutes", ts: str = "ts", tie: str = "log_id"
) -> DataFrame:
    """Stacked slices with ``row``, dense from 0 over all of them in time order.

    A slice is numbered on its own and starts after the counts of the slices before it, so only one
    row per slice meets in one task.
    """
    return number_rows(logs, [], [F.col(ts), F.col(tie)], _slice_start(ts, slice_length), "row")
