"""Trace operators: nested traces to spans, one row per span, traces of a service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions import spans as fs

UTILITY_SERVICE = "jaeger-all-in-one"


def flatten_spans(traces: DataFrame) -> DataFrame:
    """Raw traces to the 9-column span table, one row per landed span."""
    span = F.col("span")
    return traces.select("traceID", "processes", F.explode("spans").alias("span")).select(
        F.col("traceID").alias("trace_id"),
        span["spanID"].alias("span_id"),
        fs.parent_span(span["references"]).alias("parent_span"),
        fs.service_name(F.col("processes"), span["processID"]).alias("service_name"),
        span["operationName"].alias("operation_name"),
        span["startTime"].alias("start_time"),
        span["duration"].alias("duration"),
        fs.has_error(span["tags"]).alias("has_error"),
        fs.response(span["tags"]).alias("response"),
    )


def dedupe_spans(spans: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """One row per (trace, span): a trace is landed once for every service it touches.

    Copies are cut to one per map task before the exchange, so a heavily copied trace is cheap.
    """
    if keep_duplicates:
        return spans
    rest = [c for c in spans.columns if c not in ("trace_id", "span_id")]
    copies = Window.partitionBy("trace_id", "span_id").orderBy(*rest)
    return spans.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1").drop("_copy")


def traces_of_service(
    spans: DataFrame,
    service: str,
    since: int | None = None,
    until: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """All spans of the traces with a span of ``service`` that starts in ``[since, until)``.

    ``limit`` keeps the traces whose matching span starts last. The utility service has none.
    """
    hit = (F.col("service_name") == service) & (F.col("service_name") != UTILITY_SERVICE)
    if since is not None:
        hit &= F.col("start_time") >= since
    if until is not None:
        hit &= F.col("start_time") < until
    wanted = spans.filter(hit).groupBy("trace_id").agg(F.max("start_time").alias("_latest"))
    if limit is not None:
        wanted = wanted.orderBy(F.desc("_latest"), "trace_id").limit(limit)
    return spans.join(wanted.select("trace_id"), "trace_id", "left_semi")


def spans_of_service(
    traces: DataFrame,
    service: str,
    since: int | None = None,
    until: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``traces_of_service`` on raw nested traces.

    Which traces are wanted is read off the nested spans, without their tags and references; a trace
    can be landed in several parts, so the other parts of a wanted one come in by its id. Spans are
    taken apart once, and flat ones are exchanged: of these only the columns asked for travel and are
    worked out, while nested traces would travel whole.
    """

    def hit(span):
        wanted = span["startTime"].isNotNull() if limit is not None else F.lit(True)
        if since is not None:
            wanted &= span["startTime"] >= since
        if until is not None:
            wanted &= span["startTime"] < until
        return wanted & (fs.service_name(F.col("processes"), span["processID"]) == service)

    if service == UTILITY_SERVICE:
        return flatten_spans(traces.filter("false"))
    met = traces.filter(F.exists("spans", hit))
    if limit is None:
        wanted = met.select("traceID").distinct()
    else:
        latest = F.array_max(F.transform(F.filter("spans", hit), lambda span: span["startTime"]))
        newest = met.groupBy("traceID").agg(F.max(latest).alias("_latest"))
        wanted = newest.orderBy(F.desc("_latest"), "traceID").limit(limit).select("traceID")
    return flatten_spans(traces).join(wanted.withColumnRenamed("traceID", "trace_id"), "trace_id", "left_semi")
