"""Trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions import spans as fs
from opsframe.operators import traces as ot
from opsframe.plans.adapters import SPANS_SQL, raw_traces
from opsframe.plans.registry import query, table
from opsframe.session import scratch_path
from opsframe.sources.readers import read_traces_csv
from opsframe.sources.sinks import write_spans

_DEDUPED_SQL = f"""
    SELECT * EXCLUDE (copy) FROM (
      SELECT *, row_number() OVER (PARTITION BY trace_id, span_id ORDER BY parent_span, service_name,
             operation_name, start_time, duration, has_error, response) AS copy FROM ({SPANS_SQL}))
    WHERE copy = 1"""
SINCE, UNTIL = 883_612_800_000_000, 978_307_200_000_000


@query("span_table", "N1 N2 N3 N4 N5", SPANS_SQL)
def span_table(spark, sf):
    return ot.flatten_spans(raw_traces(spark, sf))


@query("span_dedupe", "E9", _DEDUPED_SQL)
def span_dedupe(spark, sf):
    return ot.dedupe_spans(ot.flatten_spans(raw_traces(spark, sf)))


@query("span_service_lookup", "N2", f"""
    SELECT service_name, count(*) AS spans FROM ({SPANS_SQL}) GROUP BY service_name""")
def span_service_lookup(spark, sf):
    named = raw_traces(spark, sf).select("processes", F.explode("spans").alias("s")).select(
        fs.service_name(F.col("processes"), F.col("s.processID")).alias("service_name")
    )
    return named.groupBy("service_name").agg(F.count(F.lit(1)).alias("spans"))


@query("span_parents", "N3", f"""
    SELECT trace_id, span_id, parent_span FROM ({SPANS_SQL})""")
def span_parents(spark, sf):
    return raw_traces(spark, sf).select("traceID", F.explode("spans").alias("s")).select(
        F.col("traceID").alias("trace_id"),
        F.col("s.spanID").alias("span_id"),
        fs.parent_span(F.col("s.references")).alias("parent_span"),
    )


@query("span_errors", "N4 N5", f"""
    SELECT operation_name, has_error, response, count(*) AS spans FROM ({SPANS_SQL}) GROUP BY ALL""")
def span_errors(spark, sf):
    tagged = raw_traces(spark, sf).select(F.explode("spans").alias("s")).select(
        F.col("s.operationName").alias("operation_name"),
        fs.has_error(F.col("s.tags")).alias("has_error"),
        fs.response(F.col("s.tags")).alias("response"),
    )
    return tagged.groupBy("operation_name", "has_error", "response").agg(F.count(F.lit(1)).alias("spans"))


@query("span_write", "K2 S5", SPANS_SQL)
def span_write(spark, sf):
    folder = scratch_path(spark, "spans")
    write_spans(ot.flatten_spans(raw_traces(spark, sf)), folder, "csv")
    return read_traces_csv(spark, folder)


@query("trace_of_service", "E10", f"""
    SELECT trace_id, span_id, service_name, start_time FROM ({SPANS_SQL}) WHERE trace_id IN (
      SELECT trace_id FROM ({SPANS_SQL}) WHERE service_name = 'svc3'
        AND start_time >= {SINCE} AND start_time < {UNTIL})""")
def trace_of_service(spark, sf):
    return ot.spans_of_service(raw_traces(spark, sf), "svc3", SINCE, UNTIL).select(
        "trace_id", "span_id", "service_name", "start_time"
    )


@query("trace_of_service_latest", "E10 O3", f"""
    SELECT trace_id, span_id FROM ({SPANS_SQL}) WHERE trace_id IN (
      SELECT trace_id FROM ({SPANS_SQL}) WHERE service_name = 'svc3' AND start_time >= {SINCE}
      GROUP BY trace_id ORDER BY max(start_time) DESC, trace_id LIMIT 20)""")
def trace_of_service_latest(spark, sf):
    return ot.spans_of_service(raw_traces(spark, sf), "svc3", SINCE, limit=20).select("trace_id", "span_id")


@query("trace_union_services", "U2", f"""
    SELECT trace_id, span_id, service_name FROM ({SPANS_SQL}) WHERE trace_id IN (
      SELECT trace_id FROM ({SPANS_SQL}) WHERE service_name = 'svc1')
    UNION ALL
    SELECT trace_id, span_id, service_name FROM ({SPANS_SQL}) WHERE trace_id IN (
      SELECT trace_id FROM ({SPANS_SQL}) WHERE service_name = 'svc2')""")
def trace_union_services(spark, sf):
    spans = ot.flatten_spans(raw_traces(spark, sf))
    both = ot.traces_of_service(spans, "svc1").unionByName(ot.traces_of_service(spans, "svc2"))
    return both.select("trace_id", "span_id", "service_name")
