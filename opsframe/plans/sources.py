"""Test tables landed in the raw formats and read back through the readers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsframe import schemas
from opsframe.operators import cluster as oc, logs as ol, metrics as om, sessions as os_, traces as ot
from opsframe.plans.adapters import (
    DOCUMENT_MESSAGES_SQL,
    LINES_SQL,
    LOG_HITS_SQL,
    SAMPLES_SQL,
    SPANS_SQL,
    document_sessions,
    gpu,
    inventory,
    log_hits,
    log_lines,
    raw_traces,
    samples,
)
from opsframe.plans.cluster import _JOB_DETAILS_SQL
from opsframe.plans.metrics import _EXPORT_SQL
from opsframe.plans.registry import query
from opsframe.session import scratch_path
from opsframe.sources import readers
from opsframe.sources.sinks import write_metrics


@query("source_metric_dump", "S1", f"""
    SELECT metric, pod, instance, interface, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS second, value
    FROM ({SAMPLES_SQL})""")
def source_metric_dump(spark, sf):
    folder = scratch_path(spark, "metric-dump")
    labels = F.create_map(
        F.lit("__name__"), "metric", F.lit("pod"), "pod",
        F.lit("instance"), "instance", F.lit("interface"), "interface",
    )
    point = F.array((F.unix_micros("ts") / 1000000).cast("string"), F.col("value").cast("string"))
    samples(spark, sf).select(
        F.map_filter(labels, lambda _, v: v.isNotNull()).alias("metric"), F.array(point).alias("values")
    ).write.json(folder)
    return readers.read_metric_dump(spark, folder).select(
        "metric", "pod", "instance", "interface", F.unix_seconds("ts").alias("second"), "value"
    )


@query("source_log_pages", "S3 P11", f"""
    SELECT log_id, epoch_us(ts) / 1000000.0 AS timestamp, node_name, message FROM ({LOG_HITS_SQL})
    WHERE event_id % 13 <> 0 AND node_name IS NOT NULL""")
def source_log_pages(spark, sf):
    folder = scratch_path(spark, "log-pages")
    hit = F.struct("_id", "_source")
    log_hits(spark, sf).select(F.struct(F.array(hit).alias("hits")).alias("hits")).write.json(folder)
    landed = readers.read_log_hits(spark, folder)
    return ol.flatten_log_hits(landed).select("log_id", "timestamp", "node_name", "message")


@query("source_gpu_trace", "S6 J6", _JOB_DETAILS_SQL)
def source_gpu_trace(spark, sf):
    folder = scratch_path(spark, "gpu-trace")
    for name, file in readers.GPU_TRACE_FILES.items():
        rows = gpu(spark, sf, name)
        columns = [
            F.col(c.name) if c.name in rows.columns else F.lit(None).cast(c.dataType).alias(c.name)
            for c in StructType.fromDDL(schemas.GPU_TRACE[name])
        ]
        rows.select(*columns).write.option("header", True).option("compression", "gzip").csv(f"{folder}/{file}")
    tables = readers.read_gpu_trace(spark, folder)
    return oc.job_details(tables["job"], tables["task"], tables["instance"])


#: Rows of one landed document; a larger table makes more documents, not larger ones. Sessions are whole texts.
DOCUMENT_ROWS = 16_384
SESSION_ROWS = 512


def _documents(df, folder, name: str | None, rows: int = DOCUMENT_ROWS, broken: tuple[str, ...] = ()) -> None:
    """One JSON document per file, ``{name: [...]}`` of at most ``rows`` rows; and some that are none.

    Without a name the list itself is the document.

    A document is written line by line, each row on its own, so no task holds a whole one. Rows share a
    file by their place in the input, so equal rows do not meet.
    """
    if rows & (rows - 1):
        raise ValueError("rows must be a power of two, so that partitions begin new documents")
    told = df.select(F.to_json(F.struct(*df.columns)).alias("row"), F.monotonically_increasing_id().alias("_at"))
    placed = told.withColumn("_file", F.floor(F.col("_at") / rows).cast("long"))
    after = F.lead("_at").over(Window.partitionBy("_file").orderBy("_at"))
    first, last = ("[", "]") if name is None else (f'{{"{name}": [', "]}")
    opens = F.when(F.col("_at") % rows == 0, first).otherwise(",")
    line = F.concat(opens, "row", F.when(after.isNull(), last).otherwise(""))
    lines = placed.select("_file", "_at", line.alias("value")).sortWithinPartitions("_file", "_at")
    lines.select("_file", "value").write.partitionBy("_file").option("compression", "gzip").text(folder)
    bad = df.sparkSession.createDataFrame([(-1 - i, t) for i, t in enumerate(broken)], "_file long, value string")
    bad.write.mode("append").partitionBy("_file").text(folder)


@query("source_trace_dump", "S2", SPANS_SQL)
def source_trace_dump(spark, sf):
    folder = scratch_path(spark, "trace-dump")
    _documents(raw_traces(spark, sf), folder, "data", broken=('{"data": [{"tr',))
    return ot.flatten_spans(readers.read_trace_dump(spark, folder))


@query("source_sessions", "S4", DOCUMENT_MESSAGES_SQL)
def source_sessions(spark, sf):
    """Lists of sessions, one per file; files that are cut short or hold a wrong type are left out."""
    folder = scratch_path(spark, "sessions")
    bad = ('{"session_id": "cu', '{"session_id": "typed", "start_time": "noon"}')
    _documents(document_sessions(spark, sf), folder, None, SESSION_ROWS, bad)
    return os_.explode_sessions(readers.read_sessions(spark, folder))


@query("source_metrics_csv", "S5", _EXPORT_SQL)
def source_metrics_csv(spark, sf):
    folder = scratch_path(spark, "metrics-csv")
    write_metrics(om.export_metrics(samples(spark, sf), inventory(spark, sf)), folder, "csv")
    return readers.read_metrics_csv(spark, folder).drop("kpi")


@query("source_log_text", "S8", f"""
    SELECT line, count(*) AS lines FROM ({LINES_SQL}) GROUP BY line""")
def source_log_text(spark, sf):
    folder = scratch_path(spark, "log-text")
    log_lines(spark, sf).select("line").write.text(folder)
    read = readers.read_log_lines(spark, folder)
    return read.groupBy("line").agg(F.count("seq").alias("lines"))
