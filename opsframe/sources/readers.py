"""Landed files to DataFrames. Every schema is declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe import schemas
from opsframe.operators.ordered import number_rows

# Separators other than LF, CR and CRLF, which the text source splits at itself.
_RARE_BREAK = r"[\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"

# File names of the cluster trace.
GPU_TRACE_FILES = {
    "job": "pai_job_table.csv",
    "task": "pai_task_table.csv",
    "instance": "pai_instance_table.csv",
    "sensor": "pai_sensor_table.csv",
    "machine_spec": "pai_machine_spec.csv",
    "machine_metric": "pai_machine_metric.csv",
    "group_tag": "pai_group_tag_table.csv",
}


def explode_metric_dump(dump: DataFrame) -> DataFrame:
    """Range results to long samples: text values to numbers, times to whole seconds.

    ``ts`` is that second as a timestamp; ``sample_id`` is the position in the result.
    """
    label = lambda key: F.try_element_at("metric", F.lit(key))
    return (
        dump.select("metric", F.posexplode("values").alias("sample_id", "point"))
        .withColumn("timestamp", F.col("point")[0].cast("double").cast("long"))
        .select(
            label("__name__").alias("metric"),
            label("pod").alias("pod"),
            label("instance").alias("instance"),
            label("namespace").alias("namespace"),
            label("interface").alias("interface"),
            F.col("metric").alias("labels"),
            F.xxhash64(F.array_sort(F.map_entries("metric"))).alias("series_id"),
            F.timestamp_seconds("timestamp").alias("ts"),
            F.col("sample_id").cast("long").alias("sample_id"),
            F.col("point")[1].try_cast("double").alias("value"),
        )
    )


_PAGE = f"hits STRUCT<hits: ARRAY<STRUCT<{schemas.LOG_HIT_FIELDS}>>>"


def _landed_json(spark: SparkSession, path: str, schema: str, whole_files: bool = False) -> DataFrame:
    """JSON rows with ``_corrupt_record``: the text of a row that is cut short or has a wrong type."""
    read = spark.read.schema(f"{schema}, _corrupt_record STRING")
    return read.option("multiLine", whole_files).json(path)


def _unread(landed: DataFrame) -> Column:
    """True on rows that could not be read whole.

    A field is only checked if it is read, so all declared ones are looked at; otherwise it would
    depend on the columns a query selects whether a row counts as readable.
    """
    declared = [c for c in landed.columns if c != "_corrupt_record"]
    parsed = F.length(F.coalesce(F.to_json(F.struct(*declared)), F.lit(""))) >= 0
    return F.when(F.col("_corrupt_record").isNotNull(), parsed).otherwise(False)


def _readable(landed: DataFrame) -> DataFrame:
    return landed.filter(~_unread(landed)).drop("_corrupt_record")


def _rejected(landed: DataFrame) -> DataFrame:
    """``file`` and ``text`` of the rows that are not in the readable part."""
    return landed.filter(_unread(landed)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_corrupt_record").alias("text")
    )


def read_metric_dump(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line: ``{"metric": {labels}, "values": [[ts, "value"], ...]}``."""
    return explode_metric_dump(_readable(_landed_json(spark, path, schemas.METRIC_DUMP)))


def rejected_metric_dump(spark: SparkSession, path: str) -> DataFrame:
    return _rejected(_landed_json(spark, path, schemas.METRIC_DUMP))


def read_trace_dump(spark: SparkSession, path: str) -> DataFrame:
    """Trace-API responses, one per file, to raw traces."""
    return _readable(_landed_json(spark, path, schemas.TRACE_RESPONSE, True)).select(F.inline("data"))


def rejected_trace_dump(spark: SparkSession, path: str) -> DataFrame:
    return _rejected(_landed_json(spark, path, schemas.TRACE_RESPONSE, True))


def read_log_hits(spark: SparkSession, path: str) -> DataFrame:
    """Search pages ``{"hits": {"hits": [...]}}``, one per line, to single hits."""
    return _readable(_landed_json(spark, path, _PAGE)).select(F.inline("hits.hits"))


def rejected_log_pages(spark: SparkSession, path: str) -> DataFrame:
    return _rejected(_landed_json(spark, path, _PAGE))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session files, one JSON object each; ``unreadable_sessions`` has all others."""
    return _readable(_landed_json(spark, path, schemas.SESSION, True))


def unreadable_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The files left out, with their text: no JSON, cut short, or with a field of a wrong type."""
    return _rejected(_landed_json(spark, path, schemas.SESSION, True))


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.KPI_TABLE).option("header", True).csv(path)


def read_traces_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SPAN_TABLE).option("header", True).csv(path)


def read_gpu_trace(spark: SparkSession, folder: str, header: bool = True) -> dict[str, DataFrame]:
    return {
        name: spark.read.schema(schemas.GPU_TRACE[name])
        .option("header", header)
        .csv(f"{folder.rstrip('/')}/{file}")
        for name, file in GPU_TRACE_FILES.items()
    }


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw log files to ``(stream, seq, line)``, one stream per file.

    Files are split for reading, so one huge file is many tasks; positions within the splits are
    tied together by the number of lines of the splits before.
    """
    # The row ids only order rows of one split; they grow in reading order inside a task.
    landed = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("stream"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )
    lines = landed.select(
        "stream", "_block", "_row",
        F.posexplode(F.split("value", _RARE_BREAK, -1)).alias("_part", "line"),
    )
    order = [F.col("_row"), F.col("_part")]
    return number_rows(lines, ["stream"], order, F.col("_block")).select("stream", "seq", "line")


def stream_source(
    spark: SparkSession,
    folder: str,
    schema,
    fmt: str = "json",
    max_files: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Tail a folder of landed files; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)
