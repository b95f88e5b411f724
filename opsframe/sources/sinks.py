"""Writers. Rows are rebalanced by folder before a partitioned write: each task writes few folders,
a folder with too many rows is split over several tasks and files, and small ones are put together.
Unlike a range partitioning this needs no sampling pass over the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.session import landed


def write_metrics(table: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Append the KPI table, one folder per metric, each file in time order."""
    (
        table.withColumn("kpi", F.split_part("kpi_name", F.lit("."), F.lit(1)))
        .hint("rebalance", F.col("kpi"))
        .sortWithinPartitions("kpi", "timestamp")
        .write.partitionBy("kpi").mode("append").format(fmt).option("header", True).save(folder)
    )


KPI_KEY = ("timestamp", "cmdb_id", "kpi_name")


def merge_metrics(chunk: DataFrame, folder: str) -> None:
    """Put a chunk of the KPI table into its folders by metric and day, each key once.

    A chunk closed at both ends repeats rows of the chunk before, and a chunk that is landed again
    repeats all of its own; either leaves one row per key, with the value of the newest chunk (the
    largest of those in it). Only the days that the chunk has are read and written anew, and a day is
    replaced as a whole when all of it is ready. One writer at a time.
    """
    spark = chunk.sparkSession
    day = F.date_format(F.timestamp_seconds("timestamp"), "yyyyMMdd")
    placed = landed(
        chunk.withColumns({"kpi": F.split_part("kpi_name", F.lit("."), F.lit(1)), "day": day}), "chunk"
    )
    schema = T.StructType([*(f for f in placed.schema if f.name not in ("kpi", "day")), placed.schema["kpi"], placed.schema["day"]])
    rows = placed.withColumn("_new", F.lit(True))
    if has_files(spark, folder):
        touched = placed.select("kpi", "day").distinct()
        there = spark.read.schema(schema).parquet(folder).join(touched, ["kpi", "day"], "left_semi")
        rows = rows.unionByName(there.withColumn("_new", F.lit(False)))
    values = [c for c in chunk.columns if c not in KPI_KEY]
    best = F.max(F.struct("_new", *values)).alias("_best")
    merged = landed(rows.groupBy(*KPI_KEY, "kpi", "day").agg(best).select(*KPI_KEY, "_best.*", "kpi", "day").drop("_new"), "merged")
    (
        merged.hint("rebalance", F.col("kpi"), F.col("day"))
        .sortWithinPartitions("kpi", "day", "timestamp")
        .write.partitionBy("kpi", "day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)
    )


def has_files(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def write_spans(spans: DataFrame, folder: str, fmt: str = "parquet") -> None:
    spans.write.mode("append").format(fmt).option("header", True).save(folder)


def write_logs_sliced(
    logs: DataFrame,
    folder: str,
    slice_length: str = "5 minutes",
    ts: str = "ts",
    folder_per: str = "day",
) -> None:
    """Append logs with their slice of time, in slice order.

    Folders are days by default and ``slice_start`` is a sorted column in their files, so reading
    one slice still skips the others without a folder (and a tiny file) for every five minutes;
    ``folder_per="slice"`` makes one folder per slice.
    """
    start = F.window(F.col(ts).cast("timestamp"), slice_length)["start"]
    placed = logs.withColumn("slice_start", F.date_format(start, "yyyyMMdd'T'HHmmss"))
    folders = {"day": "slice_day", "slice": "slice_start"}[folder_per]
    if folder_per == "day":
        placed = placed.withColumn("slice_day", F.substring("slice_start", 1, 8))
    (
        placed.hint("rebalance", F.col(folders))
        .sortWithinPartitions(folders, "slice_start", ts)
        .write.partitionBy(folders).mode("append").parquet(folder)
    )


def read_logs_sliced(spark: SparkSession, folder: str) -> DataFrame:
    """All slices together."""
    return spark.read.option("basePath", folder).parquet(folder)


def write_session_results(results: DataFrame, folder: str, mode: str = "append") -> None:
    """Write results as JSON by agent and model; a model name's slashes become underscores."""
    (
        results.withColumn("model_safe", F.regexp_replace("model", "/", "_"))
        .hint("rebalance", F.col("agent"), F.col("model_safe"))
        .sortWithinPartitions("agent", "model_safe")
        .write.partitionBy("agent", "model_safe").mode(mode).json(folder)
    )
