"""Line compression and counter rates on streams with hot keys.

The stateful processors hand all rows of a key in a micro-batch to one task. Here each micro-batch
goes through the batch operators, which split hot keys, and what must be remembered, the last row of
each key, is a table of its own: batch ``n`` reads the one written by batch ``n - 1``. Both outputs
of a batch are folders named by its number, so a retried batch replaces them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsframe.functions.time import MICROS
from opsframe.operators.compress import compress_lines
from opsframe.operators.ordered import LINES_PER_BUCKET, with_previous
from opsframe.streaming.jobs import run_batches

_LINES = "stream STRING, seq LONG, line STRING"
_SAMPLES = "series STRING, us LONG, sample_id LONG, value DOUBLE"
_RATE_BUCKET_S = 60


def _folder(root: str, kind: str, batch_id: int) -> str:
    return f"{root}/{kind}/batch={batch_id:09d}"


def _held(spark, root: str, schema: str, batch_id: int) -> DataFrame:
    """What the batch before left; nothing before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_folder(root, "held", batch_id - 1))


def compress_batch(root: str, lines_per_bucket: int = LINES_PER_BUCKET) -> Callable[[DataFrame, int], None]:
    """Writer of compressed lines: the newest line of each stream is held back."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("stream", "seq", "line").unionByName(_held(spark, root, _LINES, batch_id))
        last = rows.groupBy("stream").agg(F.max("seq").alias("seq"), F.max_by("line", "seq").alias("line"))
        last.select("stream", "seq", "line").write.mode("overwrite").parquet(_folder(root, "held", batch_id))
        newest = spark.read.schema(_LINES).parquet(_folder(root, "held", batch_id))
        done = compress_lines(rows, lines_per_bucket=lines_per_bucket).join(
            newest.select("stream", "seq"), ["stream", "seq"], "left_anti"
        )
        done.write.mode("overwrite").parquet(_folder(root, "out", batch_id))

    return write


def rate_batch(root: str, bucket_s: int = _RATE_BUCKET_S) -> Callable[[DataFrame, int], None]:
    """Writer of per-sample counter rates; the newest sample of each series is remembered."""
    columns = ["series", "us", "sample_id", "value"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _held(spark, root, _SAMPLES, batch_id).withColumn("_new", F.lit(False))
        rows = batch.select(*columns).withColumn("_new", F.lit(True)).unionByName(before)
        order = F.struct("us", "sample_id")
        newest = F.max_by(F.struct("us", "sample_id", "value"), order).alias("s")
        rows.groupBy("series").agg(newest).select("series", "s.*").write.mode("overwrite").parquet(
            _folder(root, "held", batch_id)
        )
        bucket = F.floor(F.col("us") / F.lit(bucket_s * MICROS))
        paired = with_previous(rows, ["series"], ["us", "sample_id"], bucket, ["us", "value"])
        gap = F.col("us") - F.col("previous.us")
        rise = F.when(
            F.col("value") >= F.col("previous.value"), F.col("value") - F.col("previous.value")
        ).otherwise(F.col("value"))
        paired.filter(F.col("_new") & (gap > 0)).select(
            "series", "us", "sample_id", (rise * MICROS / gap).alias("rate")
        ).write.mode("overwrite").parquet(_folder(root, "out", batch_id))

    return write


def stream_to(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str | None = None
) -> StreamingQuery:
    """Process what has landed; keep ``checkpoint`` and the writer's folder together for a restart."""
    return run_batches(stream, write, checkpoint)


def finished(spark, root: str, schema: str) -> DataFrame:
    """Everything the batches so far have put out."""
    return spark.read.schema(schema).parquet(f"{root}/out/batch=*")


def still_held(spark, root: str) -> DataFrame:
    """Lines held back by the newest batch: the flush of a compression stream that has ended."""
    batches = spark.read.schema(_LINES).parquet(f"{root}/held/batch=*").withColumn(
        "_batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1)
    )
    newest = batches.agg(F.max("_batch").alias("_batch"))
    return batches.join(F.broadcast(newest), "_batch").select("stream", "seq", "line")
