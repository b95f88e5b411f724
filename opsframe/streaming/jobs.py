"""Running streams to files: everything that has landed so far, then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsframe.functions.problems import problem_catalogue
from opsframe.operators.scoring import evaluate, unknown_problems
from opsframe.session import scratch_path
from opsframe.sources.sinks import write_session_results


def run_available(
    stream: DataFrame, folder: str, checkpoint: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Process what has landed and write it as parquet; restartable from ``checkpoint``."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", folder)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_batches(
    stream: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_eval(sessions: DataFrame, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """Score sessions as they land and write the results by agent and model.

    Each micro-batch replaces its own folder, so a retried batch does not write twice. Sessions of
    unknown problems are written beside the results, to ``<folder>-unknown``.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        problems = problem_catalogue(batch.sparkSession)
        results = evaluate(batch, problems, envelope=("model",))
        write_session_results(results, f"{folder}/batch={batch_id}", mode="overwrite")
        unknown = unknown_problems(batch.select("session_id", "agent", "model", "problem_id"), problems)
        unknown.write.mode("overwrite").parquet(f"{folder.rstrip('/')}-unknown/batch={batch_id}")

    return run_batches(sessions, score, checkpoint)


def keep_latest(folder: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for complete-mode results: each batch is a full answer in its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{folder}/batch={batch_id:09d}"
        )

    return write


def state_rows(spark, checkpoint: str, **options: str) -> DataFrame:
    """What a stream keeps between micro-batches, as of its last one."""
    return spark.read.format("statestore").options(path=checkpoint, **options).load()
