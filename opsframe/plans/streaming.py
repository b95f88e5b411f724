"""Streaming queries: each lands or tails a test table, runs the stream and reads its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions.logs import has_error_text
from opsframe.plans.adapters import LINES_SQL, LOGS_SQL, logs, sessions, timed_lines
from opsframe.plans.logs import _pass_sql
from opsframe.plans.registry import query, table
from opsframe.plans.scoring import _EVALUATE_SQL
from opsframe.session import landed, scratch_path
from opsframe.sources.readers import stream_source
from opsframe.streaming import jobs, slices, stateful, timed, wide


#: Landings of a table in order of time, and files of each at least; a micro-batch takes the files of one.
LANDINGS, FILES = 3, 2
#: Rows of a landed file; a larger table is landed in more files, by as many tasks.
ROWS_PER_FILE = 250_000


def _landings(df) -> list:
    """``df`` cut in order of its ``ts``, in parts of about as many rows; it is worked out once."""
    df = landed(df, "whole")
    at = [n / LANDINGS for n in range(1, LANDINGS)]
    cuts = df.select(F.unix_micros("ts").cast("double").alias("us")).approxQuantile("us", at, 0.001)
    place = sum(((F.unix_micros("ts") > int(c)).cast("int") for c in cuts), F.lit(0))
    return [df.filter(place == n) for n in range(LANDINGS)]


def _tail_in_turn(spark, parts: list, label: str):
    """Land ``parts`` one after the other and tail them, a micro-batch for each."""
    folder = scratch_path(spark, label)
    files = max(FILES, *(-(-part.count() // ROWS_PER_FILE) for part in parts))
    for part in parts:
        part.repartition(files).write.mode("append").parquet(folder)
    return stream_source(spark, folder, parts[0].schema, "parquet", max_files=files)


def _tick(df, after: str):
    """A row without a key, so long after the last one."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in df.dtypes if name != "ts"]
    last = df.agg((F.max("ts") + F.expr(f"INTERVAL '{after}'")).alias("ts"))
    return last.select(*empty, "ts").select(*df.columns)


@query("stream_log_slices", "R1 S11", """
    SELECT slice_start, pod_name, log_count FROM (
      SELECT epoch(time_bucket(INTERVAL 5 MINUTE, ts))::BIGINT AS slice_start,
             'svc' || (user_id % 10) AS pod_name, count(*) AS log_count FROM events GROUP BY ALL)
    WHERE slice_start + 300 <= (SELECT epoch(max(ts)) - 600 FROM events)""")
def stream_log_slices(spark, sf):
    # Only slices the watermark has passed come out.
    source = stream_source(
        spark, sf, table(spark, sf, "events").schema, "parquet", glob="events.parquet"
    )
    pods = source.selectExpr(
        "cast(ts AS timestamp) AS ts", "'svc' || cast(user_id % 10 AS string) AS pod_name"
    )
    out = scratch_path(spark, "slices-out")
    jobs.run_available(slices.stream_log_slices(pods), out)
    return spark.read.parquet(out)


@query("stream_dedupe", "R2", f"SELECT log_id FROM ({LOGS_SQL})")
def stream_dedupe(spark, sf):
    rows = logs(spark, sf).select("log_id", "ts")
    # Overlapping pulls: the older two thirds are landed again, long after.
    out = scratch_path(spark, "deduped")
    parts = _landings(rows)
    jobs.run_available(slices.stream_dedupe(_tail_in_turn(spark, parts + parts[:2], "pulls")), out)
    return spark.read.parquet(out).select("log_id")


@query("stream_dedupe_bounded", "R2 S11", f"SELECT log_id, epoch_us(ts) AS us FROM ({LOGS_SQL})")
def stream_dedupe_bounded(spark, sf):
    out = scratch_path(spark, "deduped")
    jobs.run_available(slices.stream_dedupe(_tail_in_turn(spark, pulls(spark, sf), "pulls"), delay=PULL_DELAY), out)
    return spark.read.parquet(out).select("log_id", F.unix_micros("ts").alias("us"))


PULL_DELAY = "2 days"


def pulls(spark, sf) -> list:
    """Pulls of a log in turn. Each repeats the last day of the pull before, whose ids are still
    known, and a seventh of the first pull, most of which is so late that it is dropped as such."""
    parts = _landings(logs(spark, sf).select("log_id", "ts", "event_id"))
    repeated = [parts[0]]
    for before, part in zip(parts, parts[1:]):
        end = before.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("end"))
        edge = before.join(F.broadcast(end), F.col("ts") >= F.col("end")).drop("end")
        repeated.append(part.unionByName(edge).unionByName(parts[0].filter("event_id % 7 = 0")))
    return [part.drop("event_id") for part in repeated]


#: Longer than any silence of a stream in the test tables, so that a flush can't part two repeats.
SILENCE = "3650 days"


@query("stream_compress_flushed", "R3 S11", _pass_sql(LINES_SQL))
def stream_compress_flushed(spark, sf):
    stateful.use_state_store(spark)
    lines = timed_lines(spark, sf)
    source = _tail_in_turn(spark, [*_landings(lines), _tick(lines, "3700 days")], "lines")
    out = scratch_path(spark, "compressed")
    jobs.run_available(timed.stream_compress_flushed(source, SILENCE), out)
    return spark.read.parquet(out)


@query("stream_compress", "R3", _pass_sql(LINES_SQL))
def stream_compress(spark, sf):
    stateful.use_state_store(spark)
    out, progress = scratch_path(spark, "compressed"), scratch_path(spark, "progress")
    jobs.run_available(stateful.stream_compress(_tail_in_turn(spark, _landings(timed_lines(spark, sf)), "lines")), out, progress)
    # What is still held back is read from the state, so that the whole answer can be compared.
    held = (
        spark.read.format("statestore").option("path", progress).option("stateVarName", "pending").load()
    )
    rest = held.select(F.col("key.stream").alias("stream"), "value.seq", "value.line")
    return spark.read.parquet(out).unionByName(rest)


@query("stream_compress_wide", "R3", _pass_sql(LINES_SQL))
def stream_compress_wide(spark, sf):
    root = scratch_path(spark, "wide-lines")
    wide.stream_to(_tail_in_turn(spark, _landings(timed_lines(spark, sf)), "lines"), wide.compress_batch(root))
    done = wide.finished(spark, root, "stream STRING, seq LONG, line STRING")
    return done.unionByName(wide.still_held(spark, root))


_RATES_SQL = """
    SELECT series, us, sample_id, round(CASE WHEN value >= before THEN value - before ELSE value END
             * 1000000 / (us - before_us), 6) AS rate
    FROM (SELECT event_type || user_id % 10 AS series, epoch_us(ts) AS us, event_id AS sample_id, value,
                 lag(value) OVER s AS before, lag(epoch_us(ts)) OVER s AS before_us FROM events
          WINDOW s AS (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id))
    WHERE us > before_us"""


@query("stream_counter_rate", "R4", _RATES_SQL)
def stream_counter_rate(spark, sf):
    stateful.use_state_store(spark)
    samples = table(spark, sf, "events").selectExpr(
        "concat(event_type, user_id % 10) AS series", "cast(ts AS timestamp) AS ts",
        "event_id AS sample_id", "value",
    )
    out = scratch_path(spark, "rates")
    jobs.run_available(stateful.stream_counter_rate(_tail_in_turn(spark, _landings(samples), "samples")), out)
    return spark.read.parquet(out).withColumn("rate", F.round("rate", 6))


@query("stream_counter_rate_wide", "R4", _RATES_SQL)
def stream_counter_rate_wide(spark, sf):
    samples = table(spark, sf, "events").selectExpr(
        "concat(event_type, user_id % 10) AS series", "unix_micros(cast(ts AS timestamp)) AS us",
        "event_id AS sample_id", "value", "cast(ts AS timestamp) AS ts",
    )
    root = scratch_path(spark, "wide-rates")
    wide.stream_to(_tail_in_turn(spark, _landings(samples), "samples"), wide.rate_batch(root))
    rates = wide.finished(spark, root, "series STRING, us LONG, sample_id LONG, rate DOUBLE")
    return rates.withColumn("rate", F.round("rate", 6))


@query("stream_eval", "R5 C9 K4", f"""
    SELECT session_id, agent, problem_id, steps, success FROM ({_EVALUATE_SQL})""")
def stream_eval(spark, sf):
    out = scratch_path(spark, "scored")
    begun = sessions(spark, sf).withColumn("ts", F.timestamp_seconds("start_time"))
    jobs.stream_eval(_tail_in_turn(spark, _landings(begun), "sessions"), out)
    schema = "session_id STRING, problem_id STRING, steps LONG, success BOOLEAN, agent STRING"
    scored = spark.read.schema(schema).option("basePath", out).json(f"{out}/batch=*")
    return scored.select("session_id", "agent", "problem_id", "steps", "success")


@query("stream_first_error", "R6", f"""
    SELECT pod_name, min(epoch_us(ts)) AS since FROM ({LOGS_SQL})
    WHERE contains(lower(message), 'error') GROUP BY pod_name""")
def stream_first_error(spark, sf):
    out = scratch_path(spark, "first-error")
    source = _tail_in_turn(spark, _landings(logs(spark, sf).select("pod_name", "ts", "message")), "messages")
    found = slices.first_true(source, ["pod_name"], has_error_text(F.col("message")))
    jobs.run_batches(found, jobs.keep_latest(out), mode="complete")
    answers = spark.read.parquet(out)
    newest = answers.agg(F.max("batch").alias("batch"))
    return answers.join(F.broadcast(newest), "batch").select(
        "pod_name", F.unix_micros("since").alias("since")
    )


@query("stream_first_error_once", "R6 S11", f"""
    SELECT pod_name, min(epoch_us(ts)) AS since FROM ({LOGS_SQL})
    WHERE contains(lower(message), 'error') GROUP BY pod_name""")
def stream_first_error_once(spark, sf):
    stateful.use_state_store(spark)
    rows = logs(spark, sf).select("pod_name", "message", "ts")
    source = _tail_in_turn(spark, [*_landings(rows), _tick(rows, "3700 days")], "messages")
    out = scratch_path(spark, "told")
    jobs.run_available(timed.first_true_once(source, ["pod_name"], has_error_text(F.col("message")), SILENCE), out)
    return spark.read.parquet(out).select("pod_name", F.unix_micros("since").alias("since"))
