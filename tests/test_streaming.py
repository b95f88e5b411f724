"""Streams in several micro-batches against their batch forms."""

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.operators.compress import compress_lines
from opsframe.plans.adapters import log_lines
from opsframe.plans.registry import table
from opsframe.sources.readers import stream_source
from opsframe.streaming import jobs, slices, stateful, wide


def _run_in_parts(spark, tmp_path, parts, make, mode="append"):
    """Land and process one part after the other, with one checkpoint."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        jobs.run_available(make(stream_source(spark, source, part.schema, "parquet", max_files=1)), out, progress)
    return spark.read.parquet(out), progress


def test_compress_over_batches(spark, sf_dir, tmp_path):
    stateful.use_state_store(spark)
    lines = log_lines(spark, sf_dir).cache()
    cuts = [lines.filter(F.col("seq") % 9 < 9).filter(f"seq >= {a} AND seq < {b}") for a, b in ((0, 3), (3, 4), (4, 10**6))]
    out, progress = _run_in_parts(spark, tmp_path, cuts, stateful.stream_compress)
    held = spark.read.format("statestore").option("path", progress).option("stateVarName", "pending").load()
    got = out.unionByName(held.select(F.col("key.stream").alias("stream"), "value.seq", "value.line"))
    want = compress_lines(lines)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert out.count() < want.count()


def test_compress_flushes_after_silence(spark, tmp_path):
    stateful.use_state_store(spark)
    rows = spark.createDataFrame([("s", 0, "a 1s"), ("s", 1, "a 2s"), ("t", 0, "x")], "stream STRING, seq LONG, line STRING")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)
    query = (
        stateful.stream_compress(stream_source(spark, source, rows.schema, "parquet"), flush_after_ms=500)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "p"))
        .trigger(processingTime="1 second").start()
    )
    try:
        for _ in range(60):
            time.sleep(1)
            got = sorted(map(tuple, spark.read.schema("stream STRING, seq LONG, line STRING").parquet(out).collect()))
            if len(got) >= 2:
                break
    finally:
        query.stop()
    assert got == [("s", 1, "a 2s"), ("t", 0, "x")]


def test_counter_rate_over_batches(spark, sf_dir, tmp_path):
    stateful.use_state_store(spark)
    samples = table(spark, sf_dir, "events").selectExpr(
        "event_type AS series", "cast(ts AS timestamp) AS ts", "event_id AS sample_id", "value")
    parts = [samples.filter(f"ts {c}") for c in ("< '2024-01-10'", ">= '2024-01-10' AND ts < '2024-01-20'", ">= '2024-01-20'")]
    out, _ = _run_in_parts(spark, tmp_path, parts, stateful.stream_counter_rate)
    order = Window.partitionBy("series").orderBy("us", "sample_id")
    before = samples.withColumn("us", F.unix_micros("ts")).withColumn("p", F.lag(F.struct("us", "value")).over(order))
    rise = F.expr("if(value >= p.value, value - p.value, value)")
    want = before.filter("us > p.us").select("sample_id", (rise * 1000000 / F.expr("us - p.us")).alias("rate"))
    rounded = lambda df: sorted((r.sample_id, round(r.rate, 9)) for r in df.collect())
    assert rounded(out) == rounded(want)


def test_dedupe_over_batches(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("log-"), "id").alias("log_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    parts = [rows.filter("ts <= timestamp_seconds(1700000100)"), rows.filter("ts >= timestamp_seconds(1700000100)")]
    out, _ = _run_in_parts(spark, tmp_path, parts, slices.stream_dedupe)
    assert out.count() == 300


def test_dedupe_keeps_every_id_whatever_the_order(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("log-"), "id").alias("log_id"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"))
    parts = [rows.filter(F.pmod(F.xxhash64("log_id"), F.lit(3)) == n) for n in (2, 0, 1)] * 2
    out, _ = _run_in_parts(spark, tmp_path, parts, slices.stream_dedupe)
    assert out.count() == 1000 and out.select("log_id").distinct().count() == 1000


def test_slices_over_batches(spark, tmp_path):
    rows = spark.range(4000).select(
        F.timestamp_seconds(F.col("id") * 2 + 1_700_000_000).alias("ts"), F.concat(F.lit("p"), F.col("id") % 3).alias("pod_name"))
    parts = [rows.filter("unix_seconds(ts) < 1700003000"), rows.filter("unix_seconds(ts) >= 1700003000")]
    out, _ = _run_in_parts(spark, tmp_path, parts, slices.stream_log_slices)
    closed = 1_700_000_000 + 7998 - 600
    want = rows.groupBy((F.floor(F.unix_seconds("ts") / 300) * 300).alias("slice_start"), "pod_name").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("slice_start") + 300 <= closed)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_wide_forms_over_batches(spark, sf_dir, tmp_path):
    lines = log_lines(spark, sf_dir).cache()
    samples = table(spark, sf_dir, "events").selectExpr(
        "event_type AS series", "unix_micros(cast(ts AS timestamp)) AS us", "event_id AS sample_id", "value").cache()
    cuts = [(0, 3), (3, 4), (4, 10**6)]
    days = ["us < 1704844800000000", "us >= 1704844800000000 AND us < 1705708800000000", "us >= 1705708800000000"]
    for n in range(3):
        lines.filter(f"seq >= {cuts[n][0]} AND seq < {cuts[n][1]}").coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        samples.filter(days[n]).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        for name, df, write in (("l", lines, wide.compress_batch(str(tmp_path / "lo"), 2)), ("s", samples, wide.rate_batch(str(tmp_path / "so")))):
            source = stream_source(spark, str(tmp_path / name), df.schema, "parquet", max_files=1)
            wide.stream_to(source, write, str(tmp_path / f"{name}p"))
    got = wide.finished(spark, str(tmp_path / "lo"), "stream STRING, seq LONG, line STRING").unionByName(wide.still_held(spark, str(tmp_path / "lo")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, compress_lines(lines).collect()))
    order = Window.partitionBy("series").orderBy("us", "sample_id")
    want = samples.withColumn("p", F.lag(F.struct("us", "value")).over(order)).filter("us > p.us").select(
        "sample_id", (F.expr("if(value >= p.value, value - p.value, value)") * 1000000 / F.expr("us - p.us")).alias("rate"))
    rounded = lambda df: sorted((r.sample_id, round(r.rate, 9)) for r in df.collect())
    assert rounded(wide.finished(spark, str(tmp_path / "so"), "series STRING, us LONG, sample_id LONG, rate DOUBLE")) == rounded(want)
