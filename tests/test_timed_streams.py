"""Event-time streams: flush, bounded state, one answer per key, over several micro-batches."""

import pytest
from compare import SF_DIR, assert_same, connect
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.operators.compress import compress_lines
from opsframe.plans import streaming as plans
from opsframe.plans.adapters import timed_lines
from opsframe.plans.registry import CATALOG
from opsframe.streaming import jobs, slices, stateful, timed

NEW = ["stream_dedupe_bounded", "stream_compress_flushed", "stream_first_error_once"]


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, name):
    assert_same(CATALOG[name].build(spark, SF_DIR), connect(SF_DIR), CATALOG[name].sql)


def _batches(query) -> int:
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)


def test_dedupe_forgets_old_ids(spark, tmp_path):
    parts = plans.pulls(spark, SF_DIR)
    landed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    query = jobs.run_available(
        slices.stream_dedupe(plans._tail_in_turn(spark, parts, "pulls"), delay=plans.PULL_DELAY),
        str(tmp_path / "out"), str(tmp_path / "progress"),
    )
    assert _batches(query) == plans.LANDINGS
    newest = landed.agg(F.max("ts").alias("end"))
    recent = landed.join(newest, F.col("ts") >= F.col("end") - F.expr(f"INTERVAL {plans.PULL_DELAY}") * 2)
    ids = landed.select("log_id").distinct().count()
    kept = jobs.state_rows(spark, str(tmp_path / "progress")).count()
    assert 0 < kept <= recent.select("log_id").distinct().count() < ids
    assert spark.read.parquet(str(tmp_path / "out")).count() == ids < landed.count()


LINES = "stream STRING, seq LONG, line STRING, ts TIMESTAMP"


def _run(spark, folder, parts, make):
    stateful.use_state_store(spark)
    query = jobs.run_available(make(plans._tail_in_turn(spark, parts, "timed")), str(folder / "out"), str(folder / "p"))
    return spark.read.parquet(str(folder / "out")), query


def _lines(spark, rows):
    return spark.createDataFrame(rows, "stream STRING, seq LONG, line STRING, s LONG").select(
        "stream", "seq", "line", F.timestamp_seconds("s").alias("ts"))


def test_silence_flushes_and_then_forgets(spark, tmp_path):
    first = _lines(spark, [("s", 0, "a 1s", 10), ("s", 1, "a 2s", 20), ("t", 0, "x", 20), (None, None, None, 5_000)])
    later = _lines(spark, [("s", 2, "a 3s", 6_000), ("s", 3, "a 4s", 6_010), (None, None, None, 6_011)])
    out, _ = _run(spark, tmp_path, [first, _lines(spark, [(None, None, None, 5_001)]), later],
                  lambda df: timed.stream_compress_flushed(df, "1 minute", "1 minute"))
    # Line 3 is still held back: the watermark is only 60 s behind the last tick.
    assert sorted(map(tuple, out.collect())) == [("s", 1, "a 2s"), ("t", 0, "x")]


def test_stretches_meet_and_state_stays_small(spark, tmp_path):
    """A third of all lines in one stream, cut in stretches of five; every line of state is a pending one."""
    lines = timed_lines(spark, SF_DIR)
    busy = lines.withColumn("stream", F.when(F.col("stream") % 3 == 0, "busy").otherwise(F.col("stream")))
    order = F.row_number().over(Window.partitionBy("stream").orderBy("ts", "seq", "line")) - 1
    busy.withColumn("seq", order.cast("long")).write.parquet(str(tmp_path / "busy"))
    busy = spark.read.parquet(str(tmp_path / "busy"))
    parts = plans._landings(busy)
    out, query = _run(spark, tmp_path, parts, lambda df: timed.stream_compress_flushed(df, "3650 days", lines_per_key=5))
    want = {tuple(r) for r in compress_lines(busy.drop("ts")).collect()}
    got = [tuple(r) for r in out.collect()]
    held = jobs.state_rows(spark, str(tmp_path / "p"), stateVarName="pending")
    held = [(r.stream, r.seq, r.line) for r in held.select("key.stream", "value.seq", "value.line").collect()]
    assert len(got) + len(held) == len(want) and set(got) | set(held) == want and _batches(query) == plans.LANDINGS
    assert len(held) == busy.select("stream").distinct().count()


def test_goes_on_from_a_batch_answer(spark, tmp_path):
    old = _lines(spark, [("s", 0, "b 1s", 1), ("s", 1, "a 1s", 10), ("t", 0, "x", 10)])
    last = old.groupBy("stream").agg(*(F.max_by(c, "seq").alias(c) for c in ("line", "ts")), F.max("seq").alias("seq"))
    new = _lines(spark, [("s", 2, "a 9s", 20), (None, None, None, 50_000)])
    out, _ = _run(spark, tmp_path, [new], lambda df: timed.stream_compress_flushed(df, "1 minute", before=last))
    assert sorted(map(tuple, out.collect())) == [("s", 2, "a 9s"), ("t", 0, "x")]


def test_numbers_that_repeat_are_refused(spark, tmp_path):
    rows = _lines(spark, [("s", 0, f"l{i}", i) for i in range(9)])
    with pytest.raises(Exception, match="repeat"):
        _run(spark, tmp_path, [rows], lambda df: timed.stream_compress_flushed(df, "1 minute", lines_per_key=5))


def test_told_once_and_anew_after_being_forgotten(spark, tmp_path):
    rows = lambda *at: spark.createDataFrame(
        [("p" if s >= 0 else None, abs(s)) for s in at], "pod STRING, s LONG").select("pod", F.timestamp_seconds("s").alias("ts"))
    out, query = _run(spark, tmp_path, [rows(10, 5, 30), rows(40, 50), rows(-900), rows(-901), rows(1000)],
                      lambda df: timed.first_true_once(df, ["pod"], F.lit(True), "100 seconds", "10 seconds"))
    got = sorted(int(r.since.timestamp()) for r in out.collect())
    assert got == [5, 1000] and _batches(query) == 5
