"""Landings grow in files, not in rows of a file, and are worked out once; streams of few lines are plain rows."""

import glob

from pyspark.sql import functions as F

from opsframe.plans import streaming as plans
from opsframe.streaming import jobs, stateful


def test_larger_parts_are_landed_in_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "ROWS_PER_FILE", 10)
    monkeypatch.setattr(plans, "scratch_path", lambda *_: str(tmp_path / "turns"))
    rows = spark.range(300).select("id", F.timestamp_seconds("id").alias("ts"))
    parts = plans._landings(rows)
    assert all(p.inputFiles() for p in parts)  # read back from one landing
    source = plans._tail_in_turn(spark, parts, "rows")
    largest = max(p.count() for p in parts)
    files = -(-largest // 10)
    assert files >= 10 and len(glob.glob(f"{tmp_path}/turns/*.parquet")) == files * plans.LANDINGS
    query = jobs.run_available(source, str(tmp_path / "out"), str(tmp_path / "p"))
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == plans.LANDINGS
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300


def test_lines_reach_the_processor_as_rows(spark, tmp_path):
    stateful.use_state_store(spark)
    rows = spark.createDataFrame([("s", 0, "a 1s"), ("s", 1, "a 2s"), ("s", 2, None), ("t", 0, "x")], "stream string, seq long, line string")
    rows.write.parquet(str(tmp_path / "in"))
    held = stateful.stream_compress(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = jobs.run_available(held, str(tmp_path / "out"), str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("s", 1, "a 2s")]
