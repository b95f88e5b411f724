"""Cut or wrongly typed rows come out of the readers' reject tables, the others out of the readers."""

import json

from opsframe.operators.sessions import payload_key
from opsframe.sources import readers
from pyspark.sql import functions as F


def _write(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.json").write_text(text)
    return str(folder)


def test_log_pages(spark, tmp_path):
    page = json.dumps({"hits": {"hits": [{"_id": "a", "_source": {"message": "m"}}]}})
    path = _write(tmp_path / "p", one=page + "\n" + page[:25] + "\n")
    assert readers.read_log_hits(spark, path).count() == 1
    assert [r.text for r in readers.rejected_log_pages(spark, path).collect()] == [page[:25]]


def test_metric_dump_and_series(spark, tmp_path):
    row = {"metric": {"__name__": "m", "pod": "p", "cpu": "0"}, "values": [[1, "2"]]}
    other = {"metric": {"cpu": "1", "pod": "p", "__name__": "m"}, "values": [[1, "2"]]}
    same = {"metric": {"pod": "p", "cpu": "0", "__name__": "m"}, "values": [[2, "2"]]}
    path = _write(tmp_path / "m", one="\n".join(map(json.dumps, (row, other, same))) + '\n{"metric": {"a"')
    read = readers.read_metric_dump(spark, path)
    assert read.count() == 3 and read.select("series_id").distinct().count() == 2
    assert readers.rejected_metric_dump(spark, path).count() == 1


def test_traces(spark, tmp_path):
    path = _write(tmp_path / "t", one=json.dumps({"data": [{"traceID": "x", "spans": []}]}, indent=1), two='{"data": [')
    assert [r.traceID for r in readers.read_trace_dump(spark, path).collect()] == ["x"]
    assert readers.rejected_trace_dump(spark, path).count() == 1


def test_sessions(spark, tmp_path):
    good = {"agent": "a", "session_id": "s", "start_time": 1.0, "trace": [{"role": "user", "content": "c"}]}
    wrong = dict(good, start_time="noon")
    path = _write(tmp_path / "s", one=json.dumps(good, indent=1), two=json.dumps(wrong, indent=1), three="{", four="no")
    assert [r.session_id for r in readers.read_sessions(spark, path).collect()] == ["s"]
    assert readers.unreadable_sessions(spark, path).count() == 3


def test_null_and_missing_fields_have_keys_of_their_own(spark):
    one = spark.range(1).select(
        payload_key(F.struct(F.lit("u").alias("role"), F.lit(None).cast("string").alias("content"))).alias("a"),
        payload_key(F.struct(F.lit("u").alias("role"))).alias("b"),
    ).first()
    assert one.a != one.b
