"""Nested traces and log hits on the documented cases."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from opsframe.functions import logs as fl
from opsframe.operators import logs as ol, traces as ot
from opsframe.schemas import LOG_HIT
from opsframe.sources.readers import read_log_hits, read_trace_dump


def _span(span_id, refs=None, tags=None, pid="p1"):
    span = {"spanID": span_id, "processID": pid, "operationName": "op", "startTime": 10, "duration": 2}
    if refs is not None:
        span["references"] = [{"refType": kind, "spanID": target} for kind, target in refs]
    if tags is not None:
        span["tags"] = [{"key": key, "value": value} for key, value in tags]
    return span


TRACE = {
    "traceID": "t1",
    "processes": {"p1": {"serviceName": "geo"}, "p2": {"serviceName": "rate"}},
    "spans": [
        _span("a"),
        _span("b", [("FOLLOWS_FROM", "x"), ("CHILD_OF", "a"), ("CHILD_OF", "z")], [("error", True)], "p2"),
        _span("c", [("FOLLOWS_FROM", "a")], [("error", "true"), ("http.status_code", 200)]),
        _span("d", [], [("error", 1), ("http.status_code", 200), ("response_class", "5xx")]),
        _span("e", [("CHILD_OF", "a")], [("error", False), ("other", 1)]),
    ],
}
WANT = {
    "a": ("ROOT", "geo", False, "Unknown"),
    "b": ("a", "rate", True, "Unknown"),
    "c": ("ROOT", "geo", False, "200"),
    "d": ("ROOT", "geo", True, "5xx"),
    "e": ("a", "geo", False, "Unknown"),
}


def test_trace_dump_to_spans(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.json").write_text(json.dumps({"data": [TRACE]}, indent=1))
    spans = ot.flatten_spans(read_trace_dump(spark, str(tmp_path)))
    assert spans.count() == 10
    assert ot.dedupe_spans(spans, keep_duplicates=True).count() == 10
    rows = ot.dedupe_spans(spans).collect()
    assert len(rows) == 5
    assert {r.span_id: (r.parent_span, r.service_name, r.has_error, r.response) for r in rows} == WANT


def test_traces_of_service(spark):
    rows = [("t1", "a", "geo", 10), ("t1", "b", "rate", 11), ("t2", "c", "geo", 50), ("t3", "d", "rate", 60), ("t4", "e", "jaeger-all-in-one", 1)]
    spans = spark.createDataFrame(rows, "trace_id STRING, span_id STRING, service_name STRING, start_time LONG")
    ids = lambda df: sorted(r.span_id for r in df.collect())
    assert ids(ot.traces_of_service(spans, "geo")) == ["a", "b", "c"]
    assert ids(ot.traces_of_service(spans, "geo", since=20)) == ["c"]
    assert ids(ot.traces_of_service(spans, "geo", until=50)) == ["a", "b"]
    assert ids(ot.traces_of_service(spans, "geo", limit=1)) == ["c"]
    assert ids(ot.traces_of_service(spans, "jaeger-all-in-one")) == []


def _hit(log_id, at="2024-01-01T10:00:00.250Z", node="n1", message="m"):
    k8s = {"pod": {"name": "geo-1"}, "container": {"name": "c"}, "namespace": "ns"}
    if node:
        k8s["node"] = {"name": node}
    return {"_id": log_id, "_source": {"@timestamp": at, "message": message, "kubernetes": k8s}}


def test_log_hits(spark, tmp_path):
    page = {"hits": {"hits": [_hit("a"), _hit("b", node=None), _hit("c", at="soon"), _hit("d", at="2024-01-01")]}}
    (tmp_path / "page.json").write_text(json.dumps(page) + "\n")
    hits = read_log_hits(spark, str(tmp_path))
    rows = ol.flatten_log_hits(hits).collect()
    assert [(r.log_id, r.timestamp, r.node_name) for r in rows] == [("a", 1704103200.25, "n1")]
    reasons = {r.log_id: r.reason for r in ol.rejected_log_hits(hits).collect()}
    assert reasons == {"b": "missing node_name", "c": "bad timestamp", "d": "bad timestamp"}


def test_known_pods(spark):
    hits = spark.createDataFrame([json.dumps(_hit("a", message='{"level":"info","message":"x"}'))], "string")
    logs = ol.flatten_log_hits(hits.select(F.from_json("value", LOG_HIT).alias("h")).select("h.*"))
    pods = spark.createDataFrame([("geo-1",)], "pod STRING")
    assert [tuple(r)[3:] for r in ol.logs_of_known_pods(logs, pods).collect()] == [("geo-1", "level:info,message:x")]
    assert ol.logs_of_known_pods(logs, pods.limit(0)).count() == 0


def test_messages(spark):
    cases = {
        '{"severity":"info","message":"m"}': "severity:info,message:m",
        '{"level":"info","message":"m"}': "level:info,message:m",
        "severity is high": "severity is high",
        '{"severity":3,"message":"m"}': '{"severity":3,"message":"m"}',
        '{"severity":"info"}': '{"severity":"info"}',
        '{"level":"severity","message":"m"}': '{"level":"severity","message":"m"}',
        "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m STRING")
    assert {r.m: r.n for r in df.withColumn("n", fl.normalize_message(F.col("m"))).collect()} == cases


def test_commands(spark):
    cases = {
        "kubectl logs geo": (True, None),
        "kubectl get  events -n x": (True, None),
        "kubectl get pods -w": (True, None),
        "kubectl get pods": (False, None),
        "docker events": (True, None),
        "mykubectl logs": (False, None),
        "kubectl edit svc geo": (False, "Error: Cannot use `kubectl edit`. Use `kubectl patch` instead."),
        "docker logs -f x": (True, "Error: Cannot use `docker logs -f`. Use `docker logs` instead."),
    }
    df = spark.createDataFrame([(k,) for k in cases], "c STRING")
    rows = df.select("c", fl.is_log_command(F.col("c")), fl.command_policy(F.col("c"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == cases


def test_volume_around_the_period_start(spark):
    rows = [(f"2024-01-{d:02d} {h:02d}:{m:02d}:00",) for d, h, m in
            [(9, 12, 59), (9, 13, 0), (9, 13, 5), (10, 12, 0), (3, 13, 0), (3, 12, 59)]]
    logs = spark.createDataFrame(rows, "t STRING").select(F.col("t").cast("timestamp").alias("ts"))
    now = datetime(2024, 1, 10, 12, 30)
    got = lambda p: sorted((str(r.date), r.log_count) for r in ol.log_volume(logs, now, p).collect())
    assert got("one_day") == [("2024-01-09 13:00:00", 2), ("2024-01-10 12:00:00", 1)]
    assert got("one_week") == [("2024-01-03 00:00:00", 1), ("2024-01-09 00:00:00", 3), ("2024-01-10 00:00:00", 1)]
    assert got("two_weeks")[0] == ("2024-01-03 00:00:00", 2)
    assert got("a_year") == []


def test_days_of_an_interval(spark):
    df = spark.createDataFrame([("2024-01-01 23:00:00", "2024-01-03 01:00:00")], "a STRING, b STRING")
    spans = df.select(F.col("a").cast("timestamp").alias("start"), F.col("b").cast("timestamp").alias("end"))
    rows = ol.expand_days(spans).orderBy("day").collect()
    assert [(r.day, str(r.day_start)[11:], str(r.day_end)[11:]) for r in rows] == [
        ("2024-01-01", "23:00:00", "23:59:59.999999"),
        ("2024-01-02", "00:00:00", "23:59:59.999999"),
        ("2024-01-03", "00:00:00", "01:00:00"),
    ]


def test_day_partitions_are_pruned(spark, tmp_path):
    folder = str(tmp_path / "d")
    spark.sql("SELECT id, date_add(DATE'2024-01-01', cast(id % 9 AS int)) AS day FROM range(90)").write.partitionBy("day").parquet(folder)
    picked = ol.select_days(spark.read.parquet(folder), datetime(2024, 1, 3, 7), datetime(2024, 1, 4))
    assert picked.count() == 20
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_first_of_each_slice_and_dense_numbers(spark):
    rows = [(f"l{i:02d}", i * 60) for i in range(12)] + [("z", 86_400 + 3600)]
    df = spark.createDataFrame(rows, "log_id STRING, sec LONG").withColumn("ts", F.timestamp_seconds("sec"))
    kept = {r.log_id for r in ol.first_n_per_slice(df, n=2).collect()}
    assert kept == {"l00", "l01", "l05", "l06", "l10", "l11", "z"}
    numbers = {r.log_id: r.row for r in ol.renumber_slices(df.repartition(5)).collect()}
    assert numbers == {name: i for i, (name, _) in enumerate(rows)}
