"""Services given as tables, against the forms that take a list; nested and flat traces of a service."""

from pyspark.sql import functions as F

from compare import SF_DIR
from opsframe.functions.metrics import mesh_known
from opsframe.operators import health, metrics, traces
from opsframe.plans.adapters import raw_traces


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _no_nested_loop(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pods_of_many_services(spark):
    """A hundred thousand names, a third of the pods with one prefix."""
    pods = spark.range(3_000).selectExpr(
        "concat('ns', id % 7) AS namespace",
        "CASE WHEN id % 3 = 0 THEN concat('front-end-', id) WHEN id = 1 THEN NULL ELSE concat('p', id * 37, '-é', id) END AS pod")
    few = ["front-end", "front-end-9", "é1", "7", "-", "", "front-end-99999", "p37-"]
    named = lambda names: health.services_named_in(pods, spark.createDataFrame([(n,) for n in names], "service string"))
    want = health.services_with_pod(pods.filter("pod IS NOT NULL"), few)
    assert _rows(named([*few, None, "7"])) == _rows(want)
    many = spark.range(100_000).selectExpr("concat('svc-', id, '-x') AS service").unionByName(
        spark.createDataFrame([(n,) for n in few], "service string"))
    got = health.services_named_in(pods, many)
    _no_nested_loop(got)
    assert _rows(got) == _rows(want)


def test_mesh_of_known_services(spark):
    rows = [(i, s, d) for i, (s, d) in enumerate([("a", "b"), ("a", "x"), ("unknown", "x"), (None, "a"), ("x", "a"), ("b", None), ("unknown", None), ("b", "b")])]
    mesh = spark.createDataFrame(rows, "id int, source string, destination string")
    services = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "service string")
    want = mesh.filter(mesh_known(F.col("source"), F.col("destination"), ["a", "b"]))
    got = metrics.mesh_of_known(mesh, services)
    assert _rows(got) == _rows(want)
    big = services.unionByName(spark.range(100_000).selectExpr("concat('s', id) AS service"))
    _no_nested_loop(metrics.mesh_of_known(mesh, big))
    assert _rows(metrics.mesh_of_known(mesh, big)) == _rows(want)


def test_nested_traces_give_the_same_spans(spark):
    raw = raw_traces(spark, SF_DIR)
    flat = traces.flatten_spans(raw)
    middle = flat.selectExpr("percentile(start_time, 0.5)").first()[0]
    for args in ({}, {"since": int(middle)}, {"until": int(middle)}, {"limit": 7}, {"since": int(middle), "limit": 3}):
        want = traces.traces_of_service(flat, "svc3", **args).select("trace_id", "span_id", "start_time", "response")
        assert _rows(traces.spans_of_service(raw, "svc3", **args).select(*want.columns)) == _rows(want)
    assert traces.spans_of_service(raw, traces.UTILITY_SERVICE).count() == 0
    plan = traces.spans_of_service(raw, "svc3")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(spans") == 1
