"""Scorers, recovery checks and the problem catalogue on the documented cases."""

import pytest
from pyspark.sql import functions as F

from opsframe.functions.problems import catalogue_rows, problem_catalogue, problem_parts
from opsframe.operators import cluster as ocl, health as oh, scoring as osc

SOLUTION = "sol_kind STRING, sol_text STRING, sol_list ARRAY<STRING>, sol_map MAP<STRING, STRING>"


def _solution(spark, kind=None, text=None, items=None, pairs=None, **truth):
    df = spark.createDataFrame([(kind, text, items, pairs)], SOLUTION)
    return df.withColumns({name: F.lit(value) for name, value in truth.items()})


@pytest.mark.parametrize("kind,text,expected,accuracy", [
    ("text", " YES\n", "Yes", "Correct"), ("text", "no", "Yes", "Incorrect"), ("text", "no", "No", "Correct"),
    ("list", None, "Yes", "Invalid Format"), (None, None, "No", "Invalid Format"), ("number", "1", "Yes", "Invalid Format"),
])
def test_detection(spark, kind, text, expected, accuracy):
    df = _solution(spark, kind, text, expected=expected)
    assert osc.score_detection(df).collect()[0].accuracy == accuracy


@pytest.mark.parametrize("kind,text,items,want", [
    (None, None, None, (0.0, False, False)),
    ("none", None, None, (0.0, False, False)),
    ("text", "geo", None, (100.0, True, False)),
    ("list", None, ["geo"], (100.0, True, True)),
    ("list", None, ["geo", "rate"], (50.0, False, True)),
    ("list", None, ["geo", "geo"], (50.0, False, True)),
    ("list", None, ["rate"], (0.0, False, False)),
    ("list", None, [], (0.0, False, False)),
    ("number", "1", None, (0.0, False, False)),
])
def test_localization(spark, kind, text, items, want):
    row = osc.score_localization(_solution(spark, kind, text, items, component="geo")).collect()[0]
    assert (row.loc_accuracy, row.success, row.is_subset) == want


@pytest.mark.parametrize("kind,pairs,want", [
    ("map", {"system_level": " application ", "fault_type": "MISCONFIGURATION"}, (True, True, True)),
    ("map", {"system_level": "Application"}, (True, False, False)),
    ("map", {}, (False, False, False)), ("text", None, (False, False, False)), (None, None, (False, False, False)),
])
def test_analysis(spark, kind, pairs, want):
    df = _solution(spark, kind, None, None, pairs, system_level="Application", fault_type="Misconfiguration")
    row = osc.score_analysis(df).collect()[0]
    assert (row.system_level_correct, row.fault_type_correct, row.success) == want


STATUS = "namespace STRING, pod STRING, container STRING, ready BOOLEAN, waiting_reason STRING, terminated_reason STRING"


@pytest.mark.parametrize("ready,waiting,terminated,healthy,lenient", [
    (True, None, None, True, True),
    (True, "CrashLoopBackOff", None, False, False),
    (False, "ErrImagePull", None, False, False),
    (False, "ContainerCreating", None, False, True),
    (True, None, "Completed", True, True),
    (False, None, "Completed", False, False),
    (True, None, "Error", False, False),
    (False, None, None, False, False),
])
def test_health(spark, ready, waiting, terminated, healthy, lenient):
    rows = [("ns", "p", "good", True, None, None), ("ns", "p", "c", ready, waiting, terminated)]
    statuses = spark.createDataFrame(rows, STATUS)
    spaces = spark.createDataFrame([("ns",), ("empty",)], "namespace STRING")
    got = {r.namespace: (r.healthy, r.healthy_lenient) for r in oh.namespace_health(statuses, spaces).collect()}
    assert got == {"ns": (healthy, lenient), "empty": (True, True)}


def test_readiness(spark):
    statuses = spark.createDataFrame(
        [("ok", "p", "c", True, None, None), ("part", "p", "c", True, None, None), ("bad", "p", "c", False, None, None)], STATUS)
    pods = spark.createDataFrame([("ok", "p"), ("part", "p"), ("part", "q"), ("bad", "p")], "namespace STRING, pod STRING")
    spaces = spark.createDataFrame([("ok",), ("part",), ("bad",), ("empty",)], "namespace STRING")
    got = {r.namespace: r.all_ready for r in oh.readiness(statuses, pods, spaces).collect()}
    assert got == {"ok": True, "part": False, "bad": False, "empty": False}


def test_catalogue(spark):
    rows = catalogue_rows()
    tasks = [r[2] for r in rows]
    assert len(rows) == len({r[0] for r in rows}) == 89
    assert {t: tasks.count(t) for t in set(tasks)} == {"detection": 34, "localization": 28, "analysis": 13, "mitigation": 14}
    assert sum(r[6] == "No" for r in rows) == 3
    df = problem_catalogue(spark).withColumn("p", problem_parts(F.col("problem_id")))
    for r in df.collect():
        assert (r.p.fault, r.p.task, r.p.idx) == (r.fault, r.task, r.idx)


def test_whole_sessions(spark):
    call = lambda text: [("user", "go"), ("assistant", f"```\n{text}\n```"), ("env", "ok")]
    rows = [
        ("d", "container_kill-detection", call("submit('yes')")),
        ("l", "container_kill-localization", call("submit(['geo'])")),
        ("a", "wrong_bin_usage-analysis-1", call("submit({'system_level': 'application', 'fault_type': 'x'})")),
        ("m", "wrong_bin_usage-mitigation-1", call("submit()")),
        ("n", "noop_detection_social_network-1", call("submit('No')")),
        ("e", "container_kill-detection", []),
        ("u", "nobody-knows-detection", call("submit('yes')")),
    ]
    sessions = spark.createDataFrame(
        [(s, "agent", p, 1.0, 3.5, t) for s, p, t in rows],
        "session_id STRING, agent STRING, problem_id STRING, start_time DOUBLE, end_time DOUBLE, trace ARRAY<STRUCT<role: STRING, content: STRING>>")
    checks = spark.createDataFrame([("m", True)], "session_id STRING, success BOOLEAN")
    got = {r.session_id: r for r in osc.evaluate(sessions, problem_catalogue(spark), checks).collect()}
    assert set(got) == set("dlamne")
    assert {k: r.success for k, r in got.items()} == {"d": True, "l": True, "a": False, "m": True, "n": True, "e": False}
    assert (got["d"].TTD, got["d"].TTL, got["l"].TTL, got["m"].task_time) == (2.5, None, 2.5, 2.5)
    assert (got["l"].localization_accuracy, got["a"].system_level_correct, got["a"].fault_type_correct) == (100.0, True, False)
    assert (got["e"].steps, got["e"].detection_accuracy, got["d"].steps) == (0, "Invalid Format", 1)
    unknown = osc.unknown_problems(sessions, problem_catalogue(spark))
    assert [r.session_id for r in unknown.collect()] == ["u"]


def test_training_job_shape(spark):
    rows = [("bert_train_1", "xtensorflow", 8, 800.0, 100.0), ("bert_train_1", "ps", 2, 1600.0, 0.0), ("solo", "worker", 4, 100.0, 50.0)]
    task = spark.createDataFrame(rows, "job_name STRING, task_name STRING, inst_num INT, plan_cpu DOUBLE, plan_gpu DOUBLE")
    got = {r.job_name: tuple(r)[1:] for r in ocl.job_shape(task).collect()}
    assert got == {"bert_train_1": (2, 10, 8.0, 96.0, "parameter_server"), "solo": (1, 4, 2.0, 4.0, "all_reduce")}


def test_evaluate_takes_its_rules_from_the_registry(spark, monkeypatch):
    rows = [("d", "container_kill-detection"), ("m", "wrong_bin_usage-mitigation-1")]
    sessions = spark.createDataFrame(
        [(s, "agent", p, 1.0, 3.5, []) for s, p in rows],
        "session_id STRING, agent STRING, problem_id STRING, start_time DOUBLE, end_time DOUBLE, trace ARRAY<STRUCT<role: STRING, content: STRING>>")
    monkeypatch.setitem(osc.SCORERS, "mitigation", lambda df: df.withColumn("success", F.col("steps") == 0))
    got = {r.session_id: r.success for r in osc.evaluate(sessions, problem_catalogue(spark)).collect()}
    assert got == {"d": False, "m": True}
