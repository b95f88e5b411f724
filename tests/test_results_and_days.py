"""Results objects as columns, folders pruned at run time, chunks merged by key."""

import json

from compare import SF_DIR, assert_same, connect
from pyspark.sql import functions as F

from opsframe.functions.results import KEYS, column_name
from opsframe.operators.logs import logs_of_spans
from opsframe.operators.sessions import results_table
from opsframe.plans.catalog import CATALOG
from opsframe.sources.sinks import merge_metrics


def _split(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "session_id int, t string")
    return results_table(rows.select("session_id", F.parse_json("t").alias("results"))).orderBy("session_id").select(
        "*", F.to_json("rest").alias("text")).collect()


def test_declared_keys_are_typed_and_others_kept(spark):
    full = {"Detection Accuracy": "Correct", "Localization Accuracy": 50, "success": True, "steps": 3, "TTD": 1.5, "own": [1, {"a": None}]}
    odd = {"success": "yes", "steps": 2.5, "TTD": None, "in_tokens": "7", "Success": 1}
    one, two, none, array, word = _split(spark, json.dumps(full), json.dumps(odd), None, "[1]", '"x"')
    assert (one.detection_accuracy, one.localization_accuracy, one.success, one.steps, one.ttd) == ("Correct", 50.0, True, 3, 1.5)
    assert json.loads(one.text) == {"own": [1, {"a": None}]}
    assert (two.success, two.steps, two.ttd, two.in_tokens) == (None, None, None, None)
    assert json.loads(two.text) == {"success": "yes", "steps": 2.5, "in_tokens": "7", "Success": 1}
    assert none.text is None and array.text == "[1]" and word.text == '"x"'
    assert all(array[column_name(k)] is None for k in KEYS)


def _files_read(df) -> int:
    """Files listed by the last scan of the plan that ran."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if "FileSourceScan" in node.getClass().getSimpleName():
            found.append(node.metrics().get("numFiles").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    events = spark.range(24 * 30).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    events.withColumn("day", F.to_date("ts")).coalesce(1).write.partitionBy("day").parquet(str(tmp_path / "logs"))
    stored = spark.read.schema("id long, ts timestamp, day date").parquet(str(tmp_path / "logs"))
    at = lambda c: F.timestamp_seconds(F.col(c))
    asked = spark.createDataFrame([(86_400 * 3 + 3_600, 86_400 * 4 + 7_200, 1), (86_400 * 3, 86_400 * 3 + 9_000, 1), (86_400 * 9, 86_400 * 9, 1), (0, 9, 0)], "a long, b long, c int")
    asked.write.parquet(str(tmp_path / "asked"))
    spans = spark.read.parquet(str(tmp_path / "asked")).filter("c = 1").select(at("a").alias("start"), at("b").alias("end"))
    got = logs_of_spans(stored, spans)
    assert sorted(r.id for r in got.collect()) == [*range(72, 99), 216]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert 3 in _files_read(logs_of_spans(stored, spans))


KPI = "timestamp long, cmdb_id string, kpi_name string, value double"


def test_landing_a_chunk_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "kpi")
    rows = lambda *r: spark.createDataFrame(list(r), KPI)
    one = rows((0, "a", "k.x", 1.0), (60, "a", "k.x", 2.0), (86_400, "a", "k.x", 3.0), (0, "a", "m", 9.0))
    two = rows((86_400, "a", "k.x", 3.5), (86_460, "a", "k.x", 4.0))
    read = lambda: sorted(map(tuple, spark.read.parquet(folder).select("timestamp", "cmdb_id", "kpi_name", "value").collect()))
    merge_metrics(one, folder)
    merge_metrics(two, folder)
    first = read()
    assert first == [(0, "a", "k.x", 1.0), (0, "a", "m", 9.0), (60, "a", "k.x", 2.0), (86_400, "a", "k.x", 3.5), (86_460, "a", "k.x", 4.0)]
    merge_metrics(two, folder)
    merge_metrics(rows(), folder)
    assert read() == first


def test_queries(spark):
    for name in ("session_results_typed", "day_selection_dynamic", "metric_merge", "problems_remaining", "problems_except", "gpu_machine_load"):
        assert_same(CATALOG[name].build(spark, SF_DIR), connect(SF_DIR), CATALOG[name].sql)
    assert CATALOG["problems_remaining"].build(spark, SF_DIR).count() and CATALOG["problems_except"].build(spark, SF_DIR).count()
