"""What travels: pod names once, flat spans with the columns asked for, landed files compressed."""

import glob
import re

from compare import SF_DIR

from opsframe.operators import health, traces
from opsframe.plans import sources
from opsframe.plans.adapters import raw_traces


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_pod_name_is_looked_up_once(spark):
    pods = spark.range(50).selectExpr("concat('ns', id) AS namespace", "concat('p', id % 3) AS pod")
    got = health.services_named_in(pods, spark.createDataFrame([("p1",), ("2",)], "service string"))
    looked = re.findall(r"Generate explode\(array_distinct\(flatten.*", _plan(got))
    assert looked and not any("namespace" in line for line in looked)
    assert {tuple(r) for r in got.collect()} == {
        (f"ns{i}", s, True) for i in range(50) for s in ("p1", "2") if s in f"p{i % 3}"}


def test_spans_are_flat_before_the_exchange(spark):
    plan = _plan(traces.spans_of_service(raw_traces(spark, SF_DIR), "svc3"))
    assert plan.index("Join") < plan.index("Generate explode(spans")


def test_gpu_trace_lands_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "scratch_path", lambda *_: str(tmp_path / "gpu"))
    assert sources.source_gpu_trace(spark, SF_DIR).count() > 0
    assert len(glob.glob(f"{tmp_path}/gpu/*.csv/*.csv.gz")) >= 7 and not glob.glob(f"{tmp_path}/gpu/*.csv/*.csv")
