"""Registered queries: SQL counterparts, whole tables, native plans."""

import pytest
from compare import assert_same, connect

import __spark_entry__ as driver
from opsframe.llm import queries

NATIVE = [n for n in queries.BUILDS if n.split("_")[0] in ("op1", "op3", "op8", "op10")]


def test_all_operators_and_the_pipeline_are_registered():
    found = driver.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in found and set(driver.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    assert_same(queries.BUILDS[name](spark, sf_dir), connect(sf_dir), queries.SQL[name])


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, sf_dir, name):
    plan = queries.BUILDS[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
