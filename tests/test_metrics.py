"""Metric operators on small tables with known answers."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from opsframe.functions import metrics as fm
from opsframe.operators import metrics as om
from opsframe.sources.readers import explode_metric_dump

DUMP = "metric MAP<STRING, STRING>, values ARRAY<ARRAY<STRING>>"


def _samples(spark, rows):
    """rows: (series, second, id, value)"""
    df = spark.createDataFrame(rows, "series STRING, sec LONG, sample_id LONG, value DOUBLE")
    return df.withColumn("ts", F.timestamp_seconds("sec"))


def _answers(df):
    return {(r.series, r.t): round(r.value, 9) for r in df.collect()}


def _brute_rate(rows, range_s, step_s, instant=False):
    out = {}
    for name in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == name], key=lambda r: (r[1], r[2]))
        last = mine[-1][1] + range_s
        for t in range(-(-mine[0][1] // step_s) * step_s, last + step_s, step_s):
            seen = [r for r in mine if t - range_s < r[1] <= t]
            if instant:
                seen = seen[-2:]
            if len(seen) < 2 or seen[-1][1] == seen[0][1]:
                continue
            rise = sum(b[3] - a[3] if b[3] >= a[3] else b[3] for a, b in zip(seen, seen[1:]))
            out[(name, t)] = round(rise / (seen[-1][1] - seen[0][1]), 9)
    return out


def test_rate_with_reset(spark):
    rows = [("a", 10, 0, 1.0), ("a", 20, 1, 5.0), ("a", 30, 2, 2.0)]
    got = _answers(om.rate(_samples(spark, rows), ["series"], 60, 60))
    assert got == {("a", 60): round((4 + 2) / 20, 9)}


def test_single_sample_gives_no_rate(spark):
    rows = [("a", 10, 0, 1.0)]
    assert om.rate(_samples(spark, rows), ["series"], 60, 60).count() == 0
    assert om.irate(_samples(spark, rows), ["series"], 60, 60).count() == 0
    assert om.gauge_at(_samples(spark, rows), ["series"], 60, 60).collect()[0].value == 1.0


@pytest.mark.parametrize("range_s,step_s,parts", [(300, 60, 1), (90, 60, 1), (60, 300, 1), (300, 15, 1), (120, 120, 8)])
def test_rates_equal_brute_force(spark, range_s, step_s, parts):
    import random

    rnd = random.Random(range_s * 1000 + step_s)
    rows = [
        (rnd.choice("aaaab"), rnd.randrange(0, 4000), i, float(rnd.randrange(0, 50))) for i in range(250)
    ]
    samples = _samples(spark, rows)
    assert _answers(om.rate(samples, ["series"], range_s, step_s, parts)) == _brute_rate(rows, range_s, step_s)
    got = _answers(om.irate(samples, ["series"], range_s, step_s, parts))
    assert got == _brute_rate(rows, range_s, step_s, instant=True)


def test_step_must_be_positive(spark):
    with pytest.raises(ValueError):
        om.rate(_samples(spark, [("a", 1, 0, 1.0)]), ["series"], 60, 0)


def test_dump_and_export(spark):
    net = {"__name__": "container_network_receive_bytes_total", "instance": "n1", "interface": "eth0"}
    rows = [
        ({**net, "pod": "geo-1"}, [["100.9", "0.0025"], ["160", "2.0005"]]),
        ({**net, "pod": "stranger"}, [["100", "1"]]),
        ({**net, "pod": "loadgenerator-x"}, [["100", "1"]]),
        ({"__name__": "container_memory_rss", "instance": "n1", "pod": "geo-1"}, [["100", "7"], ["101", "x"]]),
        ({"__name__": "unlisted", "instance": "n1", "pod": "geo-1"}, [["100", "7"]]),
    ]
    samples = explode_metric_dump(spark.createDataFrame(rows, DUMP))
    inventory = spark.createDataFrame([("geo-1",), ("loadgenerator-x",)], "pod STRING")
    got = {tuple(r) for r in om.export_metrics(samples, inventory).collect()}
    kpi = "container_network_receive_bytes_total.eth0"
    assert got == {
        (100, "n1.geo-1", kpi, 0.003),
        (160, "n1.geo-1", kpi, 2.001),
        (100, "n1.geo-1", "container_memory_rss", 7.0),
        (101, "n1.geo-1", "container_memory_rss", None),
    }
    start, end = (datetime.fromtimestamp(s, tz=timezone.utc) for s in (100, 160))
    assert om.export_metrics(samples, inventory, start, end).count() == 3


def test_families(spark):
    names = {
        "container_network_transmit_errors_total": "network",
        "container_cpu_usage_seconds_total": "counter",
        "container_last_seen": "counter",
        "container_memory_max_usage_bytes": "counter",
        "container_threads_max": "gauge",
    }
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    got = {r.name: r.f for r in df.withColumn("f", fm.metric_family(F.col("name"))).collect()}
    assert got == names
    assert len(fm.CONTAINER_METRICS) == 26 and len(fm.NETWORK_METRICS) == 8
