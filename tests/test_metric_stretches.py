"""Windows inside stretches of a series: no row per grid point is exchanged or grouped."""

import random

from pyspark.sql import functions as F

from opsframe.operators import metrics as om

SERIES = ["series"]


def _samples(spark, rows):
    return spark.createDataFrame(rows, "series string, us long, sample_id long, value double").select(
        "series", F.timestamp_micros("us").alias("ts"), "sample_id", "value")


def _latest(rows, range_s, step_s):
    out, rows = {}, sorted(rows)
    for t in range(-10 * step_s, 32_000, step_s):
        for name in "ab":
            seen = [r for r in rows if r[0] == name and (t - range_s) * 10**6 < r[1] <= t * 10**6]
            if seen:
                out[name, t] = max(seen, key=lambda r: r[1:3])[3]
    return out


def test_latest_values_across_stretches(spark):
    """Gaps of about a window, samples on the edges of stretches and at one time."""
    draw = random.Random(3)
    for range_s, step_s in ((300, 15), (100, 40), (30, 70)):
        edge = range_s * om.WINDOWS_PER_STRETCH
        at = [draw.randrange(0, 3 * edge) * 10**6 + draw.choice((0, 1)) for _ in range(150)]
        at += [n * edge * 10**6 + d for n in range(4) for d in (-1, 0, 1, 10**6, range_s * 10**6)] + [at[0]]
        rows = [(draw.choice("ab"), us, i, float(i)) for i, us in enumerate(at)]
        got = om.gauge_at(_samples(spark, rows), SERIES, range_s, step_s).collect()
        assert len(got) == len({(r.series, r.t) for r in got})
        assert {(r.series, r.t): r.value for r in got} == _latest(rows, range_s, step_s)


def test_rates_across_stretches(spark):
    """A gap just below the window over the edge of a stretch: the older sample must not answer after the newer."""
    edge = 3_600 * 24 * om.WINDOWS_PER_STRETCH
    rows = [("a", (edge + d * 3_600) * 10**6, i, float(i)) for i, d in enumerate((-30, -22, -2, 0, 1, 20, 22, 45))]
    samples = _samples(spark, rows)
    got = {r.t: r.value for r in om.rate(samples, SERIES, 86_400, 3_600).collect()}
    for t in range(edge - 40 * 3_600, edge + 80 * 3_600, 3_600):
        seen = [r for r in rows if (t - 86_400) * 10**6 < r[1] <= t * 10**6]
        span = seen[-1][1] - seen[0][1] if seen else 0
        assert (t in got) == (span > 0)
        assert not span or abs(got[t] - (seen[-1][3] - seen[0][3]) * 10**6 / span) < 1e-12


def test_grid_points_come_last(spark):
    """The operators exchange samples or fragments, never their grid points."""
    samples = _samples(spark, [("a", 1, 0, 1.0)])
    for df in (om.gauge_at(samples, SERIES), om.rate(samples, SERIES), om.irate(samples, SERIES)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanged = plan.rfind("Generate explode", 0, plan.index("Exchange"))
        assert exchanged > 0 and "Aggregate" not in plan[:exchanged]
