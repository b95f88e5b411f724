"""One key with a third of all rows: same answers, and no task gets the whole key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.operators import compress as oc, metrics as om, ordered as oo, sessions as os_, traces as ot

HOT_ROWS = 30_000


def _lines(spark):
    """A third of the rows in one stream, the others spread over 200."""
    n = HOT_ROWS
    hot = spark.range(n).select(F.lit("hot").alias("stream"), F.col("id").alias("seq"))
    rest = spark.range(2 * n).select(
        F.concat(F.lit("s"), F.col("id") % 200).alias("stream"), F.floor(F.col("id") / 200).alias("seq")
    )
    word = F.element_at(F.array(*[F.lit(w) for w in "abc"]), (F.xxhash64("stream", "seq") % 3 + 3).cast("int") % 3 + 1)
    return hot.unionByName(rest).withColumn("line", F.concat(word, F.lit(" at "), F.col("seq") % 60 + 10, F.lit("s")))


def _largest_task(df, keys):
    """Most rows that share the partitioning keys of a window or aggregate."""
    return df.groupBy(*keys).count().agg(F.max("count")).collect()[0][0]


def test_compression(spark):
    lines = _lines(spark)
    got = oc.compress_lines(lines, lines_per_bucket=1_000)
    w = Window.partitionBy("stream").orderBy("seq")
    same = F.split_part("line", F.lit(" "), F.lit(1)) == F.lead(F.split_part("line", F.lit(" "), F.lit(1))).over(w)
    want = lines.withColumn("same", same).filter("same IS NULL OR NOT same").drop("same")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    buckets = lines.withColumn("_bucket", F.floor(F.col("seq") / 1_000))
    assert _largest_task(buckets, ["stream", "_bucket"]) <= 1_000
    thinned = lines.filter("seq % 1000 > 2 AND seq % 7 <> 0")
    whole = oc.compress_lines(thinned)
    for size in (2, 5):
        part = oc.compress_lines(thinned, lines_per_bucket=size)
        assert part.exceptAll(whole).count() == 0 and whole.exceptAll(part).count() == 0


def test_null_keys_are_kept(spark):
    rows = spark.createDataFrame([(None, 1), (None, 5), ("a", 2), ("a", None)], "stream string, seq long")
    numbered = oo.number_rows(rows, ["stream"], [F.col("seq")], F.floor(F.col("seq") / 2), "place").collect()
    assert sorted((r.stream or "", r.place) for r in numbered) == [("", 0), ("", 1), ("a", 0), ("a", 1)]


def test_numbering_and_running_totals(spark):
    lines = _lines(spark).filter("xxhash64(stream, seq) % 4 <> 0")
    w = Window.partitionBy("stream").orderBy("seq")
    got = oc.renumber(lines, 1_000)
    want = lines.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
    assert got.exceptAll(want).count() == 0 and want.count() == got.count()
    for descending in (False, True):
        order = F.desc("seq") if descending else F.asc("seq")
        value = F.length("line").cast("long")
        got = oo.running_total(
            lines, ["stream"], [order], F.floor(F.col("seq") / 1_000), value, "total", descending)
        total = F.sum(value).over(Window.partitionBy("stream").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        assert got.exceptAll(lines.withColumn("total", total).select(got.columns)).count() == 0


def test_first_n_is_cut_before_the_exchange(spark):
    lines = _lines(spark)
    got = oo.first_n(lines, ["stream"], [F.col("seq")], 50)
    assert got.count() == 201 * 50 and got.agg(F.max("seq")).collect()[0][0] == 49
    plan = got._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in below


def test_rates(spark):
    lines = _lines(spark)
    samples = lines.select(
        F.col("stream").alias("series"), F.timestamp_seconds(F.col("seq") + 1_700_000_000).alias("ts"),
        F.col("seq").alias("sample_id"), (F.col("seq") % 100).cast("double").alias("value"))
    got = om.rate(samples, ["series"], 300, 60)
    # A window of 300 samples a second apart rises by 1 each, and by 0 (to the new value) at a reset.
    full = got.filter("series = 'hot' AND t > 1700000300 AND t < 1700030000").collect()
    assert len(full) == 495
    for r in full:
        steps = range(r.t - 1_700_000_000 - 298, r.t - 1_700_000_000 + 1)
        assert r.value == pytest.approx(sum(s % 100 != 0 for s in steps) / 299)
    cells = samples.withColumn("cell", F.ceil(F.unix_seconds("ts") / 60))
    assert _largest_task(cells, ["series", "cell"]) <= 60


def test_span_copies(spark):
    copies = spark.range(HOT_ROWS).selectExpr(
        "'t' AS trace_id", "if(id % 3 = 0, 'hot', concat('s', id)) AS span_id", "'p' AS parent_span")
    got = ot.dedupe_spans(copies)
    assert got.count() == HOT_ROWS - HOT_ROWS // 3 + 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.rindex("Exchange hashpartitioning"):]


def test_long_session(spark):
    messages = _lines(spark).selectExpr(
        "stream AS session_id", "seq AS turn", "if(seq % 2 = 0, 'user', 'assistant') AS role", "line AS content")
    kept = os_.trim_history(messages, 10_000).filter("session_id = 'hot'")
    total = Window.partitionBy("session_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    cost = (F.ceil(F.length("content") / 4) + 4).cast("long")
    want = messages.withColumn("c", F.sum(cost).over(total)).filter("c <= 10000 AND session_id = 'hot'")
    assert kept.count() == want.count() > 1_000
    assert kept.select("turn").exceptAll(want.select("turn")).count() == 0
    offsets = os_.rendered_messages(messages).filter("session_id = 'hot'")
    ends = offsets.agg(F.max(F.col("offset") + F.length("rendered"))).collect()[0][0]
    assert ends == offsets.agg(F.sum(F.length("rendered"))).collect()[0][0]
