"""Line splitting and log compression, also against a sequential fold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from opsframe.functions import lines as fl
from opsframe.operators import compress as oc
from opsframe.sources.readers import read_log_lines

STAMP = re.compile(fl.TIMESTAMP_PATTERN)


def _table(spark, text, stream="s"):
    lines = text if isinstance(text, list) else text.splitlines()
    rows = [(stream, i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "stream STRING, seq LONG, line STRING")


def _texts(df):
    return [r.line for r in df.orderBy("stream", "seq").collect()]


def _fold(blocks):
    """Sequential form of one pass."""
    kept = []
    for block in blocks:
        if kept and _equal(kept[-1], block):
            kept[-1] = block
        else:
            kept.append(block)
    return kept


def _equal(a, b):
    blank = lambda text: STAMP.sub(lambda m: " " * len(m.group()), text)
    starts = lambda text: [m.start() for m in STAMP.finditer(text)]
    return bool(starts(a)) and starts(a) == starts(b) and blank(a) == blank(b)


def _fold_multi(lines, window):
    for k in range(1, window + 1):
        lines = _fold(["\n".join(lines[i:i + k]) for i in range(0, len(lines), k)])
    return lines


@pytest.mark.parametrize("line,found", [
    ("2025-09-24 18:41:09 some log message", ["2025-09-24 18:41:09"]),
    ("Start 2025-09-24T18:41:09Z end 2025-09-24T19:00:00Z", ["2025-09-24T18:41:09Z", "2025-09-24T19:00:00Z"]),
    ("no timestamp here", []),
    ("2025-Sep-24 18:41:09.830218 x", ["2025-Sep-24 18:41:09.830218"]),
    ("at 18:41:09, after 10m5s and 30s", ["18:41:09", "10m5s", "30s"]),
    ("Wed Sep 24 18:41:09 2025 up", ["18:41:09"]),
    ("1234s5 x30s", []),
])
def test_timestamps(spark, line, found):
    got = _table(spark, [line]).select(fl.timestamps(F.col("line")).alias("t")).collect()[0].t
    assert got == [m.group() for m in STAMP.finditer(line)]
    if "Wed" not in line:
        assert got == found


def test_blocks(spark):
    assert _texts(oc.block_lines(_table(spark, list("abcde")), 2)) == ["a\nb", "c\nd", "e"]
    with pytest.raises(ValueError):
        oc.block_lines(_table(spark, ["x"]), 0)


@pytest.mark.parametrize("lines,kept", [
    (['{"time":"2025-09-25T04:36:33Z","msg":"foo"}', '{"time":"2025-09-25T04:36:34Z","msg":"foo"}'], [1]),
    (['{"time":"2025-09-25T04:36:33Z","msg":"foo"}', '{"time":"2025-09-25T04:36:33Z","msg":"bar"}'], [0, 1]),
    (["x", "x"], [0, 1]),
    ([], []),
    # The same text with the blank inside or behind the timestamp.
    (["at 2025-09-25T04:36:33Z x", "at 2025-09-25T04:36:33  x"], [1]),
    (["\u0001 1s", "1s 1s"], [0, 1]),
])
def test_one_pass(spark, lines, kept):
    assert _texts(oc.compress_lines(_table(spark, lines))) == [lines[i] for i in kept]


KUBERNETES = """Error: Your service/namespace does not exist. Use kubectl to check.
{"level":"info","time":"2025-09-25T04:36:33Z","message":"TLS disabled."}
{"level":"info","time":"2025-09-25T04:36:33Z","message":"TLS disabled."}
{"level":"info","time":"2025-09-25T04:36:34Z","message":"TLS disabled."}"""
COLOURED = """[90m2025-09-25T04:36:33Z[0m [32mINF[0m [1mcmd/geo/db.go:29[0m > New session successfull...[0m
[90m2025-09-25T04:36:34Z[0m [32mINF[0m [1mcmd/geo/db.go:29[0m > New session successfull...[0m
[90m2025-09-25T04:36:35Z[0m [32mINF[0m [1mcmd/geo/db.go:31[0m > Generating test data...[0m"""
TUNING = "\n".join(
    f'{{"level":"info","time":"2025-09-25T04:37:{i:02d}Z","message":"Tune: setGCPercent to 100"}}' for i in range(3)
)


@pytest.mark.parametrize("text,phrase,total", [
    (KUBERNETES, "TLS disabled.", 2), (COLOURED, "New session", 2), (TUNING, "setGCPercent", 1),
])
def test_realistic_logs(spark, text, phrase, total):
    got = _texts(oc.compress_multi(_table(spark, text), 3))
    assert "\n".join(got).count(phrase) == 1
    assert len("\n".join(got).splitlines()) == total
    assert got == _fold_multi(text.splitlines(), 3)


@pytest.mark.parametrize("window", [None, "many", 0, -2])
def test_compression_switched_off(spark, window):
    assert _texts(oc.compress_multi(_table(spark, ["a 1s", "a 2s"]), window)) == ["a 1s", "a 2s"]


def test_third_pass_joins_six_lines(spark):
    lines = [f"line {i} at {i}s" for i in range(12)]
    assert [t.count("\n") + 1 for t in _texts(oc.compress_multi(_table(spark, lines), 3))] == [6, 6]


def test_passes_equal_a_sequential_fold(spark):
    rnd = random.Random(7)
    words = ["up at {}s", "down {}s", "plain", "t 2025-01-01T00:00:{:02d}Z", "{}m1s late", "seen {}s {}s"]
    streams = {
        f"s{n}": [rnd.choice(words[: rnd.randrange(1, 7)]).format(rnd.randrange(60), rnd.randrange(60)) for _ in range(rnd.randrange(0, 40))]
        for n in range(40)
    }
    rows = [(s, i, line) for s, lines in streams.items() for i, line in enumerate(lines)]
    table = spark.createDataFrame(rows, "stream STRING, seq LONG, line STRING")
    # Buckets of five lines, so that most streams cross several of them.
    got = {}
    for r in oc.compress_multi(table, 3, lines_per_bucket=5).orderBy("stream", "seq").collect():
        got.setdefault(r.stream, []).append(r.line)
    assert got == {s: _fold_multi(lines, 3) for s, lines in streams.items() if lines}


@pytest.mark.parametrize("text", ["a\nb\n", "a\r\nb\rc", "", "\n", "x\n\n", "a\x0bb\x0cc\x1cd\x85e f g", "tail\x0b"])
def test_split_lines_like_text_lines(spark, text):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(fl.split_lines(F.col("t")).alias("x")).collect()[0].x == text.splitlines()


def test_read_log_lines_over_many_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 17)}" for i in range(3000)]
    lines[5] = "two\x0bin one"
    lines[9] = ""
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("only\r\nthis")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_log_lines(spark, str(tmp_path)).orderBy("stream", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {"a.log": "\n".join(lines).splitlines(), "b.log": ["only", "this"]}
    for name, texts in want.items():
        mine = [(r.seq, r.line) for r in rows if r.stream.endswith(name)]
        assert mine == list(enumerate(texts))
