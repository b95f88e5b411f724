"""Repeated passages against a table of all strings of 50 bytes."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from opsframe.llm import repeats

SMALL = repeats.Sizes(chunk=60_000, segment=5_000, bucket=200_000, around=8_000, hot=3)


def brute(rows):
    rows = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: 2**63 if i is None else i
    first = {}
    for i, text in rows:
        for p in range(len(text) - 49):
            first[text[p : p + 50]] = min(rank(i), first.get(text[p : p + 50], 2**64))
    out = []
    for i, text in rows:
        cover = bytearray(len(text))
        for p in range(len(text) - 49):
            if first[text[p : p + 50]] < rank(i):
                cover[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, gone in zip(text, cover) if not gone)
        spans = sum(gone and not (j and cover[j - 1]) for j, gone in enumerate(cover))
        out.append((i, len(text), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _same(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_table(docs):
    _same(repeats.without_repeats(docs), _pairs(docs))


def test_small_parts(docs):
    """Many chunks, buckets and ranges, long documents in segments, hot anchors dealt by stretch."""
    _same(repeats.without_repeats(docs.repartition(3, "doc_id"), sizes=SMALL), _pairs(docs))


def test_odd_rows(odd):
    wide = odd.selectExpr("*", "1 AS chunk", "2 AS ids", "'x' AS data")
    short = wide.withColumn("text", wide.text.substr(1, 20_000))
    _same(repeats.without_repeats(short, sizes=SMALL), _pairs(short))


def test_empty(none):
    assert repeats.without_repeats(none).collect() == []


def test_hot_line_and_copies(spark):
    """A third of the rows holds one line in ever different surroundings; another third is one text."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh "), 70))
    line, copy = word(), word() * 3
    rows = [(i * 7 % 600, f"{word()} {line} {word()}" if i % 3 == 0 else copy if i % 3 == 1 else word()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for sizes in (repeats.Sizes(), SMALL, SMALL._replace(chunk=2_000)):
        _same(repeats.without_repeats(docs, sizes=sizes), rows)


def test_kept_bytes(spark):
    passage = "the same passage of well over fifty bytes stands in both of these texts"
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, f"c {passage} d"), (3, "e")], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.without_repeats(docs, with_text=True).collect()}
    assert bytes(got[2].kept) == b"cd" and got[2].n_spans == 1 and got[3].kept is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=60))
def test_multikey_sort(pairs):
    words = np.array(pairs, dtype=np.uint64).reshape(-1, 2)
    order, new = repeats.multikey(words)
    rows = [tuple(words[i]) for i in order]
    assert rows == sorted(rows)
    assert list(new) == [i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))]


def test_equal_stretches_have_equal_anchors():
    text = np.random.default_rng(1).integers(97, 100, 3_000).astype(np.uint8)
    twice = np.concatenate([text, text[500:2_500]])
    owner = np.repeat([0, 1], [3_000, 2_000]).astype(np.int32)
    at, first, count, key, run = repeats.anchors(twice, owner, 700)
    offset = {}
    for a, f, n in zip(at, first, count):
        for p in range(f, f + n):
            assert offset.setdefault(twice[p : p + 50].tobytes(), a - p) == a - p
    assert count.sum() == 3_000 - 49 + 2_000 - 49
