import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import bagminhash as bm


def bag_of(text):
    words = (text or "").lower().split()
    if 0 < len(words) < bm.WORDS:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + bm.WORDS]) for i in range(len(words) - bm.WORDS + 1))


def classes_by_hand(rows):
    """Smallest doc_id of the component of each row, comparing all pairs that share a shingle."""
    bags, parent = [bag_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            low = sum((bags[i] & bags[j]).values())
            high = sum((bags[i] | bags[j]).values())
            if not high or low / high >= bm.SIMILARITY:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[find(i)].append(doc_id)
    return Counter((rows[i][0], min(members[find(i)], key=lambda d: (d is None, d or 0))) for i in range(len(rows)))


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.class_id) for r in bm.near_duplicates(df).collect()) == classes_by_hand(rows)


def test_against_brute_force(docs):
    check(docs)


def test_odd_tables(odd, none):
    check(odd)
    assert bm.near_duplicates(none).count() == 0
    wide = odd.withColumns({c: F.lit(1) for c in ("class_id", "row", "node", "words", "bands")})
    assert bm.near_duplicates(wide).count() == odd.count()


def test_large_group_and_chains(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(120):  # near copies of one text
        words = list(base)
        for _ in range(3):
            words[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(400)]
    for i in range(12):  # each is near the next one only
        rows.append((1000 + i, " ".join(chain[i * 20 : i * 20 + 260])))
    shared = " ".join(f"p{i}" for i in range(80))
    for i in range(60):  # a passage in common, nothing else
        rows.append((2000 + i, shared + " " + " ".join(f"u{i}_{j}" for j in range(120))))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_bucket_with_several_classes_loses_no_link(spark, monkeypatch):
    """All texts share one bucket, so centres have to be taken in turns."""
    real = bm._sketch

    def coarse(batches):
        import pyarrow as pa

        for batch in real(batches):
            one = pa.array([[7]] * batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), one, batch.column(2)], names=["row", "bands", "slots"])

    monkeypatch.setattr(bm, "CENTRES", 2)
    monkeypatch.setattr(bm, "_sketch", coarse)
    rng = random.Random(6)
    rows = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(100)]
        for i in range(5):
            words = list(base)
            words[rng.randrange(100)] = f"x{rng.random()}"
            rows.append((group * 10 + i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("seed", range(3))
def test_estimate_is_unbiased_for_weighted_jaccard(seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(1, 1 << 62, 80).astype(np.uint64)
    a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    left, right = dict(zip(keys[:60], a)), dict(zip(keys[20:], b))
    low = sum(min(left.get(k, 0), right.get(k, 0)) for k in keys)
    high = sum(max(left.get(k, 0), right.get(k, 0)) for k in keys)
    times = bm.signatures(np.repeat([0, 1], 60), np.concatenate([keys[:60], keys[20:]]), np.concatenate([a, b]), 2, 4096)
    assert np.isfinite(times).all()
    assert abs((times[0] == times[1]).mean() - low / high) < 4 * (0.25 / 4096) ** 0.5


def test_exact_overlap():
    words = np.arange(1, 40, dtype=np.int64)
    over = lambda a, b: bm.overlap(bm.bag(a), bm.bag(b))
    assert over(words, words) == 1.0
    assert over(words, words[:0]) == 0.0
    assert abs(over(np.ones(24, np.int64), np.ones(14, np.int64)) - 0.5) < 1e-12


def test_copies_changed_in_different_places_lose_no_link(spark):
    """Many pairs lie just below or above the limit; shingle counts rule out part of them."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [f"x{rng.randrange(400)}"] * rng.randrange(3)
        rows.append((i, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))
