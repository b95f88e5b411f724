import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows, wanted, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in wanted:
        score = x @ np.array(v, np.float32).astype(float)
        score[ids == i] = -np.inf
        order = np.lexsort((ids, -np.round(score, 12)))[: min(k, (ids != i).sum())]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def check(df, queries, rows, wanted, k=20, **shape):
    got = {}
    for r in neighbours.nearest(df, queries, k, **shape).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = by_hand(rows, wanted, k)
    assert set(got) == {i for i, near in want.items() if near}
    for i in got:
        assert [a for a, _ in got[i]] == [a for a, _ in want[i]], i
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("shape", [{}, {"shard_rows": 60, "block_rows": 7}])
def test_factor_one_is_exact(spark, sf_dir, shape):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(df, df.filter("vec_id % 20 = 0"), rows, [r for r in rows if r[0] % 20 == 0], **shape)


def test_ties_repeated_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(400)]  # one large group of equal vectors
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [None] + [1.0] * 7), (2003, [float("nan")] * 8),
           (2004, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:5], SCHEMA)
    check(df, df.filter("vec_id % 3 = 0"), rows, [r for r in rows if r[0] % 3 == 0], shard_rows=200)


def test_few_candidates_other_lengths_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [0.0, 1.0])]
    df = spark.createDataFrame([*rows, (5, [1.0])], SCHEMA)
    check(df.filter("vec_id <> 5"), df.filter("vec_id = 20"), rows, rows[2:])
    assert {r.vec_id for r in neighbours.nearest(df, df.filter("vec_id = 20")).collect()} == {1, 2}
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.nearest(df, df.limit(0)).count() == 0
    wide = df.withColumns({"dim": F.lit("x"), "shard": F.lit("y"), "label": F.lit(1)})
    assert neighbours.nearest(wide, wide).count() == neighbours.nearest(df, df).count()


def test_recall_of_the_registered_factor(spark, sf_dir):
    from opsframe.llm import queries

    big = sf_dir.replace("0.001", "0.1")
    df = spark.read.parquet(f"{big}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = by_hand(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {(r.query_id, r.vec_id) for r in queries.BUILDS["op9_vantage_points"](spark, big).collect()}
    assert sum((i, a) in got for i, near in want.items() for a, _ in near) >= 0.9 * sum(map(len, want.values()))


def test_tree_bounds_hold():
    points = np.random.default_rng(4).normal(size=(1000, 6))
    order, leaves, sides = neighbours.grow(points, 50)
    assert sorted(order) == list(range(1000)) and sorted(leaves)[0][0] == 0
    for (lo, hi), above in zip(leaves, sides):
        for vantage, least, most in above:
            away = np.sqrt(((points[order[lo:hi]] - points[vantage]) ** 2).sum(1))
            assert least - 1e-9 <= away.min() and away.max() <= most + 1e-9


@pytest.mark.parametrize("kind,scale", [("float", 1e-7), ("double", 1e-40), ("double", 1e40), ("double", 1.0)])
def test_exact_at_any_scale_and_in_the_type_given(spark, kind, scale):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(400, 12)) * scale).astype(np.float32 if kind == "float" else np.float64).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=90).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for i, near in got.items():
        score = x @ x[i]
        score[i] = -np.inf
        assert [a for a, _ in near] == np.argsort(-score)[:20].tolist()
        assert np.allclose([s for _, s in near], [score[a] for a, _ in near], rtol=1e-12)
