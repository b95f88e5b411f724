"""Nearest neighbours by inner product with one vantage-point tree per shard.

Divided by the largest norm and with a component sqrt(1 - |x|^2) added, vectors lie on a sphere, which makes the largest inner product the smallest
Euclidean distance, so the triangle inequality holds. A tree splits its shard at the median distance
from a vantage point, again and again; each side keeps the range of its distances. For a query the
distance to a vantage point and that range bound the distance to all vectors of the side. A leaf is
left out if ``factor`` times its bound lies beyond the k-th distance found so far: with factor 1
nothing nearer can be lost, larger factors leave out more.

Shards hold a bounded number of vectors, queries come in blocks of a bounded size, and each pair of
shard and block is a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import landed

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF = 128
#: Products that a search compares may differ from the exact ones by this share of the norms; what lies
#: so close to the k-th is kept and ranked by its exact score.
SLACK = 1e-12


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``embedding``, ``dim``: no nulls, no null or non-finite component, not all zero."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    one = vectors.filter(x.isNotNull() & F.col("vec_id").isNotNull()).filter(finite & F.exists(x, lambda c: c != 0))
    # A vec_id stands for one vector: the smallest, where rows repeat it.
    return one.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def grow(points: np.ndarray, leaf: int = LEAF):
    """A tree over the rows of ``points``: their order, the leaves' ranges in it, and for each leaf
    the (vantage row, least, greatest distance) of all sides it lies in."""
    order = np.arange(len(points))
    leaves, sides = [], []
    stack = [(0, len(points), [])]
    while stack:
        lo, hi, above = stack.pop()
        if hi - lo <= leaf:
            leaves.append((lo, hi))
            sides.append(above)
            continue
        # The point farthest from the first one is near the rim, which splits well.
        seen = points[order[lo:hi]]
        vantage = order[lo + int(np.argmax(((seen - seen[0]) ** 2).sum(1)))]
        far = np.sqrt(((seen - points[vantage]) ** 2).sum(1))
        by = np.argsort(far, kind="stable")
        order[lo:hi], far, mid = order[lo:hi][by], far[by], (hi - lo) // 2
        stack.append((lo + mid, hi, [*above, (vantage, far[mid], far[-1])]))
        stack.append((lo, lo + mid, [*above, (vantage, far[0], far[mid - 1])]))
    return order, leaves, sides


def search(ids, vectors, tree, query_ids, queries, k: int, factor: float, top: float) -> pd.DataFrame:
    """The ``k`` nearest of a shard for each query: query_id, vec_id, score.

    The search runs on vectors divided by the largest norm and queries of length one, so that its
    tolerances mean the same at any scale.
    """
    order, leaves, sides = tree
    given, asked = vectors.astype(np.float64), queries.astype(np.float64)
    x, q = given / np.sqrt(top), asked / np.abs(asked).max(1, keepdims=True)
    q /= np.sqrt((q * q).sum(1, keepdims=True))
    squares = np.full(len(q), 2.0)
    bounds = np.zeros((len(q), len(leaves)))
    rooms: dict[int, np.ndarray] = {}
    for i, above in enumerate(sides):
        for vantage, least, most in above:
            if vantage not in rooms:
                rooms[vantage] = np.sqrt(np.maximum(squares - 2 * (q @ x[vantage]), 0))
            away = rooms[vantage]
            np.maximum(bounds[:, i], np.maximum(away - most, least - away), out=bounds[:, i])
    best = np.full((len(q), k), -np.inf)
    nearest = bounds.argmin(1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def visit(leaf: int, who: np.ndarray) -> None:
        rows = order[leaves[leaf][0] : leaves[leaf][1]]
        score = q[who] @ x[rows].T
        score[query_ids[who][:, None] == ids[rows][None, :]] = -np.inf
        both = np.concatenate([best[who], score], 1)
        best[who] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
        a, b = np.nonzero((score >= best[who].min(1)[:, None] - SLACK) & (score > -np.inf))
        found.append((who[a], rows[b], score[a, b]))

    for leaf in range(len(leaves)):
        who = np.flatnonzero(nearest == leaf)
        if len(who):
            visit(leaf, who)
    for leaf in np.argsort(bounds.mean(0)):
        kth = np.sqrt(np.maximum(squares - 2 * best.min(1), 0)) * (1 + 1e-9) + 1e-9
        who = np.flatnonzero((factor * bounds[:, leaf] <= kth) & (nearest != leaf))
        if len(who):
            visit(leaf, who)
    who, row, score = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int),) * 3
    kept = score >= best.min(1)[who] - SLACK
    who, row = who[kept], row[kept]
    exact = (given[row] * asked[who]).sum(1)
    sort = np.lexsort((ids[row], -exact, who))
    who, row, exact = who[sort], row[sort], exact[sort]
    near = np.arange(len(who)) - np.searchsorted(who, who) < k
    return pd.DataFrame({"query_id": query_ids[who[near]], "vec_id": ids[row[near]], "score": exact[near]})


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = 1.0,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the nearest of each query, nearest first.

    Ties go to the smaller vec_id; a query's own vec_id is no candidate. Unusable vectors (see
    ``usable``) take no part, and vectors are compared with those of their own length only. A query
    with fewer candidates than ``k`` gets them all; empty tables give no rows.
    """
    base, asked = landed(usable(vectors), "vectors"), usable(queries)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows, top = base.agg(F.count(F.lit(1)), F.max(norm)).first()
    wanted = asked.count()
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-wanted // block_rows))
    top = (top or 1.0) * (1 + 1e-9)
    # As given: an array of doubles stays one.
    kind = np.float64 if dict(base.dtypes)["embedding"] == "array<double>" else np.float32

    def index(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        x = np.stack(group["embedding"].to_list()).astype(kind)
        wide = x.astype(np.float64) / np.sqrt(top)
        order, leaves, sides = grow(np.c_[wide, np.sqrt(np.maximum(1 - (wide * wide).sum(1), 0))])
        flat = [(i, *side) for i, above in enumerate(sides) for side in above]
        return pd.DataFrame({
            "dim": [x.shape[1]], "shard": [group["shard"].iloc[0]],
            "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()],
            "order": [order.astype(np.int64).tobytes()], "leaves": [np.array(leaves, np.int64).tobytes()],
            "sides": [np.array(flat, np.float64).reshape(-1, 4).tobytes()],
        })

    def block(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["embedding"].to_list()).astype(kind)
        return pd.DataFrame({
            "dim": [x.shape[1]], "block": [group["block"].iloc[0]],
            "query_ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "queries": [x.tobytes()],
        })

    def answer(key, trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, int), "vec_id": np.zeros(0, int), "score": np.zeros(0)})]
        for tree in trees.itertuples():
            flat = np.frombuffer(tree.sides, np.float64).reshape(-1, 4)
            leaves = np.frombuffer(tree.leaves, np.int64).reshape(-1, 2)
            sides = [[(int(v), lo, hi) for _, v, lo, hi in flat[flat[:, 0] == i]] for i in range(len(leaves))]
            x = np.frombuffer(tree.vectors, kind).reshape(-1, tree.dim)
            for part in asked.itertuples():
                out.append(search(
                    np.frombuffer(tree.ids, np.int64), x, (np.frombuffer(tree.order, np.int64), leaves, sides),
                    np.frombuffer(part.query_ids, np.int64),
                    np.frombuffer(part.queries, kind).reshape(-1, tree.dim), k, factor, top,
                ))
        return pd.concat(out)

    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    trees = (
        base.withColumn("shard", part(shards)).groupBy("dim", "shard")
        .applyInPandas(index, "dim int, shard int, ids binary, vectors binary, order binary, leaves binary, sides binary")
    )
    asked = (
        asked.withColumn("block", part(blocks)).groupBy("dim", "block")
        .applyInPandas(block, "dim int, block int, query_ids binary, queries binary")
    )
    pairs = landed(trees, "trees").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    key = ["dim", "shard", "block"]
    hits = pairs.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(
        answer, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
