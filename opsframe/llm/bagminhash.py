"""Near-duplicates by weighted Jaccard similarity: BagMinHash signatures, banding, exact check.

A document is a bag of five-word shingles with their counts. Each shingle drives Poisson processes
over the levels 0, 1, 2, ... of its count; the levels are grouped by powers of two, so that a count c
needs about log2(c) processes, and a point is kept if its level lies below the count. Every point
falls on a random slot, and a slot keeps its earliest point. Two bags agree in a slot with the
probability sum(min) / sum(max) of their counts. Processes stop at the latest slot of their document,
so a document costs about as many points as it has shingles, plus slots x ln(slots).

Bands of slots bring candidates together. In each bucket the members are compared with one centre
first, so a group of n copies costs n comparisons. Where that leaves several classes in a small bucket,
the members with the fewest shingles of their own are tried with the others; then all become centres,
until no pair of different classes is untested that its shingle counts don't rule out: a pair shares no
shingle that only one text has, and centres meet only the size classes that they can reach. The
members of a large bucket are compared by how they differ from one in its middle, the pivot: texts that
differ from it in different places are ruled out without meeting (see ``_around_pivots``).
Candidates that the signatures do not rule out are decided on the whole bags.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.llm.common import landed

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
SLOTS = BANDS * ROWS
#: Signatures with fewer equal slots than this share cannot belong to a pair of the wanted
#: similarity, but for a chance of 3 in 100,000 (four standard deviations).
MARGIN = 4
#: Partners from the largest class of a bucket, the first of them its pivot, that its other members are
#: tried with first.
PARTNERS = 4
#: Members of a bucket up to which all that can be a centre are; larger ones are compared around a pivot.
CENTRES = 16
#: Growth of the shingle count from one size class of a bucket to the next.
SIZE_STEP = 1.02
#: Kept clear of rounding in the bounds on shingle counts.
SLACK = 1e-6
#: Shingles handled at once in a Python worker.
CHUNK = 100_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: Column) -> Column:
    """Hashes of the lower-cased words between white space; null for a null text."""
    parts = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """One number per run of five words; a shorter text is one shingle, a text without words none."""
    hashes = hashes.view(np.uint64)
    n = max(len(hashes) - WORDS + 1, min(len(hashes), 1))
    out = np.full(n, len(hashes) if len(hashes) < WORDS else WORDS, dtype=np.uint64)
    for i in range(min(WORDS, len(hashes))):
        out = mix(out * _GOLD + hashes[i : i + n])
    return out


def bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(hashes), return_counts=True)


def overlap(a, b) -> float:
    """Exact weighted Jaccard similarity of two bags; 0 if either is empty."""
    (ka, ca), (kb, cb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    low = int(np.minimum(ca[ia], cb[ib]).sum())
    return low / (int(ca.sum()) + int(cb.sum()) - low)


def signatures(owner: np.ndarray, keys: np.ndarray, counts: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Times of the earliest point in each slot, for ``n`` bags given as (owner, key, count)."""
    first = np.full(n * slots, np.inf)
    latest = np.full(n, np.inf)
    # One process per power of two that the count reaches: levels 0, 1, 2-3, 4-7, ...
    blocks = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(keys)), blocks)
    block = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    seed = mix(keys[at] * _GOLD + block.astype(np.uint64))
    width = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0))
    low = np.where(block == 0, 0, width)
    own, count, now = owner[at], counts[at], np.zeros(len(at))
    step = 0
    while len(own):
        for _ in range(int(np.clip(200_000 // len(own), 1, 16))):
            step += 1
            draw = mix(seed + np.array([2 * step], dtype=np.uint64) * _GOLD)
            now = now - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width
            draw = mix(draw + np.uint64(step))
            level = low + (((draw >> np.uint64(32)).astype(np.int64) * width) >> 32)
            slot = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)
            kept = (level < count) & (now < latest[own])
            np.minimum.at(first, own[kept] * slots + slot[kept].astype(np.int64), now[kept])
        latest = first.reshape(n, slots).max(1)
        going = now < latest[own]
        own, seed, width, low, count, now = (x[going] for x in (own, seed, width, low, count, now))
    return first.reshape(n, slots)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, words) -> (row, bands, slots as 16-bit numbers); no bands for texts without words."""
    for batch in batches:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        cuts, held = [0], 0
        for i in range(len(lists)):
            held += ends[i + 1] - ends[i]
            if held >= CHUNK:
                cuts.append(i + 1)
                held = 0
        if cuts[-1] != len(lists):
            cuts.append(len(lists))
        for lo, hi in zip(cuts, cuts[1:]):
            bags = [bag(values[ends[i] : ends[i + 1]]) for i in range(lo, hi)]
            sizes = [len(k) for k, _ in bags]
            times = signatures(
                np.repeat(np.arange(hi - lo), sizes),
                np.concatenate([k for k, _ in bags]),
                np.concatenate([c for _, c in bags]),
                hi - lo,
            ) if sum(sizes) else np.full((hi - lo, SLOTS), np.inf)
            points = mix(times.view(np.uint64))
            band = np.zeros((hi - lo, BANDS), dtype=np.uint64)
            for r in range(ROWS):
                band = mix(band * _GOLD + points[:, r::ROWS])
            band = mix(band + np.arange(BANDS, dtype=np.uint64) * _GOLD).view(np.int64)
            some = np.array(sizes) > 0
            slots = (points & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([band[i] if some[i] else band[i, :0] for i in range(hi - lo)], pa.list_(pa.int64())),
                    pa.array([slots[i].tobytes() for i in range(hi - lo)], pa.binary()),
                ],
                names=["row", "bands", "slots"],
            )


@F.pandas_udf(T.IntegerType())
def _equal_slots(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="int32")
    left, right = (np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1) for x in (a, b))
    return pd.Series((left == right).sum(1).astype("int32"))


@F.pandas_udf(T.DoubleType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    out, seen, last = [], b"", None
    for x, y in zip(a, b):  # sorted by the second text, so its bag often serves again
        y = np.asarray(y)
        if y.tobytes() != seen:
            seen, last = y.tobytes(), bag(y)
        out.append(overlap(bag(np.asarray(x)), last))
    return pd.Series(out, dtype="float64")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node of its component) for all ends of ``edges`` (a, b).

    Smallest labels spread along the links and are followed one step further in each round, so the
    rounds grow with the logarithm of the longest way.
    """
    links = landed(edges.selectExpr("inline(array(struct(a as node, b as to), struct(b as node, a as to)))").distinct(), "links")
    labels = landed(links.groupBy("node").agg(F.least("node", F.min("to")).alias("label")), "labels")
    while True:
        far = labels.select(F.col("node").alias("to"), F.col("label").alias("near"))
        least = links.join(far, "to").groupBy("node").agg(F.min("near").alias("near"))
        moved = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        labels = landed(
            moved.join(far, "to").select("node", "old", F.least("to", "near").alias("label")), "labels"
        )
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.drop("old")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``row`` (a number for each row) and ``class_id`` (the smallest doc_id of the class).

    Rows are in one class if a chain of pairs of the wanted similarity links them. Equal texts (case
    and white space aside) always are; so are all texts without words. A null text is a class of its
    own. Texts of fewer than five words are one shingle. Repeated rows stay rows; an empty table gives
    none. A null doc_id is kept and counts as larger than any other. Other columns are not read.
    """
    hashed = docs.select("doc_id", words(F.col("text")).alias("words"))
    keyed = hashed.select(
        F.struct(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.xxhash64("words").alias("k1"),
            F.xxhash64(F.lit(1), "words").alias("k2"),
            F.col("words").isNull().alias("none"),
        ).alias("row"),
        F.coalesce("words", F.array().cast("array<long>")).alias("words"),
    )
    schema = T.StructType([keyed.schema["row"], T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("slots", T.BinaryType())])
    rows = landed(keyed.mapInArrow(_sketch, schema).select("row.*", "bands", "slots"), "sketches")
    texts = landed(
        rows.filter("NOT none").groupBy("k1", "k2")
        .agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")),
        "texts",
    )
    sketch = landed(rows.join(texts.select("node"), F.col("row") == F.col("node"), "left_semi"), "singles")
    edges = _links(docs, sketch, similarity)
    labels = components(edges)
    classes = (
        texts.join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .select("k1", "k2", "label", "doc_id")
    )
    smallest = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(smallest, "label").select("k1", "k2", "class_id")
    named = rows.select("doc_id", "row", "k1", "k2", "none")
    shared = named.filter("NOT none").join(classes, ["k1", "k2"])
    alone = named.filter("none").withColumn("class_id", F.col("doc_id"))
    return shared.unionByName(alone).select("doc_id", "row", "class_id")


def _links(docs: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join all pairs of the wanted similarity, but not one per pair."""
    buckets = sketch.select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = landed(buckets.join(shared.select("bucket", "centre"), "bucket"), "buckets")
    # The texts in question, fetched once; always by exchange, as they grow with the input.
    wanted = sketch.join(members.select(F.col("node").alias("row")).distinct(), "row", "left_semi")
    whole = landed(
        docs.select("doc_id", "text")
        .join(wanted.select("row", F.col("doc_id").alias("id"), "k1").hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")))
        .filter(F.xxhash64(words(F.col("text"))) == F.col("k1"))  # an id may stand for several texts
        .dropDuplicates(["row"]).select("row", "text"),
        "members",
    )
    edges = _verified(
        whole, sketch, members.filter("node <> centre").selectExpr("node as a", "centre as b").distinct(), similarity
    )
    used = landed(members.filter("node = centre").select("bucket", "node"), "centres")
    labelled = members.select("bucket", "node").join(components(edges), "node", "left")
    inside = _open(labelled.withColumn("label", F.coalesce("label", "node")))
    nodes = inside.select(F.col("node").alias("row")).distinct()
    whole = landed(whole.join(nodes, "row", "left_semi"), "members")
    sketch = landed(sketch.join(nodes, "row", "left_semi").select("row", "slots"), "singles")
    inside = landed(inside.join(_profiles(whole), "node"), "profiled")
    inside = landed(inside.join(_untried(inside, used, similarity).select("bucket").distinct(), "bucket", "left_semi"), "open")

    # A member of the largest class with few shingles of its own lies in the middle of it: in a large
    # bucket all are compared by how they differ from it.
    rank = lambda i: F.struct(F.col("own") / F.col("n"), F.xxhash64(F.lit(i), "node"))
    chosen = landed(
        inside.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), *[
            F.min_by(F.when(F.col("label") == F.col("largest"), F.col("node")), F.when(F.col("label") == F.col("largest"), rank(i)))
            .alias(f"p{i}") for i in range(PARTNERS)
        ]),
        "partners",
    )
    large = chosen.filter(F.col("members") > CENTRES)
    if not large.isEmpty():
        able = inside.filter(_least(similarity) <= _most(similarity))
        groups = able.join(large.select("bucket", F.col("p0").alias("pivot")), "bucket").select("pivot", "node", "label").distinct()
        found = _around_pivots(whole, sketch, landed(groups, "groups"), similarity)
        edges = edges.unionByName(found)
        small = chosen.filter(F.col("members") <= CENTRES).select("bucket")
        inside = landed(_open(_relabelled(inside.drop("largest"), found).join(small, "bucket", "left_semi")), "open")

    # In the others the members in the middle link most of the rest; these then need no comparison with all.
    partners = F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PARTNERS)))))
    waiting = inside.filter("label <> largest").join(used, ["bucket", "node"], "left_anti")
    tried = _verified(
        whole, sketch,
        waiting.join(chosen.select("bucket", partners.alias("centre")), "bucket").filter("node <> centre")
        .select(*_pair("node", "centre")).distinct(),
        similarity,
    )
    edges = edges.unionByName(tried)
    inside = landed(_open(_relabelled(inside.drop("largest"), tried)), "open")
    sizes = F.explode(F.sequence(_size_class(_least(similarity)), _size_class(_most(similarity))))
    asked = _untried(inside, used, similarity).select(
        "bucket", F.col("node").alias("centre"), F.col("label").alias("its"), F.col("n").alias("its_n"),
        F.col("own").alias("its_own"), sizes.alias("size"),
    )
    common = F.least(F.col("n") - F.col("own"), F.col("its_n") - F.col("its_own"))
    pairs = (
        inside.withColumn("size", _size_class(F.col("n")))
        .join(asked, ["bucket", "size"])
        .filter("label <> its")
        .filter(common * (1 + similarity) >= (F.col("n") + F.col("its_n")) * similarity - SLACK)
        .select(*_pair("node", "centre"))
        .distinct()
    )
    return edges.unionByName(_verified(whole, sketch, pairs, similarity))


def _pair(one: str, other: str) -> list[Column]:
    return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]


def _differences(similarity: float):
    """(pivot, node, label, words, words of the pivot) -> (pivot, node, label, near, excess, keys, by)."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, base = None, None
        for batch in batches:
            pivots = batch.column(0).to_pylist()
            near, excess, keys, by, start = [], [], [], [], 0
            for at in range(batch.num_rows):
                if pivots[at] != seen:  # sorted by it
                    seen, base = pivots[at], bag(batch.column(4)[at].values.to_numpy(zero_copy_only=False))
                mine = bag(batch.column(3)[at].values.to_numpy(zero_copy_only=False))
                both, index = np.unique(np.concatenate([mine[0], base[0]]), return_inverse=True)
                more = np.bincount(index, np.concatenate([mine[1], -base[1]]), len(both)).astype(np.int64)
                near.append(overlap(mine, base) >= similarity)
                excess.append(float(np.abs(more).sum() - share * mine[1].sum()))
                keys.append(both[more != 0].view(np.int64))
                by.append(more[more != 0])
                if at + 1 == batch.num_rows or sum(map(len, keys)) >= CHUNK:
                    ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(i).slice(start, len(keys)) for i in range(3)),
                            pa.array(near, pa.bool_()), pa.array(excess, pa.float64()),
                            pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys), pa.int64())),
                            pa.ListArray.from_arrays(ends, pa.array(np.concatenate(by), pa.int64())),
                        ],
                        names=["pivot", "node", "label", "near", "excess", "keys", "by"],
                    )
                    near, excess, keys, by, start = [], [], [], [], at + 1

    return run


def _around_pivots(whole: DataFrame, sketch: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Edges that join all pairs of the wanted similarity within the groups (pivot, node, label).

    Let d be the shingles by which two bags differ, and r = (1 - s) / (1 + s): a pair has the similarity
    s if d(A, B) <= r (|A| + |B|). With D, the difference of a bag from the pivot, and its excess
    e = |D| - r |A|, that is the same as 2 |D(A) & D(B)| >= e(A) + e(B). Members near the pivot are
    one class with it; if one of A and B is not, the right side is above 0, so both have to differ from
    the pivot alike somewhere. The rarest difference that they share is one that all they share follows:
    a list of members for each difference gives the pairs that have enough after it.
    """
    words_of = lambda name: whole.select(F.col("row").alias(name), words(F.col("text")).alias(f"{name}_words"))
    rows = landed(
        groups.join(words_of("node"), "node").join(words_of("pivot"), "pivot")
        .select("pivot", "node", "label", "node_words", "pivot_words").sortWithinPartitions("pivot")
        .mapInArrow(
            _differences(similarity),
            "pivot long, node long, label long, near boolean, excess double, keys array<long>, by array<long>",
        ),
        "differences",
    )
    edges = landed(rows.filter("near AND node <> pivot").select(*_pair("node", "pivot")), "edges")
    # Where no member is far from the pivot, all are one class.
    least = rows.filter("node <> pivot").groupBy("pivot").agg(
        F.min("excess").alias("low"), F.min(F.when(~F.col("near"), F.col("excess"))).alias("low_far")
    ).filter("low_far IS NOT NULL")
    single = (
        rows.filter("node <> pivot").select("pivot", "node", "near", "excess", F.inline(F.arrays_zip("keys", "by")))
        .withColumns({"up": F.col("by") > 0, "by": F.abs("by")})
    )
    several = single.groupBy("pivot", "keys", "up").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    after = Window.partitionBy("pivot", "node").orderBy(F.desc("holders"), "keys", "up")
    listed = (
        single.join(several, ["pivot", "keys", "up"]).withColumn("rest", F.sum("by").over(after))
        .join(F.broadcast(least), "pivot")
        .withColumn("asks", ~F.col("near") & (2 * F.col("rest") >= F.col("excess") + F.col("low") - SLACK))
        .withColumn("answers", 2 * F.col("rest") >= F.col("excess") + F.col("low_far") - SLACK)
        .filter("asks OR answers")
    )
    listed = landed(listed.select("pivot", "keys", "up", "node", "excess", "rest", "asks", "answers"), "listed")
    side = lambda df, name: df.select(
        "pivot", "keys", "up", F.col("node").alias(name), F.col("excess").alias(f"{name}_excess"), F.col("rest").alias(f"{name}_rest")
    )
    enough = 2 * F.least("a_rest", "b_rest") >= F.col("a_excess") + F.col("b_excess") - SLACK
    asking, answering = side(listed.filter("asks"), "a"), side(listed.filter("answers"), "b")
    # First the member of each list that is least far from the pivot, which spares most pairs of one class.
    first = F.min_by(F.struct("b", "b_excess", "b_rest"), F.struct("b_excess", "b"))
    heads = answering.groupBy("pivot", "keys", "up").agg(first.alias("head")).select("pivot", "keys", "up", "head.*")
    met = asking.join(heads, ["pivot", "keys", "up"]).filter(enough & (F.col("a") != F.col("b")))
    found = _verified(whole, sketch, met.select(*_pair("a", "b")).distinct(), similarity)
    edges = edges.unionByName(found)
    labels = landed(_relabelled(groups.select("node", "label").distinct(), edges), "labels")
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    met = (
        asking.join(of("a"), "a").join(answering.join(of("b"), "b"), ["pivot", "keys", "up"])
        .filter(enough & (F.col("a_label") != F.col("b_label")))
    )
    return edges.unionByName(_verified(whole, sketch, met.select(*_pair("a", "b")).distinct(), similarity))


def _untried(inside: DataFrame, used: DataFrame, similarity: float) -> DataFrame:
    """The members outside the largest class of their bucket that were no centre of it and can have a partner."""
    outside = inside.filter("label <> largest").filter(_least(similarity) <= _most(similarity))
    return outside.join(used, ["bucket", "node"], "left_anti")


def _open(labelled: DataFrame) -> DataFrame:
    """The members (bucket, node, label) of buckets with several classes, with the ``largest`` class."""
    sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("members"))
    several = sizes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("members", "label")).alias("largest")
    ).filter("labels > 1")
    return labelled.join(several.select("bucket", "largest"), "bucket")


def _relabelled(inside: DataFrame, edges: DataFrame) -> DataFrame:
    """``inside`` with its classes joined along ``edges``; only classes that an edge touches are followed."""
    of = lambda node: inside.select(F.col("node").alias(node), F.col("label").alias(f"{node}_label")).distinct()
    between = landed(
        edges.join(of("a"), "a").join(of("b"), "b").filter("a_label <> b_label")
        .selectExpr("a_label as a", "b_label as b").distinct(),
        "between",
    )
    if between.isEmpty():
        return inside
    moved = components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return inside.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, words) -> (row, key, times) for each shingle of each text."""
    for batch in batches:
        for row, hashes in zip(batch.column(0), batch.column(1)):
            keys, times = bag(hashes.values.to_numpy(zero_copy_only=False))
            for at in range(0, len(keys), CHUNK):
                part = keys[at : at + CHUNK].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), row.as_py()), pa.int64()), pa.array(part), pa.array(times[at : at + CHUNK])],
                    names=["row", "key", "times"],
                )


def _profiles(whole: DataFrame) -> DataFrame:
    """``node``, ``n`` (its shingles, with repeats) and ``own``: those of them that no other of these texts has.

    A pair has at most the least of both ``n - own`` in common, which rules out most pairs of a group
    whose copies were changed in different places, without a comparison.
    """
    listed = whole.select("row", words(F.col("text")).alias("words"))
    number = F.size("words").cast("long")
    sizes = listed.select(F.col("row").alias("node"), F.greatest(number - WORDS + 1, F.least(number, F.lit(1))).alias("n"))
    alone = (
        listed.mapInArrow(_flat, "row long, key long, times long")
        .groupBy("key").agg(F.min("row").alias("node"), F.sum("times").alias("times"), F.count(F.lit(1)).alias("texts"))
        .filter("texts = 1").groupBy("node").agg(F.sum("times").alias("own"))
    )
    return sizes.join(alone, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))


def _least(similarity: float) -> Column:
    """Shingles that a text of the wanted similarity to this one has at least."""
    return F.ceil(F.col("n") * similarity - SLACK)


def _most(similarity: float) -> Column:
    """Shingles that it has at most, if it shares all that are not this one's own."""
    return F.floor((F.col("n") - F.col("own")) * (1 + 1 / similarity) - F.col("n") + SLACK)


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")


def _verified(whole: DataFrame, sketch: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least the wanted similarity, by signature first and then by whole bags."""
    side = lambda name: sketch.select(F.col("row").alias(name), F.col("slots").alias(f"{name}_slots"))
    least = SLOTS * similarity - MARGIN * (SLOTS * similarity * (1 - similarity)) ** 0.5
    likely = landed(
        pairs.join(side("a"), "a").join(side("b"), "b")
        .filter(_equal_slots("a_slots", "b_slots") >= least).select("a", "b"), "likely",
    )
    text = lambda name: whole.select(F.col("row").alias(name), F.col("text").alias(f"{name}_text"))
    near = likely.join(text("a"), "a").join(text("b"), "b").sortWithinPartitions("b")
    alike = _overlap(words(F.col("a_text")), words(F.col("b_text")))
    return landed(near.filter(alike >= similarity).select("a", "b"), "edges")
