"""Compression classifier: which of two zstandard dictionaries, of good or of bad text, helps a text more.

A dictionary is built from labelled texts of each class. A text is cut into short pieces, since a
dictionary helps only until the text's own history serves better, and every piece is compressed with
either; the difference of the two sizes, summed over all pieces, over the text's length tells the
classes apart. A logistic curve fitted on labelled texts that the dictionaries have not seen turns it
into a score. The curve also sees how far the text compresses at all, since text that repeats itself
leaves no difference to see.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 3
#: Most bytes of a piece; below the usual length of a text, so that long texts are measured as short ones are.
PIECE = 1024
STRETCHES = 16


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a logistic curve; of a fixed size, whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, float]
    offset: float


def pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` in the fewest pieces of at most ``PIECE`` bytes, of nearly equal length."""
    n = -(-len(raw) // PIECE)
    return (raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n))


def features(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: (size with the bad dictionary - size with the good one) / UTF-8 bytes, and the log of
    the smaller size / UTF-8 bytes; both 0 for empty texts. Sizes are sums over all pieces."""
    coders = []
    for content in (bad, good):
        held = zstandard.ZstdCompressionDict(content) if content else None
        if held:
            held.precompute_compress(level=LEVEL)
        coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        if raw:
            with_bad = with_good = 0
            for piece in pieces(raw):
                with_bad += len(coders[0].compress(piece))
                with_good += len(coders[1].compress(piece))
            out[i] = (with_bad - with_good) / len(raw), math.log(min(with_bad, with_good) / len(raw))
    return out


def logistic_fit(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 60) -> tuple[tuple[float, ...], float]:
    """Weights and offset of a logistic curve by Newton's method; classes count by ``share``, that of ones."""
    middle, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    design = np.c_[(x - middle) / scale, np.ones(len(x))]
    count = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max(len(y) - y.sum(), 1)) * len(y)
    weights = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        hessian = (design * (count * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(len(weights))
        step = np.linalg.solve(hessian, design.T @ (count * (y - p)) - 1e-3 * weights)
        weights += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    plain = weights[:-1] / scale
    return tuple(map(float, plain)), float(weights[-1] - plain @ middle)


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or none where there is too little text to train one."""
    raw = [t.encode("utf-8", "replace") for t in texts if t]
    size = min(size, sum(map(len, raw)) // 4)
    try:
        return zstandard.train_dictionary(size, raw).as_bytes() if len(raw) >= 16 and size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def _stretches(longest: int) -> Column:
    """The text, or of a longer one ``longest`` characters in evenly spaced stretches."""
    each, chars = longest // STRETCHES, F.char_length("text")
    start = lambda i: (i * (chars - each) / (STRETCHES - 1)).cast("int") + 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring("text", start(i), each))
    return F.when(chars <= longest, F.col("text")).otherwise(F.array_join(spread, ""))


def train(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column | None = None,
    per_class: int = 4000,
    longest: int = 65_536,
    dictionary_bytes: int = 112_640,
) -> Model:
    """Fits on a bounded sample: the ``per_class`` labelled rows of each class with the smallest hash
    of their id.

    ``allowed`` is a condition on ``doc_id``. Every other row of a class's sample trains its
    dictionary, to which a text of over ``longest`` characters lends ``STRETCHES`` even stretches of
    that length together; the others train the curve, with their whole texts, whose features are
    taken where the texts are. Rows without id, label or text are not used. Without labelled
    text of both classes the score is the share of good labels (one half without any). In the curve
    the classes weigh as they do among all allowed labels.
    """
    ids = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if allowed is not None:
        ids = ids.filter(allowed)
    ids = ids.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("_h", F.xxhash64("doc_id"))
    ones, labelled = ids.agg(F.count(F.when(F.col("quality") == 1, 1)), F.count("quality")).first()
    share = (ones + 1) / (labelled + 2)
    chosen = [ids.filter(F.col("quality") == q).orderBy("_h", "doc_id").limit(per_class) for q in (0, 1)]
    # At most 2 x per_class rows of three numbers, so both the broadcasts and the answers are bounded.
    texts = docs.select("doc_id", "text").filter(F.char_length("text") > 0)
    found = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = found.select("doc_id", "quality", "_h").distinct().orderBy("_h", "doc_id").collect()
    of = {q: [r.doc_id for r in rows if r.quality == q] for q in (0, 1)}
    if not of[0] or not of[1]:
        return Model(b"", b"", (0.0, 0.0), math.log(share / (1 - share)))

    def sample(ids: list) -> DataFrame:
        """One text per id: the least."""
        listed = docs.sparkSession.createDataFrame([(i,) for i in ids], docs.select("doc_id").schema)
        return texts.join(F.broadcast(listed), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    taught = dict(sample(of[0][::2] + of[1][::2]).select("doc_id", _stretches(longest)).collect())
    good, bad = (_dictionary([taught[i] for i in of[q][::2]], dictionary_bytes) for q in (1, 0))
    if not good or not bad:
        good = bad = b""

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(features(batch.tolist(), good, bad)))

    held = {q: of[q][1::2] or of[q] for q in (0, 1)}
    told = dict(sample(held[0] + held[1]).select("doc_id", measured("text")).collect())
    x = np.array([told[i] for i in held[0] + held[1]])
    return Model(good, bad, *logistic_fit(x, np.repeat([0.0, 1.0], [len(held[0]), len(held[1])]), share))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better text) in place of any such column.

    Null and empty texts have features 0, as a text which neither dictionary helps nor zstandard
    shortens. Equal texts have equal scores. The score depends on the text alone.
    """

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = features(batch.fillna("").tolist(), model.good, model.bad)
            z = np.clip(x @ np.array(model.weights) + model.offset, -700, 700)
            yield pd.Series(1 / (1 + np.exp(-z)))

    return docs.withColumn("score", rate(F.col(text)))


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, fold(3) != 1)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold(3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
