import zlib

import numpy as np
from pyspark.sql import functions as F

from opsframe.llm import quality


def test_held_out_accuracy(spark, docs, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert sum(x >= 0.5 for x in good) > 0.98 * len(good)
    assert sum(x < 0.5 for x in bad) > 0.85 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    # Calibrated: the mean score is near the share of good texts.
    assert abs(np.mean(good + bad) - len(good) / len(rows)) < 0.03


def test_only_allowed_labels_and_the_text_count(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda d, l: {r.doc_id: r.score for r in quality.quality_scores(d, l).collect()}
    one = score(docs, labels)
    assert one == score(docs, turned)
    assert one == score(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "score": F.lit(3)}), labels)


def test_odd_tables(spark, odd, none, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert quality.quality_scores(none, labels).count() == 0
    for few in (labels.limit(0), labels.filter("quality = 1"), labels, labels.withColumn("quality", F.lit(None).cast("int"))):
        rows = quality.quality_scores(odd, few).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        by_text = {r.doc_id: r.score for r in rows}
        assert by_text[1] == by_text[2] and by_text[3] == by_text[4]


def test_curve_against_gradient_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x @ [2.0, -1.0] + rng.normal(size=400) > 0).astype(float)
    weights, offset = quality.logistic_fit(x, y, y.mean())
    w, b = np.zeros(2), 0.0
    for _ in range(8000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w - 0.5 * (x.T @ (p - y)) / 400, b - 0.5 * (p - y).mean()
    assert np.allclose(weights, w, atol=0.05) and abs(offset - b) < 0.05


def test_long_texts_are_scored_as_what_they_hold(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels, quality.fold(3) != 1)
    held = docs.join(labels, "doc_id").filter(quality.fold(3) == 1).orderBy("doc_id").collect()
    fresh = lambda t: len(zlib.compress(t.encode())) > 0.3 * len(t.encode())
    rows = []
    for q in (0, 1):
        whole = " ".join(r.text for r in held if r.quality == q and fresh(r.text))
        whole = " ".join([whole] * (2_000_000 // len(whole) + 1))
        rows += [(q, n, whole[:n]) for n in (2_000, 100_000, 450_000, 2_000_000)]
    for r in quality.score(spark.createDataFrame(rows, "quality int, n int, text string"), model).collect():
        assert abs(r.score - r.quality) < 0.1, (r.quality, r.n, r.score)


def test_every_byte_is_in_one_piece():
    for n in (1, 1023, 1024, 1025, 5000, 100_001):
        raw = bytes(i % 251 for i in range(n))
        cut = list(quality.pieces(raw))
        assert b"".join(cut) == raw and max(map(len, cut)) <= quality.PIECE and min(map(len, cut)) > 0


def test_long_labelled_texts_train(spark, sf_dir):
    some = sf_dir.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{some}/{n}.parquet") for n in ("documents", "labels"))
    longer = docs.filter(F.char_length("text") > 600)
    model = quality.train(longer, labels, longest=512)
    assert model.good and model.bad and model.weights[0] > 0
