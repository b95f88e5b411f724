"""Buckets that have no further centre leave the rounds; classes stay those of all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from opsframe.llm import bagminhash as bm


def test_finished_buckets_are_not_labelled_again(spark, monkeypatch):
    draw, calls = random.Random(5), []
    base = [f"w{i}" for i in range(300)]
    texts = []
    for n in range(12):
        text = list(base)
        for at in draw.sample(range(300), 6):
            text[at] = f"x{n}-{at}"
        texts.append((n, " ".join(text)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    relabelled = bm._relabelled
    monkeypatch.setattr(bm, "_relabelled", lambda inside, edges: calls.append(inside.count()) or relabelled(inside, edges))
    got = {r.doc_id: r.class_id for r in bm.near_duplicates(docs).collect()}
    assert len(calls) == 1 and calls[0] > 0
    bags = {r.doc_id: bm.bag(np.array(r.words)) for r in docs.select("doc_id", bm.words(F.col("text")).alias("words")).collect()}
    want = {n: n for n in bags}
    for a in bags:
        for b in range(a):
            if bm.overlap(bags[a], bags[b]) >= bm.SIMILARITY and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {n: low if c == high else c for n, c in want.items()}
    assert got == want
