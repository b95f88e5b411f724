"""Members of a large bucket meet only where they differ alike from its pivot; classes stay those of all pairs."""

import random

from opsframe.llm import bagminhash as bm
from test_bagminhash import check


def test_copies_changed_in_different_places_meet_few_others(spark, monkeypatch):
    draw, met = random.Random(3), []
    base = [f"w{i}" for i in range(150)]
    texts = []
    for n in range(160):
        text = list(base)
        for at in draw.sample(range(150), draw.randrange(2, 6)):
            text[at] = f"x{n}-{at}"
        texts.append((n, " ".join(text)))
    verified = bm._verified
    monkeypatch.setattr(bm, "_verified", lambda whole, sketch, pairs, s: met.append(pairs.count()) or verified(whole, sketch, pairs, s))
    check(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sum(met[1:]) < 10 * len(texts), met  # after the first centres, which are linear in the buckets
