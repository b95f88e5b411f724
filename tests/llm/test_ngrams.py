import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import ngrams, queries


def words_of(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), None]


def code(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def base_by_hand(rows):
    trained = [words_of(t) for i, t in rows if code(i) % 7 != 2]
    count = Counter(w for ws in trained for w in ws)
    total, types = sum(count.values()), len(count)
    out = Counter()
    for i, text in rows:
        ws = words_of(text)
        base = sum(math.log10((count[w] + 1) / (total + types + 1)) for w in ws)
        out[i, code(i) % 7 == 2, len(ws), sum(count[w] > 0 for w in ws), total, round(base, 6)] += 1
    return out


def model_by_hand(rows, order):
    """Scores with weights from EM on every single deleted token."""
    def counts(docs):
        grams = [Counter() for _ in range(order + 1)]
        context = [Counter() for _ in range(order + 1)]
        for ws in docs:
            padded = ["<s>"] * (order - 1) + ws
            for i in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    gram = tuple(padded[i - k + 1 : i + 1])
                    grams[k][gram] += 1
                    context[k][gram[:-1]] += 1
        return grams, context

    def estimates(ws, grams, context):
        padded = ["<s>"] * (order - 1) + ws
        for i in range(order - 1, len(padded)):
            row = []
            for k in range(1, order + 1):
                gram = tuple(padded[i - k + 1 : i + 1])
                c = context[k][gram[:-1]]
                row.append((int(math.log2(c + 1)) if k > 1 else 0, grams[k][gram] / c if c else 0.0, c))
            yield row

    train = [(i, words_of(t)) for i, t in rows if code(i) % 7 != 2]
    gone = [ws for i, ws in train if code(i) // 7 % ngrams.DELETED == 0]
    whole = counts([ws for _, ws in train])
    floor = 1 / (len(whole[0][1]) + 1)
    cells = Counter()
    kept = counts([ws for i, ws in train if code(i) // 7 % ngrams.DELETED])
    for ws in gone:
        for row in estimates(ws, *kept):
            cells[tuple(b for b, _, _ in row), tuple(math.log2(p) if p else -math.inf for _, p, _ in row)] += 1
    weights = ngrams.learn_weights([(b, n, s) for (b, s), n in sorted(cells.items())], order, floor)
    out = []
    for i, text in rows:
        score = 0.0
        for row in estimates(words_of(text), *whole):
            chance = floor
            for k, (b, p, c) in enumerate(row):
                lam = weights[k][b] if c else 0.0
                chance = lam * p + (1 - lam) * chance
            score += math.log10(chance)
        out.append((i, score))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_against_a_plain_model(docs, monkeypatch, order):
    monkeypatch.setattr(ngrams, "BUCKET_CHARS", 100_000)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    rows = ngrams.score_documents(docs, order).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == base_by_hand(given)
    scores = {r.doc_id: r.score for r in rows}
    for doc_id, score in model_by_hand(given, order):
        assert abs(scores[doc_id] - score) < 2e-3 * abs(score)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_tables(spark, odd, none, tmp_path):
    rows = ngrams.score_documents(odd).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == base_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert ngrams.score_documents(none).count() == 0
    apart = odd.withColumn("doc_id", F.lit(next(i for i in range(100) if code(i) % 7 == 2)).cast("long"))
    assert {r.train_tokens for r in ngrams.score_documents(apart).collect()} == {0}
    assert ngrams.score_documents(odd.withColumns({"chunk": F.lit(1), "score": F.lit(2)})).count() == odd.count()


def test_copies_in_several_partitions_each_count(spark, tmp_path):
    one = [(7 * i, "a b c a b") for i in range(40)]
    for n in range(3):
        spark.createDataFrame(one, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rows = ngrams.score_documents(df).collect()
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == base_by_hand(one * 3)


def test_packing_and_em():
    values = np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)
    assert (ngrams._unpack(ngrams._pack(values), np.uint64) == values).all()
    assert len(ngrams._unpack(ngrams._pack(values[:0]), np.uint64)) == 0
    # A level that is always right gets nearly all weight, one that never knows nothing.
    right = ngrams.learn_weights([((0, 3), 1000.0, (-10.0, 0.0))], 2, 1e-4)
    wrong = ngrams.learn_weights([((0, 3), 1000.0, (-2.0, -math.inf))], 2, 1e-4)
    assert right[1][3] > 0.99 and wrong[1][3] < 0.01 and wrong[0][0] > 0.99


def test_query_scores_with_two_words_of_context(spark, sf_dir, docs):
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(queries.BUILDS["op2_deleted_interpolation"](spark, sf_dir)) == rows(ngrams.score_documents(docs, order=3))


def test_large_ids_beside_null(spark):
    ids = [9007199254740993, 9007199254740995, None, -9007199254740993]
    docs = spark.createDataFrame([(i, f"some text of row {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    rows = ngrams.score_documents(docs, order=3).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(i for i in ids if i is not None)
    assert {r.doc_id: r.held_out for r in rows} == {i: ngrams.fold(i) == ngrams.APART for i in ids}
