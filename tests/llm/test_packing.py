import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from opsframe.llm import packing


def pieces_by_hand(rows, capacity):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    out = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            out[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def check(df, capacity=packing.CAPACITY):
    rows = packing.pack(df, capacity=capacity).collect()
    given = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_by_hand(given, capacity)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r.length for r in rows)


def best_fit_by_hand(sizes, capacity):
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(capacity - size)
    return len(gaps)


def test_whole_tables(docs, odd, none):
    used, tokens = check(docs)
    assert used <= -(-tokens // packing.CAPACITY) + 3
    check(odd)
    assert packing.pack(none).count() == 0


def test_texts_that_the_word_cache_could_get_wrong(spark):
    texts = ["a b c", "x.,y. z., it's don't. we'LL", "ÅB é.", "<|endoftext|> <|ENDOFTEXT|>", "ΑΣ ΣΑΣ. İstanbul",
             "\x1c\x1d a\x0bb", "日本語 テキスト。 12.5 3-4- -", ". , -", "ß SS ﬁ ①"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


@pytest.mark.parametrize("sizes,capacity", [
    ([7, 5, 5, 4, 3, 3, 2, 1], 10), ([10] * 5, 10), ([6] * 9, 10), ([1] * 37, 10), ([], 10), ([9, 1, 9, 1, 5], 10),
    (list(range(1, 100)) * 3, 100), ([34] * 50 + [33] * 50 + [1] * 200, 100),
])
def test_matching(spark, sizes, capacity):
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "item long, size long")
    rows = packing.best_fit(items, capacity).collect()
    assert sorted(r.item for r in rows) == list(range(len(sizes)))
    held = defaultdict(list)
    for r in rows:
        held[r.seq].append((r.offset, sizes[r.item]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    assert len(held) <= best_fit_by_hand(sizes, capacity) + 1 + len(sizes) // 100


def test_one_sweep_is_the_sequential_best_fit(spark):
    """Going up, each gap takes the largest smaller document that is left."""
    import random

    rng = random.Random(3)
    items = {i: rng.randint(1, 20) for i in range(60)}
    gaps = {i: rng.randint(0, 20) for i in range(40)}
    stack, wanted = [], []
    for size, kind in sorted([(s, 0) for s in items.values()] + [(g, 1) for g in gaps.values() if g]):
        if kind == 0:
            stack.append(size)
        elif stack:
            wanted.append((stack.pop(), size))
    state = spark.createDataFrame(
        [(i, s, None, None, None) for i, s in items.items()] + [(None, None, i, None, g) for i, g in gaps.items()],
        "item long, size long, seq long, gap_before long, gap long",
    )
    rows = packing._sweep(state).collect()
    assert sorted((r["size"], r.gap_before) for r in rows if r.gap_before is not None) == sorted(wanted)
    assert sorted(r.item for r in rows if r.item is not None) == sorted(items)
    assert len({r.seq for r in rows if r.gap_before is not None}) == len(wanted)


def test_sequences_hold_the_ids(docs):
    packed = packing.pack(docs, with_ids=True)
    lengths = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n").collect()}
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == lengths[r.sequence_id]


def test_large_ids_beside_null(spark):
    ids = [9007199254740993, 9007199254740995, None]
    docs = spark.createDataFrame([(i, "text") for i in ids], "doc_id long, text string")
    assert {r.doc_id for r in packing.tokenise(docs).collect()} == set(ids)
