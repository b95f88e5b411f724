import hashlib
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from opsframe.llm import fingerprints as fp


def spark_hash(*values, size="<q"):
    """Spark's xxhash64 of longs."""
    seed = 42
    for value in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<i" if isinstance(value, tuple) else size, value[0] if isinstance(value, tuple) else value), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def slots_by_hand(kmers, ell=2, slots=64):
    """For each slot the k-mers of the ``ell`` entries that follow its start in the circular order."""
    seen, entries = Counter(), []
    for place, kmer in enumerate(kmers):
        high = kmer & ~fp.PLACE_MASK
        if seen[high]:
            high = spark_hash(kmer >> fp.PLACE_BITS, (seen[high],)) & ~fp.PLACE_MASK
        seen[kmer & ~fp.PLACE_MASK] += 1
        entries.append((high | place, place))
    entries.sort()
    out = []
    for j in range(slots):
        start = -(1 << 63) + j * ((1 << 64) // slots)
        first = next((i for i, (h, _) in enumerate(entries) if h >= start), 0)
        places = sorted(entries[(first + o) % len(entries)][1] for o in range(min(ell, len(entries))))
        out.append(tuple(kmers[p] for p in places))
    return out


def test_slots_against_brute_force(spark):
    texts = ["a b c d e f g", "a b c a b c a b c a b c", "x", "x x x x x x x x x", "to be or not to be that is", "b a c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    rows = fp.with_sketch(df, "text", "sketch").withColumn("kmers", fp._kmers(F.col("text"), 3)).orderBy("n").collect()
    named = {}
    for row in rows:
        wanted = slots_by_hand(row.kmers)
        assert len(row.sketch) == len(wanted) == 64
        for mine, theirs in zip(row.sketch, wanted):
            assert named.setdefault(mine, theirs) == theirs
    assert len(set(named.values())) == len(named)


def test_likeness_follows_edits_and_order(spark):
    words = [f"word{i}" for i in range(400)]
    near = [*words[:200], "changed", *words[201:]]
    turned = [*words[200:], *words[:200]]
    backwards = sum((words[i : i + 3] for i in range(399, -1, -3)), [])
    df = spark.createDataFrame(
        [(" ".join(words), " ".join(other)) for other in (words, near, turned, backwards, ["z"] * 400)], "a string, b string"
    )
    df = fp.with_sketch(fp.with_sketch(df, "a", "x"), "b", "y")
    like = [r[0] for r in df.select(fp.likeness(F.col("x"), F.col("y"))).collect()]
    assert like[0] == 1.0 and like[1] > 0.9 and like[4] == 0.0
    assert like[1] > like[2] > like[3]


def test_edits_and_neighbours(odd, docs, none):
    for df in (odd, docs.union(docs.limit(3))):
        texts = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        wanted = Counter()
        for i, (doc_id, text) in enumerate(texts):
            quarter, following = len(text) // 4, texts[(i + 1) % len(texts)][1]
            edited = text[: len(text) - quarter] + following[:quarter]
            wanted[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
        rows = fp.edited_likeness(df).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == wanted
        by_text = {}
        for r in rows:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            by_text.setdefault(r.fingerprint, r)
    assert fp.edited_likeness(none).count() == 0


def test_equal_texts_and_empty_ones(odd):
    rows = {r.doc_id: r for r in fp.edited_likeness(odd).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1.0
    assert rows[3].fingerprint == rows[4].fingerprint == "" and rows[3].near_next == 1.0
    assert len(rows[6].fingerprint) == 64 * 8


def test_clashing_columns(odd):
    wide = odd.withColumns({c: F.lit("x") for c in ("fingerprint", "near_next", "_sketch", "_om_kmers", "_nx_part")})
    assert fp.edited_likeness(wide).exceptAll(fp.edited_likeness(odd)).count() == 0
