"""Spelling variants against a search over all deletions of one letter."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from opsframe.llm import variants


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if code % 31 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}
    alike, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            alike[w[:i], w[i + 1 :]].add(w)
    for group in alike.values():
        for a in group:
            near[a] |= group - {a}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_table(docs):
    assert _rows(variants.variants(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd):
    wide = odd.selectExpr("*", "1 AS word", "2 AS n", "3 AS path")
    assert _rows(variants.variants(wide)) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_empty(none):
    assert variants.variants(none).collect() == []


def test_chains_ties_and_long_words(spark):
    long = "ab" * 5_000
    words = {
        "chained": 2, "chainex": 20, "chaixex": 200, "chaxxex": 2000, "tiedaaa": 20, "tiedaab": 20, "tiedaac": 2,
        "élégance": 30, "elégance": 3, "ÉLÉGANCE": 3, long + "c": 2, long + "cc": 20, "b" + long: 2, "aaaaaaaa": 3,
        "aaaaaaa": 30, "aaaaaaab": 3, "abababab": 3, "babababa": 3,
    }
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(variants.variants(docs)) == brute(rows)


def test_words_on_one_path_are_cut(spark):
    """Over a thousand words of one length and equal letters: several parts of one block."""
    rng = np.random.default_rng(5)
    words = {"".join(rng.permutation(list("abcdefghijklmnoqrstuvwxyz" * 2))) for _ in range(3_000)}
    rows = [(i, f"{w} {w} {w[:9]}z{w[10:]} {w[:9]}z{w[10:]}") for i, w in enumerate(sorted(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(variants.variants(docs)) == brute(rows)


def test_steps_are_single_edits():
    assert (0, 0, 0) in variants.steps(2) and (1, 1, 0) in variants.steps(2) and (0, 1, -1) in variants.steps(2)
    assert (1, 0, -1) not in variants.steps(2) and (-1, 1, 0) not in variants.steps(2) and (0, 1, 1) not in variants.steps(2)
