"""Manifest against a tree built in one piece."""

import hashlib
import zlib

import pytest

from opsframe.llm import manifest


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, low=False):
    out = ""
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        if row[name] is None:
            out += "-"
            continue
        value = str(row[name])
        if low and name == "text":
            value = "".join(c.lower() if "A" <= c <= "Z" else c for c in value)
        out += f"{len(value.encode())}:{value}"
    return _h([out])


def _tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {}
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        levels[name] = _tree([_leaf(r) for r in trees[name]])
    top = _tree([levels[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            low = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            folded, siblings = _leaf(row, low), []
            for tree, j in ((levels[name], i), (top, k)):
                for level in tree[:-1]:
                    start = j // 8 * 8
                    run, at = level[start : start + 8], j - start
                    siblings += run[:at] + run[at + 1 :]
                    folded, j = _h(run[:at] + [folded] + run[at + 1 :]), j // 8
            root = top[-1][0]
            out.append((row["doc_id"], _leaf(row), levels[name][-1][0], root, _h(siblings), folded, folded == root))
    return out


def _same(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_table(docs):
    _same(manifest.proofs(docs), [r.asDict() for r in docs.collect()])


def test_odd_rows(odd):
    wide = odd.selectExpr("*", "1 AS tree", "2 AS idx", "'x' AS digest")
    _same(manifest.proofs(wide), [r.asDict() for r in odd.collect()])


def test_empty(none):
    assert manifest.proofs(none).collect() == []


@pytest.mark.parametrize("langs", [1, 600])
def test_several_blocks_and_many_languages(spark, langs):
    """More leaves than a block has, a tree of roots that is itself tall, and lone last nodes."""
    docs = spark.range(4 * 4096 + 1).selectExpr(
        "id * 3 AS doc_id", f"concat('Text ', id) AS text", f"concat('l', if(id % 3 = 0, 0, id % {langs})) AS lang",
        "'s' AS source", "id AS n_chars",
    )  # a third of all rows in one language
    _same(manifest.proofs(docs), [r.asDict() for r in docs.collect()])


def test_missing_is_minimal():
    assert manifest.missing(range(8), 8) == []
    assert manifest.missing([0], 9) == [(0, i) for i in range(1, 8)] + [(1, 1)]
    assert manifest.missing([0, 8], 9) == [(0, i) for i in range(1, 8)]
