"""Spelling variants: words one insertion, deletion or replacement apart, by a frequency-vector trie.

A word is the vector of its length and of how often each group of letters occurs in it. One edit
adds at most one to one group and takes at most one from another. A trie holds the words by
successive components of their vectors; a search goes down it with a budget of one surplus and one
deficit, and the words of the leaves that it reaches are compared letter by letter.

The trie is spread over the cluster: words that share its first levels are a *block*. Each block is
sent to the blocks that an edit can lead to, of two blocks one to the other, and there each of its
words goes down the rest of the trie. Blocks are cut by their number of letters, so that a block
fits in a task however many words share a path; the levels taken for blocks follow from the number
of words. What comes out is one row per word and block, so words with many neighbours don't meet.
"""

from __future__ import annotations

import itertools
import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import landed, text_or_empty

RUN = r"[A-Za-zÀ-ÿ]"
LETTERS, OCCURRENCES, LARGER = 7, 2, 10
#: A run loses a letter if this divides its hash.
LOSES = 31
#: Letter groups, dealt by code point.
GROUPS = 16
#: Letters in a block, and words expected on a path that is not cut.
BLOCK_LETTERS, PATH_WORDS = 32_768, 2_048
#: Pairs of a word and a node, or letters of compared words, held at once in a search.
HELD = 400_000


def spellings(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``, its occurrences; runs whose hash 31 divides have lost a letter."""
    lower = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    # A run that is too short can't become a word, and a longer run is matched as a whole.
    runs = F.regexp_extract_all(lower, F.lit(f"{RUN}{{{LETTERS},}}"), F.lit(0))
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    code = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("code") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("code") % LOSES == 0, cut).otherwise(F.col("run"))
    return (
        named.withColumn("code", code).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .filter((F.char_length("word") >= LETTERS) & (F.col("n") >= OCCURRENCES))
    )


def _group_letters(group: int) -> str:
    """The letters of a group, of those that a run can hold once A-Z are folded."""
    return "".join(map(chr, (c for c in (*range(97, 123), *range(0xC0, 0x100)) if c % GROUPS == group)))


def path(word, depth: int):
    """The first levels of a word's vector: its length and the counts of ``depth`` groups."""
    size = F.char_length(word)
    return F.array(size, *(size - F.char_length(F.translate(word, _group_letters(g), "")) for g in range(depth)))


def steps(depth: int) -> list[tuple[int, ...]]:
    """What one edit can add to a path: at most one surplus and one deficit, the length in keeping."""
    out = set()
    for up, down in itertools.product(range(-1, depth), repeat=2):  # -1: in a group beyond the path, or none
        change = [0] * depth
        if up >= 0:
            change[up] += 1
        if down >= 0:
            change[down] -= 1
        for length in (-1, 0, 1):
            # A length that grows has no deficit, one that shrinks no surplus.
            if (length == 1 and down < 0) or (length == -1 and up < 0) or length == 0:
                out.add((length, *change))
    return sorted(out)


def vectors(letters: np.ndarray) -> np.ndarray:
    """Counts per group for a matrix of code points, one word a row."""
    n = len(letters)
    place = (np.arange(n) * GROUPS)[:, None] + letters % GROUPS
    return np.bincount(place.ravel(), minlength=n * GROUPS).reshape(n, GROUPS)


class Trie:
    """Words by successive counts of letter groups; leaves are ranges of ``order``."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        rows = counts[self.order]
        node = np.zeros(len(rows), dtype=np.int64)
        self.levels = []
        for g in range(counts.shape[1]):
            key = (node << 32) + rows[:, g]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.levels.append(key[first])  # children of all nodes of a level, by node and count
            node = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(rows)]))
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        self.first, self.last = first, np.r_[first[1:], len(rows)]

    def search(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        """Yields (query, leaf) arrays; depth first, a stretch of queries at a time.

        ``surplus`` and ``deficit`` are what is left of each query's budget.
        """
        start = np.arange(len(counts))
        stack = [(0, start, np.zeros(len(start), dtype=np.int64), surplus, deficit)]
        while stack:
            level, query, node, up, down = stack.pop()
            if not len(query):
                continue
            if level == len(self.levels):
                yield query, node
                continue
            if len(query) > HELD:
                half = len(query) // 2
                stack += [(level, *(x[s] for x in (query, node, up, down))) for s in (slice(half, None), slice(half))]
                continue
            keys, want = self.levels[level], (node << 32) + counts[query, level]
            found = []
            for change, able in ((0, None), (1, up > 0), (-1, (down > 0) & (counts[query, level] > 0))):
                at = np.searchsorted(keys, want + change)
                hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == want + change)
                hit = hit if able is None else hit & able
                found.append((query[hit], at[hit], up[hit] - (change > 0), down[hit] - (change < 0)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found))))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b``, words of two lengths at most one apart, are one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    a, b = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    head, tail = a == b[:, :-1], a == b[:, 1:]
    lead = np.where(head.all(1), a.shape[1], head.argmin(1))
    rest = np.where(tail.all(1), a.shape[1], tail[:, ::-1].argmin(1))
    return lead + rest >= a.shape[1]


class _Words:
    """Words of one length, with their vectors and their ranks as forms."""

    def __init__(self, length: int, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        flat = np.frombuffer("".join(words).encode("utf-16-le"), "<u2")  # no letter lies beyond 16 bits
        self.letters = flat.reshape(len(words), length)
        self.counts = vectors(self.letters)
        self.by_rank = np.lexsort((np.array(words), -n))
        self.rank = np.empty(len(words), dtype=np.int64)
        self.rank[self.by_rank] = np.arange(len(words))


def _met(own: _Words, other: _Words, me: np.ndarray, you: np.ndarray):
    """Columns word, n_near, n, near: of each word of ``own`` met, its best partner."""
    near = np.bincount(me, minlength=len(own.words))
    best = np.full(len(own.words), len(other.words))
    np.minimum.at(best, me, other.rank[you])
    some = np.flatnonzero(near)
    mate = other.by_rank[best[some]]
    return [own.words[i] for i in some], near[some], other.n[mate], [other.words[i] for i in mate]


_MET = "word string, n_near long, near_n long, near string"


def _search(key, rows):
    """All pairs between a block and those sent to it (itself among them), folded per word."""
    home, part = key[0].as_py(), key[1].as_py()
    out = ([], [], [], [])
    rows = rows.combine_chunks()
    paths, parts, lists = rows.column("path").to_pylist(), rows.column("part").to_pylist(), rows.column("words")
    sent = [(path, number, lists[i].values) for i, (path, number) in enumerate(zip(paths, parts))]
    own = next((words for path, number, words in sent if path == home and number == part), None)
    if own is not None:
        depth = len(home) - 1
        here = _Words(home[0], *_columns([own]))
        trie = Trie(here.counts[:, depth:])
        for length in sorted({path[0] for path, _, _ in sent}):
            guests = [x for x in sent if x[0][0] == length]
            guest = _Words(length, *_columns([words for _, _, words in guests]))
            sizes = [len(words) for _, _, words in guests]
            change = np.array(home[1:]) - np.array([path[1:] for path, _, _ in guests])
            # What is left of the budget; a word that grows has no letter to lose, and the other way round.
            up = np.repeat((1 - np.clip(change, 0, None).sum(1)) * (home[0] >= length), sizes)
            down = np.repeat((1 - np.clip(-change, 0, None).sum(1)) * (home[0] <= length), sizes)
            itself = np.repeat([path == home and number == part for path, number, _ in guests], sizes)
            q, m = _pairs(guest, here, trie, depth, up, down)
            if not len(q):
                continue
            # The block's own words have met from both sides already.
            for columns in (_met(guest, here, q, m), _met(here, guest, m[~itself[q]], q[~itself[q]])):
                for held, more in zip(out, columns):
                    held.extend(more)
    return pa.table({
        "word": pa.array(out[0], pa.string()), "n_near": pa.array(out[1], pa.int64()),
        "near_n": pa.array(out[2], pa.int64()), "near": pa.array(out[3], pa.string()),
    })


def _columns(lists: list) -> tuple[list[str], np.ndarray]:
    words = [w for x in lists for w in x.field("word").to_pylist()]
    return words, np.concatenate([x.field("n").to_numpy(zero_copy_only=False) for x in lists])


def _pairs(guest: _Words, here: _Words, trie: Trie, depth: int, up: np.ndarray, down: np.ndarray):
    """(guest, here) of the words one edit apart."""
    pairs = [(np.zeros(0, dtype=np.int64),) * 2]
    for query, leaf in trie.search(guest.counts[:, depth:], up, down):
        size = trie.last[leaf] - trie.first[leaf]
        for lo, hi in _cuts(size, max(1, HELD // here.letters.shape[1])):
            reps = size[lo:hi]
            q = np.repeat(query[lo:hi], reps)
            offset = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            m = trie.order[np.repeat(trie.first[leaf[lo:hi]], reps) + offset]
            good = one_edit(guest.letters[q], here.letters[m])
            pairs.append((q[good], m[good]))
    return tuple(np.concatenate(x) for x in zip(*pairs))


def _cuts(sizes: np.ndarray, limit: int):
    """Consecutive ranges whose sizes add up to about ``limit``."""
    whole = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = whole[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(whole, before + limit, "right")))
        yield lo, hi
        lo = hi


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and the largest near word (``near``, ``near_n``; ties: the first in code
    points) of those ``words`` (word, n) that have any."""
    depth = min(GROUPS, max(1, math.ceil(math.log(max(words.count() / PATH_WORDS, 1), 4))))
    on = words.withColumn("path", path(F.col("word"), depth))
    sizes = landed(
        on.groupBy("path").agg(F.ceil(F.count(F.lit(1)) * F.col("path")[0] / BLOCK_LETTERS).alias("parts")), "paths"
    )
    part = F.pmod(F.xxhash64("word"), F.col("parts"))
    blocks = landed(
        on.join(sizes, "path").withColumn("part", part).groupBy("path", "part").agg(
            F.collect_list(F.struct("word", "n")).alias("words")
        ),
        "blocks",
    )
    changes = F.array(*(F.array(*map(F.lit, change)) for change in steps(depth)))
    reached = F.transform(changes, lambda change: F.zip_with("path", change, lambda a, b: a + b))
    # Of two paths the smaller goes to the larger; of parts of one path the lower number.
    there = F.filter(reached, lambda p: ~F.exists(p, lambda v: v < 0) & (p >= F.col("path")))
    sent = (
        blocks.withColumn("home", F.explode(there))
        .join(sizes.select(F.col("path").alias("home"), "parts"), "home")
        .withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .filter((F.col("home") != F.col("path")) | (F.col("to") >= F.col("part")))
    )
    met = sent.select("home", "to", "path", "part", "words").groupBy("home", "to").applyInArrow(_search, _MET)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return (
        met.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
        .select("word", "n_near", F.col("first.near").alias("near"), (-F.col("first.less")).alias("near_n"))
    )


def variants(docs: DataFrame) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): n, n_near, form, form_n and root.

    Null and empty texts have no words; a null id is hashed as an empty text. Repeated rows count
    again. Runs of any length and texts of any length are taken whole. Of near words with equally
    many occurrences the first in code-point order is the form. An empty table has no words. Other
    columns are not read.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    words = landed(spellings(texts), "words")
    near = near_words(words)
    likely = F.col("near_n") >= LARGER * F.col("n")
    known = landed(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(likely, F.col("near")).alias("form"), F.when(likely, F.col("near_n")).alias("form_n"),
        ),
        "near",
    )
    # Each form has ten times as many occurrences, so chains are short; each step doubles what is known of them.
    most = known.agg(F.max("n")).first()[0] or 1
    links = max(1, int(math.log(most, LARGER)))
    ways = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links))):
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = landed(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "ways")
    return known.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
