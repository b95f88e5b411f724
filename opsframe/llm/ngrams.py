"""Deleted interpolation: n-gram estimates mixed by context-frequency buckets, weights from EM.

P_k(w | context) = l_k(b) c(context, w) / c(context) + (1 - l_k(b)) P_{k-1}(w | shorter context),
down to 1 / (V + 1); b is the bucket of c(context) by powers of two. A tenth of the training
documents is *deleted* from the counts, the weights are those that make the deleted documents
likeliest under the remaining counts, and the final counts take all training documents.

Counts go through one exchange of sorted, packed arrays: a task turns its documents into *chunks*,
asks each bucket of the n-gram hash range for the n-grams its chunks hold, with the chunk's own
counts, and gets the totals back in the same order. Each n-gram is sent once per chunk however often
it occurs, so frequent words make no skew. Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zlib
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import landed

ORDER = 2
#: Tokens in a chunk, and characters of all texts for each bucket of the hash range.
CHUNK_TOKENS, BUCKET_CHARS = 1_200_000, 8_000_000
#: One of so many training documents is deleted from the counts that the weights are learned on.
DELETED = 10
#: Steps per octave in which probabilities are told apart when weights are learned.
STEPS = 4
KEPT, GONE, APART = 0, 1, 2
END = b"\n"  # no word holds white space, so it can stand for the end of a document
_GOLD = np.uint64(0x9E3779B97F4A7C15)
CHANGED = "the input gave other rows when read again; write it to a table first"
_BEGIN = np.uint64(0x243F6A8885A308D3)


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z folded; bytes.lower and bytes.split know just these."""
    return text.encode("utf-8", "replace").lower().split()


def fold(doc_id) -> int:
    """Training, deleted from training, or not trained on, by the id alone."""
    code = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return APART if code % 7 == 2 else GONE if (code // 7) % DELETED == 0 else KEPT


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order, the hash of the k-gram that ends at each token; documents begin with a mark."""
    out = [words]
    for k in range(2, order + 1):
        before = np.empty_like(words)
        before[1:] = out[-1][:-1]
        before[starts] = _BEGIN + np.uint64(k)
        out.append(_mix(before * _GOLD + words + np.uint64(k)))
    return out


class Chunk:
    """Documents of one task, up to a number of tokens."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids: list[np.ndarray] = []
        self.docs: list = []
        self.folds: list[int] = []
        self.size = 0

    def add(self, doc_id, kind: int, text: str) -> None:
        found = [*tokens(text), END]
        self.ids.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        self.docs.append(doc_id)
        self.folds.append(kind)
        self.size += len(found)

    def close(self, order: int) -> None:
        self.lengths = np.array([len(x) for x in self.ids])
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in self.words], dtype=np.uint64)
        self.flat = np.concatenate(self.ids)
        self.grams = gram_hashes(hashed[self.flat], self.starts, order)
        self.hashed = hashed
        sign = xxhash.xxh64(self.flat.tobytes())
        sign.update(repr(self.docs).encode())
        self.sign = sign.hexdigest()


def _chunks(batches: Iterator[pd.DataFrame], order: int, only_gone: bool) -> Iterator[tuple[str, Chunk]]:
    """Chunks with their names; deleted documents have chunks of their own."""
    held: dict[bool, Chunk] = {}
    numbers = {True: itertools.count(), False: itertools.count()}
    context = TaskContext.get()
    task = context.partitionId() if context else 0

    def name(gone: bool, chunk: Chunk) -> tuple[str, Chunk]:
        chunk.close(order)
        return f"{task}-{gone:d}-{next(numbers[gone])}-{chunk.sign}", chunk

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
            kind = fold(doc_id)
            if only_gone and kind != GONE:
                continue
            chunk = held.setdefault(kind == GONE, Chunk())
            chunk.add(doc_id, kind, text)
            if chunk.size >= CHUNK_TOKENS:
                yield name(kind == GONE, held.pop(kind == GONE))
    for gone, chunk in held.items():
        yield name(gone, chunk)


def _place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _ask(order: int, buckets: int):
    """(doc_id, text) -> what each chunk asks of each bucket: its n-grams and its own counts."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, chunk in _chunks(batches, order, False):
            kinds = np.repeat(chunk.folds, chunk.lengths)
            for k, grams in enumerate(chunk.grams, 1):
                found, at = np.unique(grams, return_inverse=True)
                trained = np.bincount(at[kinds != APART], minlength=len(found)).astype(np.uint32)
                gone = np.bincount(at[kinds == GONE], minlength=len(found)).astype(np.uint32)
                cuts = np.searchsorted(_place(found, buckets), np.arange(buckets + 1))
                rows = [
                    (b, k, name, lo, _pack(np.diff(found[lo:hi], prepend=np.uint64(0))), _pack(trained[lo:hi]), _pack(gone[lo:hi]))
                    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi
                ]
                yield pd.DataFrame(rows, columns=["bucket", "k", "chunk", "first", "grams", "trained", "gone"])

    return ask


def _total(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: adds up the counts of all chunks and answers each in its own order."""
    out = []
    for k, rows in group.groupby("k"):
        lists = [np.cumsum(_unpack(g, np.uint64), dtype=np.uint64) for g in rows["grams"]]
        found, at = np.unique(np.concatenate(lists), return_inverse=True)
        counts = [
            np.bincount(at, np.concatenate([_unpack(x, np.uint32) for x in rows[name]]), len(found)).astype(np.uint64)
            for name in ("trained", "gone")
        ]
        trained, gone = counts
        kept = trained - gone
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        totals = (int((trained > 0).sum()), int(trained.sum()), int(gone.sum()), int((kept > 0).sum()))
        for i, (name, first, part) in enumerate(zip(rows["chunk"], rows["first"], np.split(at, cuts))):
            out.append((name, int(k), int(first), _pack(trained[part]), _pack(gone[part]), *(totals if i == 0 else (0,) * 4)))
    return pd.DataFrame(out, columns=["chunk", "k", "first", "trained", "gone", "types", "tokens", "gone_tokens", "kept_types"])


ANSWER = "chunk string, k int, first long, trained binary, gone binary, types long, tokens long, gone_tokens long, kept_types long"


def _carry(order: int, only_gone: bool):
    """(doc_id, text) -> one row per chunk, to be met by its answers."""

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, chunk in _chunks(batches, order, only_gone):
            ids = np.array([0 if d is None else d for d in chunk.docs], np.int64)
            none = np.array([d is None for d in chunk.docs], np.uint8)
            yield pd.DataFrame({
                "chunk": [name], "flat": [_pack(chunk.flat)], "hashed": [chunk.hashed.tobytes()],
                "lengths": [_pack(chunk.lengths.astype(np.int64))], "docs": [_pack(ids)], "none": [_pack(none)],
                "folds": [_pack(np.array(chunk.folds, np.uint8))],
            })

    return carry


CARRIED = "chunk string, flat binary, hashed binary, lengths binary, docs binary, none binary, folds binary"


def _counted(carried: pd.DataFrame, answers: pd.DataFrame, order: int, deleted: bool):
    """Per token and k: its n-gram's count and its context's; ``deleted``: without the deleted documents."""
    row = carried.iloc[0]
    flat, lengths = _unpack(row["flat"], np.int32), _unpack(row["lengths"], np.int64)
    starts = np.cumsum(lengths) - lengths
    grams = gram_hashes(np.frombuffer(row["hashed"], np.uint64)[flat], starts, order)
    counts = []
    for k, hashes in enumerate(grams, 1):
        mine = answers[answers["k"] == k].sort_values("first")
        totals = [np.concatenate([_unpack(x, np.uint64) for x in mine[c]] or [np.zeros(0, np.uint64)]) for c in ("trained", "gone")]
        found, at = np.unique(hashes, return_inverse=True)
        if len(totals[0]) != len(found):
            raise RuntimeError(CHANGED)
        counts.append((totals[0] - totals[1] if deleted else totals[0])[at].astype(np.float64))
    return row, flat, lengths, starts, counts


def _levels(counts: list[np.ndarray], starts: np.ndarray, documents: float):
    """For k = 2..order: (count of the n-gram, count of its context, bucket of the context)."""
    out = []
    for k in range(1, len(counts)):
        context = np.empty_like(counts[0])
        context[1:] = counts[k - 1][:-1]
        context[starts] = documents
        out.append((counts[k], context, np.floor(np.log2(context + 1)).astype(np.int64)))
    return out


def learn_weights(cells: list[tuple[tuple[int, ...], float, tuple[float, ...]]], order: int, floor: float, rounds: int = 100):
    """EM on cells (bucket per k = 1..order, tokens, log2 estimate per k, -inf for none)."""
    buckets = np.array([c[0] for c in cells], np.int64).reshape(len(cells), order)
    logs = np.array([c[2] for c in cells], np.float64).reshape(len(cells), order)
    return _learn(buckets, np.array([c[1] for c in cells], np.float64), logs, order, floor, rounds)


def _learn(buckets: np.ndarray, n: np.ndarray, logs: np.ndarray, order: int, floor: float, rounds: int = 100):
    """One weight for each k and bucket met; a bucket never met trusts its neighbour below."""
    ml = np.exp2(logs)
    weights = [np.full(65, 0.5) for _ in range(order)]
    for _ in range(rounds if len(n) else 0):
        lam = [weights[k][buckets[:, k]] for k in range(order)]
        stay, reach = [], np.ones(len(n))
        for k in range(order - 1, -1, -1):
            stay.append(reach * lam[k] * ml[:, k])
            reach = reach * (1 - lam[k])
        whole = sum(stay) + reach * floor
        arrived = n.astype(np.float64)
        for k, share in zip(range(order - 1, -1, -1), stay):
            used = n * share / whole
            num = np.bincount(buckets[:, k], used, 65)
            den = np.bincount(buckets[:, k], arrived, 65)
            # Two tokens' worth of doubt keeps weights inside (0, 1).
            weights[k] = np.where(den > 0, (num + 1) / (den + 2), weights[k])
            arrived = arrived - used
    for k in range(order):
        met = np.bincount(buckets[:, k], n, 65) > 0 if len(n) else np.zeros(65, bool)
        for b in range(1, 65):
            if not met[b]:
                weights[k][b] = weights[k][b - 1]
    return weights


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Null and empty texts are one token, the end. Repeated rows count as often as they occur. Without
    training documents all n-gram counts are 0 and the model is uniform; an empty table gives no rows.
    ``docs`` is read three times and has to give the same rows in the same partitions each time, as
    files do; anything else is refused with an error. Other columns are not read.
    """
    # Ids travel as text: pandas would round those beyond 2 ** 53 where a null stands beside them.
    given = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = given.agg(F.sum(F.char_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_CHARS))
    asked = given.mapInPandas(
        _ask(order, buckets), "bucket int, k int, chunk string, first long, grams binary, trained binary, gone binary"
    )
    answers = landed(asked.groupBy("bucket").applyInPandas(_total, ANSWER), "ngrams")
    types, total, gone, _ = answers.filter("k = 1").agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "gone_tokens", "kept_types")]
    ).first()
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    trained = code % 7 != 2
    deleted = F.floor(code / 7) % DELETED == 0
    ends = given.agg(F.count(F.when(trained & ~deleted, 1)), F.count(F.when(trained, 1))).first()
    floor, left = 1 / (types + 1), max(total - gone, 1)

    def cells(key, carried: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = {f"b{k}": [] for k in range(1, order + 1)} | {f"q{k}": [] for k in range(1, order + 1)}
        columns = [*out, "n", *(f"s{k}" for k in range(1, order + 1))]
        if carried.empty:
            return pd.DataFrame(columns=columns)
        _, _, _, starts, counts = _counted(carried, found, order, True)
        table = pd.DataFrame({"b1": np.zeros(len(counts[0]), np.int64), "s1": np.log2(np.maximum(counts[0], 1e-300) / left)})
        table.loc[counts[0] == 0, "s1"] = -np.inf
        for k, (c, context, bucket) in enumerate(_levels(counts, starts, ends[0]), 2):
            table[f"b{k}"] = bucket
            table[f"s{k}"] = np.where(c > 0, np.log2(np.maximum(c, 1) / np.maximum(context, 1)), -np.inf)
        for k in range(1, order + 1):
            none = np.isinf(table[f"s{k}"])
            table[f"q{k}"] = np.where(none, 1, np.round(STEPS * table[f"s{k}"].where(~none, 0.0))).astype(np.int64)
            table[f"s{k}"] = table[f"s{k}"].where(~none, 0.0)
        table["n"] = 1
        keys = [c for c in columns if c[0] in "bq"]
        return table.groupby(keys, as_index=False).sum()[columns]

    names = [f"{c}{k}" for c in "bq" for k in range(1, order + 1)]
    sums = ["n", *(f"s{k}" for k in range(1, order + 1))]
    gone_chunks = given.mapInPandas(_carry(order, True), CARRIED)
    met = (  # bounded by the number of buckets and probability steps
        gone_chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
        .applyInPandas(cells, ", ".join([*(f"{c} long" for c in names), *(f"{c} double" for c in sums)]))
        .groupBy(*names).agg(*[F.sum(c).alias(c) for c in sums]).orderBy(*names).toArrow()
    )
    column = lambda name: met.column(name).to_numpy()
    side = lambda letter: np.stack([column(f"{letter}{k}") for k in range(1, order + 1)], 1)
    tokens_met = column("n").astype(np.float64)
    logs = np.where(side("q") == 1, -math.inf, side("s") / np.maximum(tokens_met, 1)[:, None])
    weights = _learn(side("b").astype(np.int64), tokens_met, logs, order, floor)

    def rate(key, carried: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if carried.empty:
            raise RuntimeError(CHANGED)
        row, flat, lengths, starts, counts = _counted(carried, found, order, False)
        chance = weights[0][0] * counts[0] / max(total, 1) + (1 - weights[0][0]) * floor if total else np.full(len(flat), floor)
        for k, (c, context, bucket) in enumerate(_levels(counts, starts, ends[1]), 2):
            lam = np.where(context > 0, weights[k - 1][bucket], 0.0)
            chance = lam * c / np.maximum(context, 1) + (1 - lam) * chance
        base = np.log10((counts[0] + 1) / (total + types + 1))
        ids = pd.array(_unpack(row["docs"], np.int64), dtype="Int64")
        ids[_unpack(row["none"], np.uint8).astype(bool)] = pd.NA
        add = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "doc_id": ids, "held_out": _unpack(row["folds"], np.uint8) == APART, "n_tokens": lengths,
            "n_known": add((counts[0] > 0).astype(np.int64)), "train_tokens": total,
            "base_score": add(base), "score": add(np.log10(chance)),
        })

    chunks = given.mapInPandas(_carry(order, False), CARRIED)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        rate,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
