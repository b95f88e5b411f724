"""Removal of passages that an earlier document holds: a sparse suffix array over all bytes.

A byte goes if a string of 50 bytes around it also starts in a document with a smaller id. Sorting a
suffix for each byte would move 50 bytes a byte. Suffixes are therefore taken at *anchors*: of the
24-byte strings in a stretch of 50 bytes the one with the least hash, the leftmost of equals. Equal
stretches have equal anchors, so a stretch that occurs twice is found at its anchor, and each anchor
speaks for the run of stretches that share it, about fifteen of them. Nothing is missed.

1. A chunk of documents sends per anchor a hash of its 24 bytes and one of its whole run. Anchors
   whose bytes no other document has are done, and so are runs that are equal to an earlier one.
2. Of the others the text around the anchor goes to the range of its leading bytes, between splitters
   sampled from them. A range sorts the stretches by multikey quicksort, eight bytes at a time, only
   ties further; neighbours that are equal to the end show which stretch came first.
3. What was found goes back to its chunk, which cuts the bytes out.

Equal stretches always meet in one range, so no comparison crosses a border: leading bytes that fill
several ranges are dealt among these by the anchor's bytes, and anchors with very many different
surroundings by the stretch itself. Copies within a chunk are sent once, so a passage that every
document holds costs a row per chunk.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.common import landed

LENGTH, ANCHOR = 50, 24
WINDOW = LENGTH - ANCHOR + 1
#: Leading words sampled per chunk, and in all; the latter bounds the splitters.
SAMPLE, SAMPLES = 32, 65_536
#: A null id comes after all others.
LAST = np.iinfo(np.int64).max
NEW, GONE, ASK, DEAL = range(4)
_PLACE = np.uint64((1 << 20) - 1)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Sizes(NamedTuple):
    """How the work is cut; no result depends on it."""

    #: Bytes of text in a chunk, and of those hashed at once (less than 2 ** 20).
    chunk: int = 2 << 20
    segment: int = 1 << 17
    #: Bytes of text for each bucket of the hash range, and of packed surroundings for each range.
    bucket: int = 6 << 20
    around: int = 1 << 20
    #: Different runs at one anchor beyond which each stretch is dealt by itself.
    hot: int = 1_000


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _A + right
    x ^= x >> np.uint64(29)
    x *= _B
    return x


def anchors(data: np.ndarray, owner: np.ndarray, segment: int):
    """(anchor, first, count, key, run) of all stretches that lie in one document.

    ``owner`` numbers the document of each byte. Stretches ``first`` to ``first + count - 1`` share
    the anchor; ``key`` hashes its 24 bytes, ``run`` all bytes of these stretches.
    """
    parts = []
    for low in range(0, max(len(data) - LENGTH + 1, 0), segment):
        b = data[low : low + segment + LENGTH - 1]
        one = (b.astype(np.uint64) + np.uint64(1)) * _A
        two = _join(one[:-1], one[1:])
        four = _join(two[:-2], two[2:])
        eight = _join(four[:-4], four[4:])
        sixteen = _join(eight[:-8], eight[8:])
        key = _join(sixteen[: len(b) - ANCHOR + 1], eight[16 : 16 + len(b) - ANCHOR + 1])
        least = (key & ~_PLACE) | np.arange(len(key), dtype=np.uint64)  # the leftmost of equals
        size = 1
        while size * 2 <= WINDOW:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        n = len(b) - LENGTH + 1
        least = np.minimum(least[:n], least[WINDOW - size : WINDOW - size + n])
        whole = np.flatnonzero(owner[low : low + n] == owner[low + LENGTH - 1 : low + LENGTH - 1 + n])
        if not len(whole):
            continue
        at = (least[whole] & _PLACE).astype(np.int64)
        new = np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)]
        start = np.flatnonzero(new)
        first, count = whole[start], np.diff(np.r_[start, len(whole)])

        def stretch(p):
            return _join(_join(_join(sixteen[p], sixteen[p + 16]), sixteen[p + 32]), two[p + 48])

        run = _join(_join(stretch(first), stretch(first + count - 1)), count.astype(np.uint64))
        # Least hashes are small; mixed once more they fill the range evenly.
        mixed = _join(key[at[start]], key[at[start]] >> np.uint64(32))
        parts.append((at[start] + low, first + low, count, mixed, run))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i in range(5))


class Chunk:
    """Documents side by side, with the anchors of their stretches.

    Of equal runs in the chunk one of the smallest id is sent on; ``sent`` lists these in the order
    of their bucket, and ``like`` gives for each anchor its place in ``sent``.
    """

    def __init__(self, ids: list, sizes: list[int], data: bytes, buckets: int, segment: int):
        self.ids, self.sizes = ids, np.array(sizes, dtype=np.int64)
        self.data = np.frombuffer(data, np.uint8)
        self.order = np.array([LAST if i is None else i for i in ids], dtype=np.int64)
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), self.sizes)
        self.at, self.first, self.count, self.key, self.run = anchors(self.data, owner, segment)
        self.owner = owner[self.first]
        self.id = self.order[self.owner]
        place = np.lexsort((self.id, self.run, self.key))
        new = np.ones(len(place), dtype=bool)
        new[1:] = (self.key[place][1:] != self.key[place][:-1]) | (self.run[place][1:] != self.run[place][:-1])
        sent = place[new]
        bucket = ((self.key[sent] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        turn = np.lexsort((self.owner[sent], bucket))
        self.sent, self.bucket = sent[turn], bucket[turn]
        back = np.empty(len(turn), dtype=np.int64)
        back[turn] = np.arange(len(turn))
        self.like = np.empty(len(place), dtype=np.int64)
        self.like[place] = back[np.cumsum(new) - 1]


_CHUNK = "chunk long, ids array<long>, sizes array<long>, data binary"


def _gather(size: int):
    """Whole documents, about ``size`` bytes of them to a row."""

    def gather(batches):
        yield from _gathered(batches, size)

    return gather


def _gathered(batches, size: int):
    number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())),
             pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary())],
            ["chunk", "ids", "sizes", "data"],
        )

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            ids.append(doc_id)
            texts.append(text.as_py() or b"")
            held += len(texts[-1])
            if held >= size:
                yield row()
                number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield row()


def _chunks(batch: pa.RecordBatch, buckets: int, segment: int):
    for x in batch.to_pylist():
        yield x["chunk"], Chunk(x["ids"], x["sizes"], zstandard.decompress(x["data"]), buckets, segment)


_ASKED = "bucket long, chunk long, keys binary, runs binary, ids binary"


def _ask(buckets: int, segment: int):
    def ask(batches):
        for batch in batches:
            for number, chunk in _chunks(batch, buckets, segment):
                cuts = np.flatnonzero(np.r_[True, chunk.bucket[1:] != chunk.bucket[:-1]]) if len(chunk.sent) else []
                rows = []
                for lo, hi in zip(cuts, [*cuts[1:], len(chunk.sent)]):
                    mine = chunk.sent[lo:hi]
                    rows.append({
                        "bucket": int(chunk.bucket[lo]), "chunk": number,
                        "keys": chunk.key[mine].astype("<u4").tobytes(), "runs": chunk.run[mine].tobytes(),
                        "ids": pack(np.diff(chunk.id[mine], prepend=0)),
                    })
                yield pa.RecordBatch.from_pylist(rows, _schema(_ASKED))

    return ask


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
             "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


_ANSWERED = "bucket long, chunk long, states binary"


def _answer(rows, hot: int):
    """What becomes of each anchor of a bucket of the hash range."""
    messages = rows.to_pylist()
    key = np.concatenate([np.frombuffer(m["keys"], "<u4") for m in messages])
    run = np.concatenate([np.frombuffer(m["runs"], np.uint64) for m in messages])
    ids = np.concatenate([np.cumsum(unpack(m["ids"], np.int64)) for m in messages])
    order = np.lexsort((ids, run, key))
    key, run, ids = key[order], run[order], ids[order]
    new_key = np.r_[True, key[1:] != key[:-1]]
    new_run = new_key | np.r_[True, run[1:] != run[:-1]]
    runs = np.flatnonzero(new_run)
    earliest = np.repeat(ids[runs], np.diff(np.r_[runs, len(ids)]))
    keys = np.flatnonzero(new_key)
    sizes = np.diff(np.r_[keys, len(ids)])
    shared = np.minimum.reduceat(ids, keys) != np.maximum.reduceat(ids, keys)
    variety = np.add.reduceat(new_run.astype(np.int64), keys)
    per_key = np.where(shared & (variety > 1), np.where(variety > hot, DEAL, ASK), NEW)
    state = np.empty(len(ids), dtype=np.uint8)
    state[order] = np.where(earliest < ids, GONE, np.repeat(per_key, sizes))
    out, at = [], 0
    for m in messages:
        n = len(m["keys"]) // 4
        out.append({"bucket": m["bucket"], "chunk": m["chunk"], "states": pack(state[at : at + n])})
        at += n
    return pa.Table.from_pylist(out, _schema(_ANSWERED))


_LOCAL = (
    "chunk long, done array<long>, done_sizes array<long>, done_sha array<string>, ids array<long>, sizes array<long>, "
    "data binary, gone binary, gone_size binary, open binary, open_size binary, open_record binary, "
    "sample array<long>, lead binary, hash binary, order binary, count binary, around binary"
)


def _around(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches of ``data``, one after the other."""
    return data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes as a number that sorts as they do."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)


def _decide(buckets: int, segment: int):
    def decide(key, given, answers):
        if not given.num_rows:
            return _schema(_LOCAL).empty_table()
        x = given.to_pylist()[0]
        chunk = Chunk(x["ids"], x["sizes"], zstandard.decompress(x["data"]), buckets, segment)
        replies = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
        state = np.concatenate([unpack(r["states"], np.uint8) for r in replies] or [np.zeros(0, np.uint8)])
        like = chunk.like
        of = state[like]
        gone = (of == GONE) | (chunk.id[chunk.sent][like] < chunk.id)
        waiting = ~gone & (of >= ASK)
        # One record per run sent; of hot anchors one per stretch.
        asked = np.flatnonzero(state >= ASK)
        hot = state[asked] == DEAL
        plain = chunk.sent[asked[~hot]]
        dealt = chunk.sent[asked[hot]]
        each = chunk.count[dealt]
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        single = np.repeat(chunk.first[dealt], each) + step
        record = np.full(len(state), -1, dtype=np.int64)
        record[asked[~hot]] = np.arange(len(plain))
        record[asked[hot]] = len(plain) + np.cumsum(each) - each
        first = np.r_[chunk.first[plain], single]
        count = np.r_[chunk.count[plain], np.ones(len(single), dtype=np.int64)]
        order = np.r_[chunk.id[plain], np.repeat(chunk.id[dealt], each)]
        mixed = _join(_join(_lead(chunk.data, single), _lead(chunk.data, single + 24)), _lead(chunk.data, single + 42))
        lead = np.r_[_lead(chunk.data, chunk.at[plain]), mixed]
        hashed = np.r_[chunk.key[plain], mixed].astype(np.uint32)
        some = np.linspace(0, len(lead) - 1, SAMPLE).astype(int) if len(lead) else []
        # Where the answers belong: stretches of the documents' bytes.
        mine = np.flatnonzero(waiting)
        single_mine = state[like[mine]] == DEAL
        reps = np.where(single_mine, chunk.count[mine], 1)
        turn = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        open_first = np.repeat(chunk.first[mine], reps) + turn
        open_size = np.repeat(np.where(single_mine, 1, chunk.count[mine]), reps)
        open_record = np.repeat(record[like[mine]], reps) + turn
        touched = np.zeros(len(chunk.ids), dtype=bool)
        touched[chunk.owner[gone | waiting]] = True
        ends = np.cumsum(chunk.sizes)
        shift = np.cumsum(np.where(touched, 0, chunk.sizes)) - np.where(touched, 0, chunk.sizes)  # bytes left out before
        begin = ends - chunk.sizes
        rest = [i for i in range(len(chunk.ids)) if not touched[i]]
        moved = lambda p, own: p - shift[own]
        row = {
            "chunk": x["chunk"], "done": [chunk.ids[i] for i in rest], "done_sizes": [int(chunk.sizes[i]) for i in rest],
            "done_sha": [hashlib.sha256(chunk.data[begin[i] : ends[i]]).hexdigest() for i in rest],
            "ids": [chunk.ids[i] for i in np.flatnonzero(touched)], "sizes": chunk.sizes[touched].tolist(),
            "data": zstandard.compress(chunk.data[np.repeat(touched, chunk.sizes)].tobytes(), 3),
            "gone": pack(moved(chunk.first[gone], chunk.owner[gone])), "gone_size": pack(chunk.count[gone]),
            "open": pack(moved(open_first, np.repeat(chunk.owner[mine], reps))), "open_size": pack(open_size),
            "open_record": pack(open_record), "sample": lead[some].view(np.int64).tolist(), "lead": pack(lead),
            "hash": pack(hashed), "order": pack(order), "count": pack(count.astype(np.uint8)),
            "around": zstandard.compress(_around(chunk.data, first, count + LENGTH - 1).tobytes(), 3),
        }
        return pa.Table.from_pylist([row], _schema(_LOCAL))

    return decide


_DEALT = "range long, chunk long, record binary, order binary, count binary, around binary"


def _deal(splitters: np.ndarray):
    def deal(batches):
        for batch in batches:
            for x in batch.to_pylist():
                lead, hashed = unpack(x["lead"], np.uint64), unpack(x["hash"], np.uint32)
                order, count = unpack(x["order"], np.int64), unpack(x["count"], np.uint8).astype(np.int64)
                around = np.frombuffer(zstandard.decompress(x["around"]), np.uint8)
                low, high = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
                home = low + hashed % (high - low + 1)
                size = count + LENGTH - 1
                begin = np.cumsum(size) - size
                turn = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.r_[True, home[turn][1:] != home[turn][:-1]]) if len(turn) else []
                rows = []
                for a, b in zip(cuts, [*cuts[1:], len(turn)]):
                    mine = turn[a:b]
                    rows.append({
                        "range": int(home[mine[0]]), "chunk": x["chunk"], "record": pack(mine), "order": pack(order[mine]),
                        "count": pack(count[mine].astype(np.uint8)),
                        "around": zstandard.compress(_around(around, begin[mine], size[mine]).tobytes(), 3),
                    })
                yield pa.RecordBatch.from_pylist(rows, _schema(_DEALT))

    return deal


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): rows sorted by their words, the next word only for ties; ``new`` marks where a
    row differs from the one before it."""
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    new = np.ones(len(order), dtype=bool)
    new[1:] = first[1:] != first[:-1]
    for w in range(1, words.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        group, rows = np.cumsum(new)[tied], order[tied]
        turn = np.lexsort((words[rows, w], group))
        order[tied] = rows = rows[turn]
        value = words[rows, w]
        differs = np.ones(len(tied), dtype=bool)
        differs[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        new[tied] |= differs
    return order, new


_FOUND = "chunk long, record binary, repeats binary"


def _sort(rows):
    """Which stretches of a range occur in an earlier document, as bits per record."""
    messages = rows.to_pylist()
    sizes = [unpack(m["count"], np.uint8).astype(np.int64) for m in messages]
    count = np.concatenate(sizes)
    around = np.frombuffer(b"".join(zstandard.decompress(m["around"]) for m in messages), np.uint8)
    ids = np.repeat(np.concatenate([unpack(m["order"], np.int64) for m in messages]), count)
    whole = count + LENGTH - 1
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(whole) - whole, count) + step
    words = np.empty((len(start), -(-LENGTH // 8)), dtype=np.uint64)
    for w in range(words.shape[1]):  # the last word begins early, so that it ends with the stretch
        words[:, w] = _lead(around, start + min(w * 8, LENGTH - 8))
    order, new = multikey(words)
    firsts = np.flatnonzero(new)
    earliest = np.empty(len(order), dtype=np.int64)
    earliest[order] = np.repeat(np.minimum.reduceat(ids[order], firsts), np.diff(np.r_[firsts, len(order)]))
    bits = np.where(earliest < ids, np.uint32(1) << step.astype(np.uint32), np.uint32(0)).astype(np.uint32)
    repeats = np.bitwise_or.reduceat(bits, np.cumsum(count) - count)
    out, at = [], 0
    for m, n in zip(messages, map(len, sizes)):
        out.append({"chunk": m["chunk"], "record": m["record"], "repeats": pack(repeats[at : at + n])})
        at += n
    return pa.Table.from_pylist(out, _schema(_FOUND))


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def cut(key, given, found):
        if not given.num_rows:
            return _schema(_OUT).empty_table()
        x = given.to_pylist()[0]
        repeats = np.zeros(len(unpack(x["count"], np.uint8)), dtype=np.uint32)
        for m in found.to_pylist():
            repeats[unpack(m["record"], np.int64)] = unpack(m["repeats"], np.uint32)
        first, size = unpack(x["open"], np.int64), unpack(x["open_size"], np.int64)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hit = (np.repeat(repeats[unpack(x["open_record"], np.int64)], size) >> step.astype(np.uint32)) & 1 == 1
        single = (np.repeat(first, size) + step)[hit]
        data = np.frombuffer(zstandard.decompress(x["data"]), np.uint8)
        change = np.zeros(len(data) + 1, dtype=np.int32)
        gone, gone_size = unpack(x["gone"], np.int64), unpack(x["gone_size"], np.int64)
        for begin, end in ((gone, gone + gone_size - 1 + LENGTH), (single, single + LENGTH)):
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
        cover = np.cumsum(change[:-1]) > 0
        ends = np.cumsum(np.array(x["sizes"], dtype=np.int64))
        begins = ends - np.array(x["sizes"], dtype=np.int64)
        starts = cover.copy()
        starts[1:] &= ~cover[:-1]
        inner = begins[begins < len(data)]
        starts[inner] |= cover[inner]
        removed, spans = (np.r_[0, np.cumsum(v)] for v in (cover, starts))
        rows = []
        for doc_id, lo, hi in zip(x["ids"], begins, ends):
            kept = data[lo:hi][~cover[lo:hi]].tobytes()
            rows.append({
                "doc_id": doc_id, "n_bytes": int(hi - lo), "n_removed": int(removed[hi] - removed[lo]),
                "n_spans": int(spans[hi] - spans[lo]), "kept_sha256": hashlib.sha256(kept).hexdigest(),
                "kept": kept if with_text else None,
            })
        for doc_id, n, sha in zip(x["done"], x["done_sizes"], x["done_sha"]):
            rows.append({"doc_id": doc_id, "n_bytes": n, "n_removed": 0, "n_spans": 0, "kept_sha256": sha, "kept": None})
        return pa.Table.from_pylist(rows, _schema(_OUT))

    return cut


def without_repeats(docs: DataFrame, with_text: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``,
    the bytes ``kept`` of the rows that lost some (null for rows kept as they are).

    Null texts are empty; they and texts of fewer than 50 bytes stay whole. Strings of rows with equal
    ids don't remove each other, so repeated rows stay or go alike; a null id counts as the largest.
    Cut bytes need not end at a character. Texts of any length are taken whole, a text in one task. An
    empty table gives no rows. Other columns are not read.
    """
    chunks = landed(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_gather(sizes.chunk), _CHUNK), "chunks")
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    buckets = max(1, -(-total // sizes.bucket))
    one = F.col("chunk")
    asked = chunks.mapInArrow(_ask(buckets, sizes.segment), _ASKED)
    answers = asked.groupBy("bucket").applyInArrow(lambda rows: _answer(rows, sizes.hot), _ANSWERED)
    local = chunks.groupBy(one).cogroup(answers.groupBy(one)).applyInArrow(_decide(buckets, sizes.segment), _LOCAL)
    local = landed(local, "anchors")
    leads = local.select(F.explode("sample").alias("lead"))
    sample = leads.orderBy(F.xxhash64("lead"), "lead").limit(SAMPLES).toArrow().column(0).to_numpy().view(np.uint64)
    around = local.agg(F.sum(F.octet_length("around"))).first()[0] or 0
    ranges = min(max(1, -(-around // sizes.around)), max(1, len(sample)))
    sample = np.sort(sample)
    splitters = sample[np.linspace(0, len(sample), ranges + 1).astype(int)[1:-1]]
    dealt = local.select("chunk", "lead", "hash", "order", "count", "around").mapInArrow(_deal(splitters), _DEALT)
    found = dealt.groupBy("range").applyInArrow(lambda rows: _sort(rows), _FOUND)
    kept = local.drop("sample", "lead", "hash", "order", "around")
    out = kept.groupBy(one).cogroup(found.groupBy(one)).applyInArrow(_cut(with_text), _OUT)
    return out if with_text else out.drop("kept")
