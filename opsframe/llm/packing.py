"""Bulk-synchronous best-fit packing of tokenised documents into sequences of a fixed length.

All open sequences have a gap. A round lays documents and gaps in order of size and sweeps them:
going up, each gap takes the largest document below it that no smaller gap has taken, which is the
best fit for all of them at once. The sweep is a matching of brackets, and needs no sequential pass:
the counts of each size (at most two per possible length) give the height at which a size's brackets
start, the rank of a document among its equals gives its own height, and a document is matched if
the next bracket at its height is a gap. Then gaps shrink and the next round begins, until nothing
fits; documents left over then open sequences of their own, laid end to end, and the rounds go on.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import landed

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Marks the end of a document.
END_ID = 1
CAPACITY = 4096
#: Words kept by a Python worker, as columns; beyond it only those of the present texts stay.
CACHE_WORDS = 150_000
#: Bytes of text that are looked up at once.
CHUNK_BYTES = 1_000_000
#: Words that the vocabulary's merges take at once; they need hundreds of bytes a word meanwhile.
CHUNK_WORDS = 4096
#: Equal sizes are ranked in so many parts, so that no task ranks all documents of one length.
SALTS = 16

_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: How byte-level vocabularies write bytes: printed ones as they are, the rest from 256 on.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}

#: Latin letters and signs, lower-cased, which no normal form changes: their classes are known here.
_LETTERS, _DIGITS = "a-zªµºß-öø-į", "0-9²³¹¼-¾"
_LATIN = "^[!-~\u00a1-\u00ac\u00ae-\u012f]+$"
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")
#: The letter of each byte, but for what stands between words and their parts.
_WRITTEN = np.array([b if b in b"\n " else BYTE_LETTERS.get(b, b) for b in range(256)], dtype="<u2")

_coders: dict[str, "Coder"] = {}


class Coder:
    """Ids of whole texts, put together from the ids of their words, each encoded once.

    The vocabulary's words never reach over white space, so a text's ids are those of its parts
    between ASCII blanks. Texts are split and words numbered as Arrow columns; known words lie in
    columns, too: the ids of all of them end to end, and where each word's ids begin and end.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        #: The same vocabulary for text that is folded and split into words already.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id is the last one of a word.
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.words = pa.array([], pa.string())
        self.ids, self.ends = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of Latin ``words`` end to end, and the number of each word's ids."""
        split = [w if w.isalpha() else " ".join(_PARTS.findall(w.lower())) for w in words]
        text = np.frombuffer("\n".join([*split, ""]).lower().encode(), dtype=np.uint8)
        bounds = text[(text == 10) | (text == 32)]  # a word's end, or that of a part of it
        text = _WRITTEN[text].tobytes().decode("utf-16-le")
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        return ids, np.diff((np.flatnonzero(self.last[ids]) + 1)[bounds == 10], prepend=0)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``words`` end to end, and the number of each word's ids."""
        latin = pc.and_(pc.match_substring_regex(words, _LATIN), pc.invert(pc.match_substring(words, "<|")))
        known, latin = words.filter(latin), latin.to_numpy(zero_copy_only=False)
        merged = [self._merged(known.slice(at, CHUNK_WORDS).to_pylist()) for at in range(0, len(known), CHUNK_WORDS)]
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *(i for i, _ in merged)])
        counts = np.zeros(len(words), dtype=np.int64)
        counts[latin] = np.concatenate([counts[:0], *(n for _, n in merged)])
        if latin.all():
            return ids, counts
        # The rest goes through the whole tokenizer, word by word.
        rest = words.filter(pa.array(~latin)).to_pylist()
        codes = [c.ids for c in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        counts[~latin] = [len(c) for c in codes]
        out, first = np.empty(counts.sum(), dtype="<u4"), np.repeat(latin, counts)
        out[first], out[~first] = ids, [i for c in codes for i in c]
        return out, counts

    def _look_up(self, words: pa.Array) -> np.ndarray:
        """The number of each of ``words``, which are distinct, among those kept."""
        at = pc.index_in(words, self.words)
        fresh = words.filter(pc.is_null(at))
        if not len(fresh):
            return at.to_numpy()
        if len(self.words) + len(fresh) > CACHE_WORDS:
            at = at.drop_null().to_numpy()
            counts = np.diff(self.ends)[at]
            self.ids = self.ids[_ranges(self.ends[at], counts)]
            self.ends = np.append(0, np.cumsum(counts))
            self.words = self.words.take(pa.array(at))
        ids, counts = self._encoded(fresh)
        self.ids = np.append(self.ids, ids)
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(counts))
        self.words = pa.concat_arrays([self.words, fresh])
        return pc.index_in(words, self.words).to_numpy()

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one run of ``texts`` after the other: the ids of its texts end to end, ``END_ID`` after
        each, and where the ids of each end."""
        done = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK_BYTES
        cuts = np.flatnonzero(np.diff(done, prepend=-1, append=done[-1:] + 1))
        for lo, hi in zip(cuts, cuts[1:]):
            split = pc.ascii_split_whitespace(_folded(texts.slice(lo, hi - lo)))
            offsets = split.offsets.to_numpy().astype(np.int64)
            words = split.flatten().dictionary_encode()
            at = self._look_up(words.dictionary.cast(pa.string()))
            # The mark is one more word, after the last of each text.
            ids, starts = np.append(self.ids, np.uint32(END_ID)), np.append(self.ends[:-1][at], len(self.ids))
            counts = np.append(np.diff(self.ends)[at], 1)
            order = np.insert(words.indices.to_numpy(), offsets[1:] - offsets[0], len(at))
            ends = np.cumsum(counts[order])[offsets[1:] - offsets[0] + np.arange(hi - lo)]
            yield ids[_ranges(starts[order], counts[order])], ends


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` (so many as counted), then those from ``starts[1]``, ..."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def _folded(texts: pa.Array) -> pa.Array:
    """A-Z folded, as the vocabulary does later anyway; a text that may hold a control token stays as it is."""
    return pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))


def coder(path: str) -> Coder:
    """One per Python worker, kept between its tasks."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def tokenise(
    docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``).

    A document is its ids and ``END_ID``, so a null or empty text is one token. Only longer ones are
    cut; the last piece may be shorter. Repeated rows are documents of their own.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            done = 0
            for ids, ends in coder(path).encode(batch.column(1)):
                begins = np.append(0, ends[:-1])
                pieces = -(-(ends - begins) // capacity)
                doc = np.repeat(np.arange(len(ends)), pieces)
                piece = _ranges(np.zeros_like(pieces), pieces)
                start = piece * capacity
                lo, hi = begins[doc] + start, np.minimum(begins[doc] + start + capacity, ends[doc])
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(lo, hi)]
                columns = [
                    batch.column(0).take(pa.array(done + doc)), pa.array(piece, pa.int32()), pa.array(start),
                    pa.array(hi - lo), pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, hi), pa.int32()), pa.array(ids.view("<i4"))))
                done += len(ends)
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(cut, schema)


def _sweep(state: DataFrame) -> DataFrame:
    """One round. ``state`` rows are documents (``item``, ``size``, no ``seq``) or sequences (``seq``,
    ``gap``); the result has matched rows with both, and what is left of either."""
    items = state.filter("seq IS NULL").select(F.lit(0).alias("kind"), F.col("item").alias("id"), "size")
    gaps = state.filter("seq IS NOT NULL AND gap > 0").select(
        F.lit(1).alias("kind"), F.col("seq").alias("id"), F.col("gap").alias("size")
    )
    both = items.unionByName(gaps).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    place = ["size", "kind", "salt"]
    upto = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    heights = (  # at most 2 x SALTS rows per possible length, whatever the corpus
        both.groupBy(*place)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("raw", F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).over(upto))
        .withColumn("after", F.col("raw") - F.least(F.lit(0), F.min("raw").over(upto)))
        .select(*place, F.coalesce(F.lag("after").over(Window.orderBy(*place)), F.lit(0)).alias("base"))
    )
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("id"))
    raised = (
        both.withColumn("rank", rank)
        .join(heights, place)
        .withColumn(
            "height",
            F.when(F.col("kind") == 0, F.col("base") + F.col("rank")).otherwise(F.col("base") - F.col("rank") + 1),
        )
    )
    # A gap of no height has no smaller document left; it stands alone under its own id.
    at_height = Window.partitionBy(
        "height", F.when(F.col("height") <= 0, F.col("id"))
    ).orderBy(*place)
    met = raised.withColumn("above", F.lead(F.struct("kind", "id", "size")).over(at_height))
    matched = (F.col("kind") == 0) & (F.col("above.kind") == 1)
    return met.filter((F.col("kind") == 0) | (F.col("height") <= 0)).select(
        F.when(F.col("kind") == 0, F.col("id")).alias("item"),
        F.when(F.col("kind") == 0, F.col("size")).alias("size"),
        F.when(matched, F.col("above.id")).when(F.col("kind") == 1, F.col("id")).alias("seq"),
        F.when(matched, F.col("above.size")).alias("gap_before"),
        F.when(matched, F.col("above.size") - F.col("size")).when(F.col("kind") == 1, F.col("size")).alias("gap"),
    )


def _opened(spark, count: int, capacity: int) -> DataFrame:
    return spark.range(count).selectExpr(
        "cast(null as long) item", "cast(null as long) size", "id seq", "cast(null as long) gap_before",
        f"cast({capacity} as long) gap",
    )


def _laid_out(state: DataFrame, first: int, capacity: int) -> DataFrame:
    """Opens sequences for documents that fit no gap: laid end to end by falling size, each stretch of
    ``capacity`` is a sequence, and a document that crosses into the next one goes on waiting."""
    waiting = state.filter("seq IS NULL").select("item", "size", F.pmod(F.xxhash64("item"), F.lit(SALTS)).alias("salt"))
    place = ["size", "salt"]
    before = Window.orderBy(F.desc("size"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (  # at most SALTS rows per possible length
        waiting.groupBy(*place).agg(F.sum("size").alias("held"))
        .select(*place, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    )
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("item"))
    laid = (
        waiting.withColumn("rank", rank).join(base, place)
        .withColumn("start", F.col("base") + (F.col("rank") - 1) * F.col("size"))
        .withColumn("stretch", F.expr(f"start div {capacity}"))
        .withColumn("inside", F.expr(f"start % {capacity} + size <= {capacity}"))
    )
    whole = Window.partitionBy("stretch", "inside")
    offset = F.col("start") - F.min("start").over(whole)
    last = F.col("start") == F.max("start").over(whole)
    placed = laid.select(
        "item", "size", "inside", (F.col("stretch") + first).alias("_seq"), offset.alias("_offset"), last.alias("_last")
    )
    mine = lambda value: F.when(F.col("inside"), value)
    end = F.lit(capacity) - F.col("_offset") - F.col("size")
    return placed.select(
        "item", "size", mine(F.col("_seq")).alias("seq"), mine(F.lit(capacity) - F.col("_offset")).alias("gap_before"),
        mine(F.when(F.col("_last"), end).otherwise(0)).alias("gap"),
    )


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``item``, ``seq``, ``offset`` for each (``item``, ``size``), sizes 1 to ``capacity``.

    ``item`` is unique. Sequences start as many as the total length needs at least; only documents
    that fit no gap open more. Equal sizes are told apart by ``item``. Each round is written to the
    shared folder; rounds are about as many as the most documents in one sequence.
    """
    spark = items.sparkSession
    blank = F.lit(None).cast("long")
    left = items.select("item", "size", blank.alias("seq"), blank.alias("gap_before"), blank.alias("gap"))
    waiting, total = left.agg(F.count("item"), F.coalesce(F.sum("size"), F.lit(0))).first()
    opened, placed, moved = -(-total // capacity), [], 1
    state = left.unionByName(_opened(spark, opened, capacity))
    while waiting:
        if moved:
            state = landed(_sweep(state), "packing")
        else:
            state, opened = landed(_laid_out(state, opened, capacity), "packing"), opened - (-total // capacity)
        alone = F.col("seq").isNull()
        moved, waiting, total = state.agg(
            F.count("gap_before"), F.count(F.when(alone, F.col("item"))),
            F.coalesce(F.sum(F.when(alone, F.col("size"))), F.lit(0)),
        ).first()
        placed.append(state.filter("gap_before IS NOT NULL").select(
            "item", "seq", (F.lit(capacity) - F.col("gap_before")).alias("offset")))
    if not placed:
        return left.select("item", "seq", blank.alias("offset"))
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def pack(
    docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """The pieces of ``tokenise`` with ``sequence_id`` and ``offset``; an empty table gives none.

    Other columns of ``docs`` are not read.
    """
    pieces = landed(
        tokenise(docs, path, capacity, with_ids).withColumn("_item", F.monotonically_increasing_id()), "pieces"
    )
    full = F.col("length") == capacity
    fitted = best_fit(
        pieces.filter(~full).select(F.col("_item").alias("item"), F.col("length").alias("size")), capacity
    ).select(F.col("item").alias("_item"), F.col("seq").alias("sequence_id"), "offset")
    whole = pieces.filter(full).withColumns({"sequence_id": -1 - F.col("_item"), "offset": F.lit(0).cast("long")})
    return whole.unionByName(pieces.filter(~full).join(fitted, "_item")).drop("_item")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
