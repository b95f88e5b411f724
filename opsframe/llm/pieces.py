"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model file. The *normaliser* puts the word mark before the text
and in place of blanks. The *piece* transducer has an arc for each piece that starts at a character,
and for characters without a piece a chain of byte arcs (*byte fallback*). The *neighbour* acceptor
lets one piece follow another only if the model's merges, run over the two, end in just these two:
of all segmentations only the one that the merges produce passes it. A text is composed with them
and the path of least weight is taken, by relaxing the states after each character in the tropical semiring, with
the negative score of a piece as its weight.

No piece reaches across the start of a word, so a text is composed word by word, and the path of a
word is kept by the worker for its next occurrence.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Paths of words (in each of two generations, the older one going as a new one begins) and answers
#: of the neighbour acceptor and states that a worker keeps.
KEPT_WORDS, KEPT_PAIRS, KEPT_STATES, KEPT_LENGTH = 150_000, 300_000, 400_000, 64
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield number, data[at : at + size]
            at += size


class Transducer:
    """The compiled model; one per Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        self.ids: dict[str, int] = {}
        self.weight: list[float] = []
        self.surface: list[bytes] = []
        self.bytes: dict[int, int] = {}
        for number, value in message:
            if number != 1:
                continue
            piece = dict(_fields(value))
            text = piece[1].decode()
            kind, at = piece.get(3, NORMAL), len(self.weight)
            self.weight.append(-struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            self.surface.append(b"" if kind == CONTROL else text.encode())
            if kind == BYTE:
                self.bytes[int(text[3:-1], 16)] = at
                self.surface[-1] = bytes([int(text[3:-1], 16)])
            elif kind in (NORMAL, USER):
                self.ids[text] = at
        rules = next((dict(_fields(v)) for n, v in message if n == 3), {})
        if rules.get(2) or rules.get(4, 1):
            raise ValueError("models that map characters or drop blanks are not supported")
        if len(self.bytes) != 256 or any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("the model needs byte pieces, and pieces that stay inside a word")
        self.prefix = MARK if rules.get(3, 1) else ""
        #: The id of each end of a piece (-1 if it is none itself), and the characters that stand side by
        #: side in one; a path parts at all others.
        self.ends = {piece[n:]: -1 for piece in self.ids for n in range(1, len(piece))} | self.ids
        self.beside = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        #: The state after each start of a word: least weight and last piece.
        self.states: dict[str, tuple[float, str]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.derived: dict[str, list[tuple[float, str, str]] | None] = {}

    def normalise(self, text: str) -> str:
        return self.prefix + text.replace(" ", MARK) if text else ""

    def derivation(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece: the weight of each, and the first and last part after it.

        The best pair merges first, the left one of equals. None if they end in something else.
        """
        if piece not in self.derived:
            parts, steps = list(piece), [(-np.inf, piece[0], piece[-1])]
            while len(parts) > 1:
                best, at = np.inf, -1
                for i in range(len(parts) - 1):
                    number = self.ids.get(parts[i] + parts[i + 1])
                    if number is not None and self.weight[number] < best:
                        best, at = self.weight[number], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((best, parts[0], parts[-1]))
            self.derived[piece] = steps if len(parts) == 1 else None
        return self.derived[piece]

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the merges over ``left`` + ``right`` end in these two.

        Both are made by their own merges, best weight first; they stay apart unless a merge of the
        left one's last part with the right one's first part is better at some point.
        """
        key = (left, right)
        answer = self.pairs.get(key)
        if answer is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            answer = self.pairs[key] = self._apart(self.derivation(left) if left else [], self.derivation(right))
        return answer

    def _apart(self, left, right) -> bool:
        if left is None or right is None:
            return False
        i = j = 0
        while left:
            number = self.ids.get(left[i][2] + right[j][1])
            across = np.inf if number is None else self.weight[number]
            ours = left[i + 1][0] if i + 1 < len(left) else np.inf
            theirs = right[j + 1][0] if j + 1 < len(right) else np.inf
            if ours <= across and ours <= theirs and ours < np.inf:
                i += 1
            elif across < np.inf and across <= theirs:
                return False
            elif theirs < np.inf:
                j += 1
            else:
                break
        return True

    def relax(self, word: str, end: int, states: list[tuple[float, str]]) -> tuple[float, str]:
        """The state after ``end`` characters: the least over all last pieces."""
        pairs, ends, costs = self.pairs, self.ends, self.weight
        for broken in (None, 1e12):  # where no piece may follow, a broken pair costs instead
            best, last = np.inf, ""
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                number = ends.get(piece)
                if number is None:
                    break
                if number < 0:
                    continue
                weight, before = states[start]
                allowed = pairs.get((before, piece))
                if allowed is None:
                    allowed = self.neighbours(before, piece)
                if not allowed:
                    if broken is None:
                        continue
                    weight += broken
                weight += costs[number]
                if weight < best:
                    best, last = weight, piece
            if last:
                return best, last
        raise ValueError(f"no piece ends {word[:end]!r}")

    def shortest_path(self, word: str) -> list[int]:
        """Ids of the least path through a run of characters that all have pieces.

        A state depends on the start of the word alone, so words with a common start share theirs.
        """
        if len(self.states) > KEPT_STATES:
            self.states = {}
        states = [(0.0, "")]
        for end in range(1, len(word) + 1):
            start = word[:end] if end <= KEPT_LENGTH else None
            state = self.states.get(start)
            if state is None:
                state = self.relax(word, end, states)
                if start is not None:
                    self.states[start] = state
            states.append(state)
        ids, end = [], len(word)
        while end:
            piece = states[end][1]
            ids.append(self.ids[piece])
            end -= len(piece)
        return ids[::-1]

    def part(self, word: str) -> tuple[int, ...]:
        path = self.known.get(word)
        if path is not None:
            return path
        path = self.older.get(word)
        if path is None:
            if len(word) == 1:
                number = self.ids.get(word)
                path = (number,) if number is not None else tuple(self.bytes[b] for b in word.encode("utf-8", "replace"))
            else:
                path = tuple(self.shortest_path(word)) if all(c in self.ids for c in word) else tuple(
                    n for char in word for n in self.part(char)
                )
        self.keep(word, path)
        return path

    def keep(self, word: str, path: tuple[int, ...]) -> None:
        if len(word) <= KEPT_LENGTH:
            if len(self.known) >= KEPT_WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = path

    def compose(self, word: str) -> tuple[int, ...]:
        """The path through a word: it parts where no piece holds the two characters side by side."""
        path = self.older.get(word)
        if path is not None:
            self.keep(word, path)
            return path
        ids: list[int] = []
        start = 0
        for at in range(1, len(word)):
            if word[at - 1 : at + 1] not in self.beside:
                ids += self.part(word[start:at])
                start = at
        if not start:
            return self.part(word)
        path = (*ids, *self.part(word[start:]))
        self.keep(word, path)
        return path

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in WORD.findall(self.normalise(text)):
            path = self.known.get(word)
            if path is None:
                path = self.compose(word)
            ids += path
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


#: A run of word marks with what follows it; line feeds have no pieces and part words as well.
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def _mapped(df: DataFrame, column: str, name: str, kind: T.DataType, change) -> DataFrame:
    """``df`` with ``name`` = ``change`` of the Arrow array of ``column``; all other columns ride along."""
    kept = [c for c in df.columns if c != name]
    fed = df.select(F.struct(*kept).alias("row"), F.col(column).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), change(batch.column(1))], names=["row", "value"])

    schema = T.StructType([fed.schema["row"], T.StructField("value", kind)])
    return fed.mapInArrow(run, schema).select("row.*", F.col("value").alias(name))


def encode(df: DataFrame, text: str = "text", name: str = "ids", path: str = MODEL) -> DataFrame:
    """``df`` with ``name``, the piece ids of each text; replaces a column of that name.

    A null text has null ids, an empty one none. A blank and the word mark itself encode alike.
    """

    def change(texts: pa.Array) -> pa.Array:
        coder = transducer(path)
        lists = [None if t is None else np.array(coder.encode(t), dtype=np.int32) for t in (x.as_py() for x in texts)]
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in lists)], dtype=np.int32)
        values = np.concatenate([np.zeros(0, np.int32), *(x for x in lists if x is not None)])
        mask = pa.array([x is None for x in lists], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=mask)

    return _mapped(df, text, name, T.ArrayType(T.IntegerType()), change)


def decode(df: DataFrame, ids: str = "ids", name: str = "text", path: str = MODEL) -> DataFrame:
    """``df`` with ``name``, the text of each array of ids; replaces a column of that name.

    Control pieces have no text, bytes that are no UTF-8 become the replacement character, and the
    blank before the first word is taken off. Null ids have a null text.
    """

    def change(lists: pa.Array) -> pa.Array:
        coder = transducer(path)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        valid = lists.is_valid().to_pylist()
        # One document's ids at a time become Python numbers.
        return pa.array(
            [coder.decode(values[a:b].tolist()) if ok else None for ok, a, b in zip(valid, ends, ends[1:])], pa.string()
        )

    return _mapped(df, ids, name, T.StringType(), change)


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Encodes every text, decodes the ids, and compares: ``same`` is true where all of it came back."""
    both = decode(encode(docs.select("doc_id", "text"), path=path), name="decoded", path=path)
    return both.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.replace("text", F.lit(MARK), F.lit(" "))).alias("same"),
    )
