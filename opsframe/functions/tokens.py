"""Exact token counts by a byte-pair vocabulary given as ranks.

The vocabulary is read once on the driver and sent to the workers, which need no file; its size, not
that of the data, bounds what is sent. A worker builds the encoder once and takes whole Arrow batches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_encoders: dict[str, object] = {}


def _encoder(name: str, data: bytes, pattern: str):
    """The encoder of a vocabulary, built once per worker."""
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        _encoders.clear()  # a worker serves one vocabulary at a time
        _encoders[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


class Vocabulary:
    """``count(text)`` and ``cut(text, n)`` as Column functions; null gives null.

    ``path`` names a file of lines ``base64-token rank``, ``pattern`` the regular expression that
    splits text before merging. Strings that look like special tokens are ordinary text.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            data = file.read()
        name = hashlib.sha256(data + pattern.encode()).hexdigest()
        sent = spark.sparkContext.broadcast(data)

        @F.arrow_udf("long")
        def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = _encoder(name, sent.value, pattern).encode_ordinary
            for batch in batches:
                yield pa.array([None if t is None else len(encode(t)) for t in batch.to_pylist()], pa.int64())

        @F.arrow_udf("string")
        def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            encoder = _encoder(name, sent.value, pattern)
            for texts, sizes in batches:
                pairs = zip(texts.to_pylist(), sizes.to_pylist())
                yield pa.array(
                    [None if t is None else encoder.decode(encoder.encode_ordinary(t)[:n]) for t, n in pairs], pa.string()
                )

        self.count: Callable[[Column], Column] = count
        self._cut = cut

    def cut(self, text: Column, n: int) -> Column:
        """The text of the first ``n`` tokens; bytes of a character cut in two become U+FFFD."""
        return self._cut(text, F.lit(n))
