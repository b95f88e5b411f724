"""Log compression: neighbouring blocks that differ only in their timestamps collapse.

Lines are ``(stream, seq, line)`` with ``seq`` in their order in each stream. A block goes away when the *next* block has the same masked key, so the last of a run
survives; that makes the pass a comparison of direct neighbours, which splits at any point of a
stream as long as each part can see one row of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.functions.lines import TIMESTAMP_PATTERN, masked_key
from opsframe.operators.ordered import LINES_PER_BUCKET, number_rows, with_next
from opsframe.session import cut_lineage


def compress_lines(
    lines: DataFrame, pattern: str = TIMESTAMP_PATTERN, lines_per_bucket: int = LINES_PER_BUCKET
) -> DataFrame:
    """One pass over single lines (or ready-made blocks); surviving rows keep their ``seq``.

    ``seq`` only has to order the lines of a stream, gaps do not matter; ``lines_per_bucket`` is how
    far a bucket reaches and does not change the answer.
    """
    following = with_next(
        lines.select("stream", "seq", "line"), ["stream"], "seq", F.floor(F.col("seq") / lines_per_bucket),
        "line", lambda line: masked_key(line, pattern), "_key",
    )
    same = F.coalesce(F.col("_key_own") == F.col("_key"), F.lit(False))
    return following.filter(~same).select("stream", "seq", "line")


def renumber(lines: DataFrame, lines_per_bucket: int = LINES_PER_BUCKET) -> DataFrame:
    """Close the gaps in ``seq``."""
    old = lines.withColumnRenamed("seq", "_old")
    bucket = F.floor(F.col("_old") / lines_per_bucket)
    return number_rows(old, ["stream"], [F.col("_old")], bucket).select("stream", "seq", "line")


def block_lines(lines: DataFrame, k: int) -> DataFrame:
    """``k`` consecutive lines joined to one row; the last block of a stream may be shorter."""
    if k <= 0:
        raise ValueError("block size must be positive")
    if k == 1:
        return lines
    members = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return (
        lines.groupBy("stream", F.floor(F.col("seq") / k).alias("_block"))
        .agg(F.array_join(F.transform(members, lambda m: m["line"]), "\n").alias("line"))
        .select("stream", F.col("_block").alias("seq"), "line")
    )


def compress_multi(
    lines: DataFrame,
    window,
    pattern: str = TIMESTAMP_PATTERN,
    lines_per_bucket: int = LINES_PER_BUCKET,
) -> DataFrame:
    """Passes 1..window, pass k joining k blocks of the pass before; unset or bad window: no change."""
    try:
        passes = int(window)
    except (TypeError, ValueError):
        return lines
    current = lines
    for k in range(1, passes + 1):
        if k > 1:
            # Numbering reads its input twice, so the pass before is materialised first.
            current = renumber(cut_lineage(current), lines_per_bucket)
        current = compress_lines(block_lines(current, k), pattern, lines_per_bucket)
    return current
