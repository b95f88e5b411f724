"""Raw log text: line splitting and comparison of lines with their timestamps blanked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timestamp shapes that are blanked, in matching order.
TIMESTAMP_SHAPES = (
    r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)",
    r"\d{4}-[A-Z][a-z]{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?",
    r"\b\d{2}:\d{2}:\d{2}\b",
    r"\b\d+m(?:\d+s)?\b",
    r"\b\d+s\b",
    r"[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} \d{4}",
)
TIMESTAMP_PATTERN = "(?:" + "|".join(TIMESTAMP_SHAPES) + ")"

# \d and \b over Unicode, as the shapes are meant.
_UNICODE = "(?U)"

# Every separator a text line may end with.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"

_MARK = "\u0001"


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    parts = F.split(text, LINE_BREAK, -1)
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(last == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def timestamps(line: Column, pattern: str = TIMESTAMP_PATTERN) -> Column:
    return F.regexp_extract_all(line, F.lit(_UNICODE + pattern), F.lit(0))


def masked_key(line: Column, pattern: str = TIMESTAMP_PATTERN) -> Column:
    """Text that is equal for two lines exactly when they differ only in their timestamps.

    Each timestamp becomes as many spaces as it is long, the first of them a start mark, so the key
    fixes the start offsets, their number and the remaining text. A mark in the text itself is
    doubled; a start mark is always followed by a space. NULL when the line has no timestamp.
    """
    safe = F.replace(line, F.lit(_MARK), F.lit(_MARK * 2))
    parts = F.struct(
        F.split(safe, _UNICODE + pattern, -1).alias("texts"), timestamps(safe, pattern).alias("found")
    )

    def piece(text: Column, stamp: Column) -> Column:
        blank = F.concat(F.lit(_MARK), F.repeat(F.lit(" "), F.length(stamp) - 1))
        return F.concat(text, F.coalesce(blank, F.lit("")))

    def joined(p: Column) -> Column:
        return F.when(F.size(p["found"]) > 0, F.array_join(F.zip_with(p["texts"], p["found"], piece), ""))

    # The one-element array binds both scans of the line, so each is made once.
    return F.transform(F.array(parts), joined)[0]
