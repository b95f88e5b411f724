"""Order MinHash: fingerprints whose likeness follows the edit distance of two texts.

A text is cut into pieces, every run of ``k`` neighbouring pieces is a k-mer, and a k-mer that
occurs again gets the number of its occurrence, so that a set of (k-mer, occurrence) stands for the
text. One hash puts the set in a circular order. Signature ``j`` takes the ``ell`` members that are
minimal when the order starts at point ``j`` of ``slots`` evenly spread points (the hash minus the
point, modulo the hash range, is the permutation), lists their k-mers in text order and hashes that
tuple. Two texts agree in a slot only if they share these k-mers *and* their order.

Everything is built-in column functions: one sort of longs per text, no shuffle and no row per k-mer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.llm.common import let, text_or_empty

#: Pieces: up to eight characters of a word; white space only separates.
PIECE = r"[^\s]{1,8}"
#: The low bits of an ordered hash hold the position in the text, the rest the hash itself.
PLACE_BITS = 24
PLACE_MASK = (1 << PLACE_BITS) - 1


def _kmers(text: Column, k: int) -> Column:
    """A hash of each run of ``k`` pieces; the last runs of a text are shorter."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return let(
        F.transform(pieces, lambda piece: F.xxhash64(piece)),
        lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + o) for o in range(1, k)))),
    )


def _same(order: Column, i: Column) -> Column:
    """Whether entry ``i`` of the order has the hash of the one before."""
    return F.shiftright(order[i], PLACE_BITS) == F.shiftright(F.get(order, i - 1), PLACE_BITS)


def _numbered(order: Column, repeats: Column) -> Column:
    """Replaces the hash of second and later occurrences by one that has their number in it.

    Each entry points to the one before with the same hash; pointers are doubled until they reach
    the first occurrence, so the work is n log(repeats) for any text.
    """
    back = F.transform(order, lambda x, i: F.when((i > 0) & _same(order, i), i - 1).otherwise(i))
    rounds = F.ceil(F.log2(repeats + F.lit(1.0))).cast("int") + 1
    first = F.aggregate(
        F.sequence(F.lit(1), rounds), back, lambda acc, _: F.transform(acc, lambda at: acc[at])
    )

    def renumber(first: Column) -> Column:
        return F.transform(
            order,
            lambda x, i: F.when(first[i] == i, x).otherwise(
                F.xxhash64(F.shiftright(x, PLACE_BITS), i - first[i])
                .bitwiseAND(F.lit(~PLACE_MASK))
                .bitwiseOR(x.bitwiseAND(F.lit(PLACE_MASK)))
            ),
        )

    return F.sort_array(let(first, renumber))


def with_sketch(
    df: DataFrame, text: str, name: str, k: int = 3, ell: int = 2, slots: int = 64
) -> DataFrame:
    """Adds ``name``: an array of ``slots`` ints, empty for a text without pieces (or a null text).

    ``slots`` is a power of two. Equal texts have equal sketches, white space only separates pieces,
    and a text of fewer than ``k`` pieces is covered by its shorter runs.
    """
    bits = slots.bit_length() - 1
    if 1 << bits != slots or ell < 1 or k < 1:
        raise ValueError("slots must be a power of two, k and ell at least 1")
    place = F.lit(PLACE_MASK)
    kmers, order, n = F.col("_om_kmers"), F.col("_om_order"), F.size("_om_order")

    def slot(at: Column) -> Column:
        return (F.shiftright(order[at], 64 - bits) + slots // 2).cast("int")

    def signature(at: Column) -> Column:
        nearest = F.transform(
            F.sequence(F.lit(0), F.least(F.lit(ell), n) - 1),
            lambda o: order[(at + o) % n].bitwiseAND(place).cast("int"),
        )
        return F.hash(F.transform(F.array_sort(nearest), lambda p: kmers[p]))

    def spread(firsts: Column) -> Column:
        filled = F.transform(
            firsts,
            lambda f, j: F.array_repeat(
                f["sig"], F.when(j == 0, f["slot"] + 1).otherwise(f["slot"] - F.get(firsts, j - 1)["slot"])
            ),
        )
        return F.concat(
            F.flatten(filled), F.array_repeat(firsts[0]["sig"], slots - 1 - F.element_at(firsts, -1)["slot"])
        )

    opening = F.transform(
        F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (slot(i) != slot(F.greatest(i - 1, F.lit(0))))),
        lambda i: F.struct(slot(i).alias("slot"), signature(i).alias("sig")),
    )
    return (
        df.withColumn("_om_kmers", _kmers(F.coalesce(F.col(text), F.lit("")), k))
        .withColumn(
            "_om_order",
            F.sort_array(
                F.transform(
                    kmers,
                    lambda x, i: x.bitwiseAND(F.lit(~PLACE_MASK)).bitwiseOR(i.cast("long").bitwiseAND(place)),
                )
            ),
        )
        .withColumn(
            "_om_repeats",
            F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(2)) - 1), lambda i: (i < n) & _same(order, i))),
        )
        .withColumn(
            "_om_order", F.when(F.col("_om_repeats") == 0, order).otherwise(_numbered(order, F.col("_om_repeats")))
        )
        .withColumn(name, F.when(n > 0, let(opening, spread)).otherwise(F.array().cast("array<int>")))
        .drop("_om_kmers", "_om_order", "_om_repeats")
    )


def fingerprint(sketch: Column) -> Column:
    """Eight hex digits per slot; empty for an empty sketch."""
    return F.array_join(
        F.transform(sketch, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots; 1 for two empty sketches, 0 if just one is empty."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    both = F.greatest(F.size(a), F.size(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(equal / both)


def with_next(df: DataFrame, key: str, tie: str, **values: str) -> DataFrame:
    """Adds, under each given name, the named column of the row that follows in (``key``, ``tie``).

    The row after the last is the first; null keys come first. The key range is cut in about
    sqrt(rows) stretches; each is sorted on its own, and the first row of a stretch is lent to the
    stretch before, so one exchange is enough and no task sees more than a stretch.
    """
    low, high, rows = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if low is None:
        low = high = 0
    width = max(1, -(-(high - low + 1) // max(1, int(rows**0.5))))
    split = df.withColumn("_nx_part", F.coalesce(F.expr(f"(`{key}` - {low}L) div {width}L"), F.lit(-1)))
    along = Window.orderBy("_nx_part")
    # About sqrt(rows) rows of three longs, so they can be sorted in one task and broadcast.
    borders = (
        split.groupBy("_nx_part")
        .agg(F.min(key).alias("_nx_first"))
        .select(
            F.col("_nx_part").alias("_nx_of"),
            "_nx_first",
            F.coalesce(
                F.lag("_nx_part").over(along),
                F.max("_nx_part").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            ).alias("_nx_before"),
        )
    )
    lent = split.join(F.broadcast(borders), F.col("_nx_part") == F.col("_nx_of")).select(
        *split.columns,
        F.posexplode(
            F.when(
                F.col(key).eqNullSafe(F.col("_nx_first")), F.array("_nx_part", "_nx_before")
            ).otherwise(F.array("_nx_part"))
        ).alias("_nx_lent", "_nx_home"),
    )
    following = Window.partitionBy("_nx_home").orderBy("_nx_lent", key, tie)
    return (
        lent.withColumns({name: F.lead(of).over(following) for name, of in values.items()})
        .filter("_nx_lent = 0")
        .drop("_nx_part", "_nx_lent", "_nx_home")
    )


def edited_likeness(docs: DataFrame, k: int = 3, ell: int = 2, slots: int = 64) -> DataFrame:
    """Fingerprint of each text and of the text with its last quarter replaced, and how alike they are.

    The last floor(n/4) code points give way to the first as many of the next document in ``doc_id``
    order. Null texts count as empty; two empty texts are fully alike; a table of one document is its
    own neighbour; repeated rows each get a row; an empty table gives an empty result. Other columns
    are not read.
    """
    shape = {"k": k, "ell": ell, "slots": slots}
    own = with_sketch(docs.select("doc_id", text_or_empty().alias("text")), "text", "_sketch", **shape)
    paired = with_next(own, "doc_id", "text", _next_text="text", _next_sketch="_sketch")
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = paired.withColumn("n_chars", n.cast("long")).withColumn(
        "_edited", F.concat(F.left("text", n - quarter), F.left("_next_text", quarter))
    )
    return with_sketch(edited, "_edited", "_edited_sketch", **shape).select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_sketch")).alias("fingerprint"),
        fingerprint(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next_sketch")).alias("near_next"),
    )
