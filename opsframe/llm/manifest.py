"""Merkle manifest of a dataset: a tree of eight-fold nodes per language, one more over their roots.

Every row is a leaf. Leaves are put in order and numbered, so that a *block* of 4,096 of them is one
whole subtree. Tops of blocks are folded into the upper nodes, eight times fewer per level.

Proofs come as multiproofs. A block computes which nodes its leaves together miss (no node twice,
none that its own leaves give), fetches those in one join, derives the interior nodes that its leaves
share once, and reads the proof of each leaf off them. A block costs about seven fetched nodes per
level above it, however many leaves it has.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.llm.common import landed

FAN = 8
#: Levels of a block's subtree, which has FAN ** DEPTH leaves.
DEPTH = 4
BLOCK = FAN**DEPTH
#: Blocks that read one copy of an upper node; nodes wanted by more are read in copies.
READERS = 1_024
_ID = ("tree", "block")


def h(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """sha256 of the five values, each as its UTF-8 byte count, a colon and the value, or ``-`` if null."""
    def part(value: Column) -> Column:
        shown = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.sha2(F.concat(*(part(c) for c in (doc_id, source, lang, n_chars, text))), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row's text is folded to lower case before its proof is checked."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def height(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def missing(leaves: Iterable[int], size: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that the proofs of ``leaves`` need and that these don't give."""
    known, level, out = set(leaves), 0, []
    while size > 1:
        parents = {i // FAN for i in known}
        for p in sorted(parents):
            out += [(level, i) for i in range(p * FAN, min(p * FAN + FAN, size)) if i not in known]
        known, level, size = parents, level + 1, -(-size // FAN)
    return out


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``idx``, the place in its ``tree``, and ``size``, the leaves of that tree.

    One range exchange over all trees; ranges are cut by counts, so neither a large tree nor rows
    equal in all of ``order`` (their input position tells them apart) meet in one task.
    """
    row = F.monotonically_increasing_id()
    ranged = leaves.withColumn("_row", row).repartitionByRange("tree", *order, "_row")
    ranged = ranged.sortWithinPartitions("tree", *order, "_row").withColumn("_part", F.spark_partition_id())
    kept = ranged.drop("_row")
    schema = T.StructType([*kept.schema.fields, T.StructField("_at", T.LongType())])

    def number(batches):
        tree, at = None, 0
        for batch in batches:
            places = []
            for t in batch.column("tree").to_pylist():
                tree, at = (tree, at + 1) if t == tree else (t, 0)
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "_at"]
            )

    rows = landed(kept.mapInArrow(number, schema), "leaves")
    counts = rows.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("tree").orderBy("_part")) - F.col("_n")
    sizes = F.sum("_n").over(Window.partitionBy("tree"))
    offsets = counts.select("tree", "_part", before.alias("_before"), sizes.alias("size"))
    numbered = rows.join(offsets, ["tree", "_part"]).withColumn("idx", F.col("_before") + F.col("_at"))
    return landed(numbered.withColumn("block", F.floor(F.col("idx") / BLOCK)).drop("_before", "_at", "_part"), "placed")


def _fold(digests: list[str], levels: int) -> list[list[str]]:
    """The levels of a subtree, its leaves first."""
    out = [digests]
    for _ in range(levels):
        last = out[-1]
        out.append([h(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return out


def _summary(key, rows):
    """The top of a block, and the coordinates of the nodes that its leaves miss."""
    tree, block = (k.as_py() for k in key)
    rows = rows.sort_by("idx")
    size = rows.column("size")[0].as_py()
    levels = min(DEPTH, height(size))
    top = _fold(rows.column("digest").to_pylist(), levels)[-1][0]
    wants = missing(rows.column("idx").to_pylist(), size)
    n = 1 + len(wants)
    return pa.table({
        "tree": [tree] * n, "block": [block] * n, "size": [size] * n,
        "level": [levels, *(level for level, _ in wants)], "idx": [block, *(i for _, i in wants)],
        "digest": pa.array([top] + [None] * len(wants), pa.string()),
    })


_SUMMARY = "tree string, block long, size long, level long, idx long, digest string"


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, fetched) of ``placed`` leaves with their ``digest``.

    ``roots``: tree, size and root. ``fetched``: per block (tree, block) the nodes (level, idx,
    digest) that it misses.
    """
    # Every block hashes and asks by itself; a node of the levels above is one row.
    summary = landed(
        leaves.select("tree", "block", "size", "idx", "digest").groupBy(*_ID).applyInArrow(_summary, _SUMMARY), "blocks"
    )
    level = landed(summary.filter("digest IS NOT NULL").select("tree", "size", "level", "idx", "digest"), "tops")
    nodes = level
    width = leaves.agg(F.max("size")).first()[0] or 0
    for at in range(DEPTH, height(width)):
        runs = level.filter(F.ceil(F.col("size") / FAN**at) > 1).groupBy(
            "tree", "size", F.floor(F.col("idx") / FAN).alias("run")
        )
        members = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x.digest)
        level = landed(
            runs.agg(F.sha2(F.concat_ws("", members), 256).alias("digest")).select(
                "tree", "size", F.lit(at + 1).cast("long").alias("level"), F.col("run").alias("idx"), "digest"
            ),
            "level",
        )
        nodes = nodes.unionByName(level)
    # A root is a top of its own tree: the only node of its level.
    tall = sum(((F.col("size") > FAN**k).cast("int") for k in range(21)), F.lit(0))
    roots = nodes.filter(F.col("level") == tall).select("tree", "size", F.col("digest").alias("root"))
    asked = summary.filter("digest IS NULL").select("tree", "block", "size", "level", "idx")
    below = F.least(F.pow(F.lit(float(FAN)), F.col("level") + 1 - DEPTH), F.ceil(F.col("size") / BLOCK))
    copies = F.greatest(F.lit(1), F.ceil(below / READERS)).cast("long")
    fetched = asked.withColumn("_copy", F.col("block") % copies).join(
        nodes.select("tree", "level", "idx", "digest", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("_copy")),
        ["tree", "level", "idx", "_copy"],
    )
    return roots, fetched.select("tree", "block", "level", "idx", "digest")


def _levels(rows: pa.Table, fetched: pa.Table) -> tuple[int, list[dict[int, str]]]:
    """(size, per level the known nodes) of a block: its leaves, what was fetched and what they give."""
    size = rows.column("size")[0].as_py()
    known = [{} for _ in range(height(size) + 1)]
    known[0] = dict(zip(rows.column("idx").to_pylist(), rows.column("digest").to_pylist()))
    for level, i, digest in zip(*(fetched.column(c).to_pylist() for c in ("level", "idx", "digest"))):
        known[level][i] = digest
    width, own = size, set(rows.column("idx").to_pylist())
    for level in range(len(known) - 1):
        own = {i // FAN for i in own}
        for p in own:
            known[level + 1][p] = h(known[level][i] for i in range(p * FAN, min(p * FAN + FAN, width)))
        width = -(-width // FAN)
    return size, known


def _steps(i: int, size: int, known: list[dict[int, str]]) -> list[tuple[str, str]]:
    """Of leaf ``i``, level by level: the digests of its run before it and after it, each as one text."""
    out = []
    for level in range(len(known) - 1):
        low = i // FAN * FAN
        run = [known[level][k] for k in range(low, min(low + FAN, size))]
        out.append(("".join(run[: i - low]), "".join(run[i - low + 1 :])))
        i, size = i // FAN, -(-size // FAN)
    return out


def _paths(key, rows, fetched):
    """For leaves that are roots of other trees: the steps from there to the root."""
    if not rows.num_rows:
        return pa.table({"tree": pa.array([], pa.string()), "steps": pa.array([], _STEPS), "root": pa.array([], pa.string())})
    size, known = _levels(rows, fetched)
    steps = [[{"before": b, "after": a} for b, a in _steps(i, size, known)] for i in rows.column("idx").to_pylist()]
    root = known[-1][0]
    return pa.table({"tree": rows.column("name"), "steps": pa.array(steps, _STEPS), "root": [root] * rows.num_rows})


_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_PATHS = "tree string, steps array<struct<before: string, after: string>>, root string"
_PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def _proofs(key, rows, fetched):
    """The proof of each leaf of a block, and where a changed leaf would lead."""
    out = {name: [] for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
    if not rows.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64())} | {
            k: pa.array([], pa.bool_() if k == "verified" else pa.string()) for k in out
        })
    fetched = fetched.to_pylist()
    path = next(x for x in fetched if x["steps"] is not None)
    nodes = [x for x in fetched if x["steps"] is None]
    size, known = _levels(rows, pa.table({
        "level": pa.array([x["level"] for x in nodes], pa.int64()), "idx": pa.array([x["idx"] for x in nodes], pa.int64()),
        "digest": pa.array([x["digest"] for x in nodes], pa.string()),
    }))
    above = [(s["before"], s["after"]) for s in path["steps"]]

    def up(digest: str, steps: list[tuple[str, str]]) -> str:
        for before, after in steps:
            digest = h((before, digest, after))
        return digest

    subroot, plain = known[-1][0], up(known[-1][0], above)
    for i, digest, other in zip(*(rows.column(c).to_pylist() for c in ("idx", "digest", "changed"))):
        steps = _steps(i, size, known) + above
        folded = plain if other == digest else up(other, steps)
        for name, value in zip(out, (digest, subroot, path["root"], h(b + a for b, a in steps), folded, folded == path["root"])):
            out[name].append(value)
    return pa.table({"doc_id": rows.column("doc_id")} | out)


def proofs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, the root of its language,
    the root of all, the digest of its proof, and whether the proof holds for the row as it may have
    been tampered with (``folded_root`` is what the proof leads to).

    Nulls are leaves' values of their own; null languages are a tree, before all others. Null ids come
    first in a tree. Rows of equal id are ordered by leaf; repeated rows are leaves of their own, with
    equal leaf but proofs of their own, of which any may go to any of them. Empty and very long texts
    are values as others are. An empty table has no proofs. Other columns are not read.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    own = leaf(*columns)
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        own.alias("digest"),
        F.when(tampered(F.col("doc_id")), leaf(*columns[:-1], lower)).otherwise(own).alias("changed"),
    )
    rows = placed(leaves, ["doc_id", "digest"])
    roots, fetched = forest(rows)
    tops = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    trees = placed(landed(tops, "roots"), ["name"])
    _, upper = forest(trees)
    paths = trees.groupBy(*_ID).cogroup(upper.groupBy(*_ID)).applyInArrow(_paths, _PATHS)
    paths = landed(paths, "paths")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("level", "long"), ("idx", "long"), ("digest", "string"))]
    blocks = rows.select(*_ID).distinct()
    given = fetched.withColumns({
        "steps": F.lit(None).cast("array<struct<before: string, after: string>>"), "root": F.lit(None).cast("string")
    }).unionByName(blocks.join(paths, "tree").select(*_ID, *none, "steps", "root"))
    return rows.groupBy(*_ID).cogroup(given.groupBy(*_ID)).applyInArrow(_proofs, _PROOFS)
