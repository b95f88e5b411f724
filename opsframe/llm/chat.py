"""Prefix-target expansion: each assistant turn becomes a training example of its own.

An example holds all turns up to and with its target; only the text of the target is trainable. A
turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts are escaped
reversibly: ``<``, any number of backslashes and ``|`` get one backslash more, so ``<|`` never
stands in an escaped text; a line feed in a role is written ``<|nl|>``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Characters of examples from which a conversation is split.
PER_PART = 1 << 28


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def render(turn: Column | Mapping[str, Column]) -> Column:
    role = F.replace(escape(turn["role"]), F.lit("\n"), F.lit(LINE))
    return F.concat(F.lit(START), role, F.lit("\n"), escape(turn["text"]), F.lit(END))


def with_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: ``conv_id``, ``example`` (0-based in the conversation), ``formatted``,
    ``target`` (0-based turn or null), ``loss_start`` and ``loss_end`` (code point offsets of the
    trainable text, end exclusive), ``last`` (is it the conversation's last example).

    Turns after the last assistant turn, or all turns of a conversation without one, come as a last
    example with nothing trainable, so that no turn is lost. Turns are ordered by ``turn`` (nulls
    first), then role and text; null roles and texts are empty; repeated rows are turns of their own;
    rows without ``conv_id`` form one conversation. Other columns are not read. The text of an example
    grows with its prefix, which is what the format asks for; no row holds more than the longest
    example. The examples of a conversation are dealt to parts of about ``PER_PART`` characters, each
    written in a task of its own from a copy of the turns.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("_trains", F.col("role") == "assistant")
    written = render({"role": F.col("role"), "text": F.col("text")})
    sized = turns.withColumn("_chars", F.char_length(written))
    # A conversation of more than one part takes over 90,000 characters (C characters hold at most
    # C / 33 assistant turns), so this table has at most a row of two numbers for each 90 KB of turns.
    split = (
        sized.groupBy(F.col("conv_id").alias("_of"))
        .agg((F.sum("_chars") * (F.count_if("_trains") + 1) / PER_PART).cast("int").alias("_parts"))
        .filter("_parts > 0")
    )
    dealt = (
        turns.join(split, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
        .withColumn("_parts", F.coalesce("_parts", F.lit(0)))
        .withColumn("_part", F.explode(F.sequence(F.lit(0), "_parts")))
    )
    order = Window.partitionBy("conv_id", "_part").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.select(
        "conv_id", "_part", "_parts", "_trains",
        (F.row_number().over(order) - 1).alias("place"),
        F.sum(F.char_length(written)).over(so_far).cast("int").alias("end"),
        F.count_if("_trains").over(so_far).cast("int").alias("trained"),
        F.char_length(escape(F.col("text"))).alias("chars"),
        written.alias("written"),
    )
    turn = F.struct("place", "end", "trained", "chars", F.col("_trains").alias("trains"), "written")
    gathered = placed.groupBy("conv_id", "_part", "_parts").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    last = F.size("_turns") - 1
    spot = lambda t: F.struct(
        t["place"].alias("place"), t["end"].alias("end"), t["trained"].alias("trained"), t["chars"].alias("chars"),
        t["trains"].alias("trains"), (t["place"] == last).alias("last"),
    )
    here = lambda t: (t["trains"] | (t["place"] == last)) & (t["place"] % (F.col("_parts") + 1) == F.col("_part"))
    exploded = gathered.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["written"]), "").alias("_whole"),
        F.explode(F.transform(F.filter("_turns", here), spot)).alias("_spot"),
    ).select("conv_id", "_whole", "_spot.*")
    close = F.col("end") - len(END)
    return exploded.select(
        "conv_id",
        F.when(F.col("trains"), F.col("trained") - 1).otherwise(F.col("trained")).alias("example"),
        F.substring("_whole", 1, F.col("end")).alias("formatted"),
        F.when(F.col("trains"), F.col("place")).alias("target"),
        F.when(F.col("trains"), close - F.col("chars")).alias("loss_start"),
        F.when(F.col("trains"), close).alias("loss_end"),
        "last",
    )


def expand(conversations: DataFrame) -> DataFrame:
    """``with_examples`` without its last column."""
    return with_examples(conversations).drop("last")


def parse(formatted: Column) -> Column:
    """The turns of an example, as (role, text)."""
    written = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda part: part != "")

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        role = unescape(F.replace(F.substring(head, len(START) + 1, F.char_length(head)), F.lit(LINE), F.lit("\n")))
        text = unescape(F.substring(part, F.char_length(head) + 2, F.char_length(part)))
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(written, turn)


def chat_digest(examples: DataFrame) -> DataFrame:
    """What can be read back from the examples of each conversation; input from ``with_examples``.

    Each example is read on its own; of it only what it trains on is kept, so that a row holds no more
    than one conversation's trainable text.
    """
    lines = F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    held = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    read = examples.withColumn("_read", F.when(F.col("last"), parse(F.col("formatted")))).select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("chars"),
        F.when(F.col("target").isNotNull(), F.struct("example", unescape(held).alias("text"))).alias("trained"),
        F.when(F.col("last"), F.size("_read").cast("long")).alias("n_turns"),
        F.when(F.col("last"), F.sha2(F.array_join(lines, ""), 256)).alias("turns_sha256"),
    )
    folded = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list("trained")), lambda t: t["text"]), "").alias("_trained"),
    )
    return folded.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("_trained").cast("long").alias("loss_chars"),
        F.sha2("_trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )
