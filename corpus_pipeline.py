"""From raw documents to packed training sequences, as stages of DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import bagminhash, packing, pii, quality
from opsframe.llm.common import landed, table
from opsframe.session import configure

#: Columns of ``documents``, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose text the compression classifier scores below one half.

    The classifier learns from all labelled documents, and labels are used for nothing else.
    """
    model = quality.train(docs, table(configure(spark), sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("score") >= 0.5).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near-duplicates.

    Of repeated rows of that document one stays; documents with a null text or doc_id all stay.
    """
    configure(spark)
    firsts = bagminhash.near_duplicates(docs).filter("doc_id = class_id").select("doc_id").distinct()
    whole = F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    kept = (
        docs.filter(whole)
        .join(firsts, "doc_id", "left_semi")
        .withColumn("_text", F.xxhash64("text"))
        .dropDuplicates(["doc_id", "_text"])
        .select(*COLUMNS)
    )
    return kept.unionByName(docs.filter(~whole).select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of personal data in its place; ``n_chars`` follows the new text."""
    configure(spark)
    marked = pii.annotate(docs, pii.fit(docs))
    return (
        marked.withColumn("text", pii.mask(F.col("text"), F.col("pii")))
        .withColumn("n_chars", F.when(F.size("pii") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*COLUMNS)
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    configure(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_each),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Dictionaries, signatures and vote weights have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
