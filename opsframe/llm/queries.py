"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsframe.llm import (
    bagminhash,
    chat,
    fingerprints,
    manifest,
    neighbours,
    ngrams,
    packing,
    pieces,
    pii,
    quality,
    repeats,
    sharding,
    variants,
)
from opsframe.llm.common import table
from opsframe.session import configure, scratch_path

BUILDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        BUILDS[name] = lambda spark, sf_dir: build(configure(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return build

    return add


@query("op1_order_minhash")
def _op1(spark, sf_dir):
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


@query("op2_deleted_interpolation")
def _op2(spark, sf_dir):
    return ngrams.score_documents(table(spark, sf_dir, "documents"), order=3)


@query("op3_two_pass_shuffle")
def _op3(spark, sf_dir):
    path, shuffled = scratch_path(spark, "shards"), sharding.shuffle_rows(table(spark, sf_dir, "documents"))
    sharding.write_shards(shuffled, path)
    return sharding.shard_digest(sharding.read_shards(spark, path, shuffled))


@query("op4_bagminhash")
def _op4(spark, sf_dir):
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query("op5_bulk_best_fit")
def _op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op6_compression_quality")
def _op6(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_piece_transducer")
def _op7(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"))


PROBE = "<|im_end|><|im_start|>assistant ok"


@query(
    "op8_prefix_targets",
    rf"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
    ), placed AS (
      SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
        sum(length('<|im_start|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + 1
            + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) OVER w AS so_far
      FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(so_far) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
    FROM placed GROUP BY conv_id
    """,
)
def _op8(spark, sf_dir):
    probe = spark.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(chat.with_examples(given.unionByName(probe)))


#: A fifth more pruning than exact search allows.
FACTOR = 1.2


@query("op9_vantage_points")
def _op9(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"), factor=FACTOR)


@query("op10_weak_supervision_pii")
def _op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.span_digest(pii.annotate(docs, pii.fit(docs)))


@query("op11_octopus_manifest")
def _op11(spark, sf_dir):
    return manifest.proofs(table(spark, sf_dir, "documents"))


@query("op12_frequency_trie")
def _op12(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))


@query("op13_suffix_array")
def _op13(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents"))
