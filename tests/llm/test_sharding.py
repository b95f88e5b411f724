from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opsframe.llm import queries, sharding


def test_fisher_yates_is_a_permutation_and_uniform(spark):
    df = spark.range(3000).select(sharding.fisher_yates(F.lit(4), F.lit(1), F.col("id")).alias("p"))
    seen = Counter(tuple(r.p) for r in df.collect())
    assert len(seen) == 24 and all(sorted(p) == [0, 1, 2, 3] for p in seen)
    assert max(seen.values()) < 180 and min(seen.values()) > 80
    small = spark.range(1).select(sharding.fisher_yates(F.lit(0), F.lit(1)), sharding.fisher_yates(F.lit(1), F.lit(1))).first()
    assert small[0] == [] and small[1] == [0]


def test_fisher_yates_against_swaps(spark):
    draws = [r[0] for r in spark.range(50).select(F.pmod(F.xxhash64(F.lit(7), F.col("id").cast("int")), F.col("id") + 1)).collect()]
    placed = []
    for i, j in enumerate(draws):
        placed.append(i)
        placed[i], placed[j] = placed[j], i
    assert spark.range(1).select(sharding.fisher_yates(F.lit(50), F.lit(7))).first()[0] == placed


@pytest.mark.parametrize("shape", [{}, {"bucket_rows": 3}, {"shards": 3, "bucket_bytes": 100}])
def test_every_row_has_one_place(docs, odd, shape):
    for df in (docs, odd):
        rows = sharding.shuffle_rows(df, **shape).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r["size"] == len((r.text or "").encode()) + 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[s]) for s in range(shape.get("shards", 8))]
        assert max(counts) - min(counts) <= 1
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())


def test_seeds_files_and_partitions(spark, docs, tmp_path):
    place = lambda **k: {(r.doc_id, r.shard, r.slot) for r in sharding.shuffle_rows(docs, **k).collect()}
    one = place()
    assert one == {(r.doc_id, r.shard, r.slot) for r in sharding.shuffle_rows(docs.repartition(5)).collect()}
    assert len(one & place(seed=18)) < 20
    sharding.write_shards(sharding.shuffle_rows(docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == one


def test_empty_and_clashing(none, odd):
    assert sharding.shard_digest(sharding.shuffle_rows(none)).count() == 0
    wide = odd.withColumns({"size": F.lit(1), "shard": F.lit("x"), "slot": F.lit("y")})
    same = sharding.shard_digest(sharding.shuffle_rows(odd))
    assert sharding.shard_digest(sharding.shuffle_rows(wide)).exceptAll(same).count() == 0


def test_hot_key(spark):
    hot = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shuffle_rows(hot, bucket_rows=50).collect()
    assert len({(r.shard, r.slot) for r in rows}) == 900


def test_one_key_with_many_texts_is_spread(spark):
    hot = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sharding.shuffle_rows(hot, bucket_rows=50).collect()
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    buckets = [r[0] for r in hot.select(F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(60))).collect()]
    assert max(Counter(buckets).values()) < 100
    at = {r.text: i for i, r in enumerate(order)}
    by_bucket = defaultdict(list)
    for i, b in enumerate(buckets):
        by_bucket[b].append(at[str(i)])
    # Each bucket is one stretch of the whole order, so no key fills one.
    assert all(max(p) - min(p) == len(p) - 1 for p in by_bucket.values())


def test_query_reads_its_shards_back(spark, sf_dir, docs):
    out = queries.BUILDS["op3_two_pass_shuffle"](spark, sf_dir)
    files = out.inputFiles()
    assert files and all("/shards-" in f and "/shard=" in f for f in files)
    same = sharding.shard_digest(sharding.shuffle_rows(docs))
    assert out.exceptAll(same).count() == 0 and out.count() == docs.count()


def test_files_hold_stretches_in_order(spark, docs, tmp_path):
    """Several tasks and buckets: the files of a shard by name, each in slot order, follow on each other."""
    sharding.write_shards(sharding.shuffle_rows(docs, shards=3, bucket_rows=9), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).select("shard", "slot", F.input_file_name().alias("file"))
    files = defaultdict(list)
    for r in back.collect():
        files[r.shard, r.file.rsplit("/", 1)[1]].append(r.slot)
    assert len(files) > 3
    for shard in range(3):
        runs = [slots for (s, _), slots in sorted(files.items()) if s == shard]
        assert [x for run in runs for x in sorted(run)] == list(range(sum(map(len, runs))))
        assert all(run == sorted(run) for run in runs)
