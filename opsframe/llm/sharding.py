"""Two-pass external shuffle: scatter rows over memory-sized buckets, then shuffle each bucket.

Pass one sends each row to a bucket by a seeded hash of its key and text. Pass two numbers the rows of a
bucket in a fixed order and permutes these numbers with a Fisher-Yates shuffle, whose draws are
seeded hashes too. A bucket's place in the whole order comes from the sizes of those before it, so
the global position is known without a global sort. All draws depend on the seed and the rows only:
a task that runs again after an executor is lost gives the same positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.llm.common import text_or_empty

LAW = "rows"
#: Buckets that one task of the second pass shuffles, one after the other.
BUCKETS_PER_TASK = 4


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """A uniform permutation of 0..n-1 as an array; element i changes place with a drawn earlier one."""

    def step(placed: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        moved = F.concat(
            F.slice(placed, 1, j), F.array(i), F.slice(placed, j + 2, i - j - 1), F.array(F.get(placed, j))
        )
        return F.when(j == i, F.array_append(placed, i)).otherwise(moved)

    start = F.array().cast("array<int>")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step)).otherwise(start)


def shuffle_rows(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 17,
    shards: int = 8,
    bucket_bytes: int = 8 << 20,
    bucket_rows: int = 1024,
) -> DataFrame:
    """All columns of ``df`` plus ``size``, ``shard`` and ``slot`` (0-based, gapless in the shard).

    Shards are consecutive stretches of the shuffled order, so their row counts differ by one at
    most. ``size`` is the text's UTF-8 bytes plus 1 (null text: 1). Columns of ``df`` of those names
    are replaced. Null and repeated keys are ordinary rows; rows that are equal in key and text are
    interchangeable. Rows of one key are spread by their texts; only rows that are equal in both share a
    bucket. An empty table gives an empty result.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    held, rows = df.agg(F.sum(size), F.count(F.lit(1))).first()
    buckets = max(1, -(-(held or 0) // bucket_bytes), -(-rows // bucket_rows))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(buckets)).cast("long")

    # Buckets lie in the order of the tasks that hold them, so a task's rows are one stretch of the
    # shuffled order and can be written where they are.
    tasks = -(-buckets // BUCKETS_PER_TASK)
    task = F.pmod(F.hash("_sh_bucket"), F.lit(tasks))
    before = Window.orderBy(task, "_sh_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (  # one row per bucket; reads keys and texts only
        df.select(bucket.alias("_sh_bucket"))
        .groupBy("_sh_bucket")
        .agg(F.count(F.lit(1)).cast("int").alias("_sh_n"))
        .withColumn("_sh_base", F.coalesce(F.sum("_sh_n").over(before), F.lit(0)))
        .repartition(tasks, "_sh_bucket")
        .select(
            "_sh_bucket", "_sh_base", fisher_yates(F.col("_sh_n"), F.lit(seed), F.col("_sh_bucket")).alias("_sh_order")
        )
    )
    inside = Window.partitionBy("_sh_bucket").orderBy(key, F.xxhash64(text), text)
    scattered = (
        df.drop("size", "shard", "slot")
        .withColumn("_sh_bucket", bucket)
        .withColumn("size", size)
        .repartition(tasks, "_sh_bucket")
        .withColumn("_sh_row", F.row_number().over(inside) - 1)
    )
    position = F.col("_sh_base") + F.col("_sh_order")[F.col("_sh_row")]
    first_of_shard = F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")
    return (
        scattered.join(plan, "_sh_bucket")
        .withColumn("_sh_at", position.cast("long"))
        .withColumn("shard", F.expr(f"cast((_sh_at * {shards}) div {max(rows, 1)}L as int)"))
        .withColumn("slot", F.col("_sh_at") - first_of_shard)
        .drop("_sh_bucket", "_sh_base", "_sh_order", "_sh_row", "_sh_at")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes one folder per shard; the files of a folder, in name order, hold its rows in slot order.

    ``shuffled`` is what ``shuffle_rows`` gives: its tasks hold consecutive stretches already, so rows
    are only put in order within their task and no second exchange is needed.
    """
    ordered = shuffled.sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, shuffled: DataFrame) -> DataFrame:
    """The rows of ``write_shards``, with the columns of what was written."""
    return spark.read.schema(shuffled.schema).parquet(path).select(shuffled.columns)


def shard_digest(shuffled: DataFrame, text: str = "text") -> DataFrame:
    return shuffled.select(
        "doc_id",
        "size",
        F.crc32(F.encode(text_or_empty(text), "UTF-8")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
