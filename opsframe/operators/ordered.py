"""Ordered building blocks that never put a whole key in one task.

A plain window over a hot key sorts all of its rows in one task. Here the key is first split into
consecutive *buckets* of its order column; each bucket is handled on its own and the buckets are
tied together with one pre-aggregated row each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES_PER_BUCKET = 65_536
SALTS = 256


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join on ``keys`` in which NULL meets NULL; the keys come out once."""
    other = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    met = [left[key].eqNullSafe(other[f"_right_{key}"]) for key in keys]
    return left.join(other, met).drop(*(f"_right_{key}" for key in keys))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    value: Column,
    name: str,
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``.

    ``bucket`` must not decrease along the order (or not increase, when ``descending``); only rows
    of one bucket are sorted together, and earlier buckets come in as one pre-summed number.
    """
    keys = list(keys)
    direction = F.desc if descending else F.asc
    slotted = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy(direction("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = (
        slotted.groupBy(*keys, "_bucket")
        .agg(F.sum(value).alias("_bucket_sum"))
        .withColumn("_base", F.coalesce(F.sum("_bucket_sum").over(earlier), F.lit(0)))
        .drop("_bucket_sum")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = slotted.withColumn("_inside", F.sum(value).over(inside))
    return (
        join_null_safe(local, base, [*keys, "_bucket"])
        .withColumn(name, F.col("_inside") + F.col("_base"))
        .drop("_bucket", "_inside", "_base")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    values: Sequence[str],
    name: str = "previous",
) -> DataFrame:
    """Adds ``name``, a struct of the row before's ``values`` in its key (NULL on the first).

    ``bucket`` must not decrease along the order. Inside a bucket this is a plain lag; the first row
    of a bucket takes the last one of the bucket before from a table with one row per bucket.
    """
    keys = list(keys)
    slotted = df.withColumn("_bucket", bucket)
    picked = F.struct(*values)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    along = Window.partitionBy(*keys).orderBy("_bucket")
    last = slotted.groupBy(*keys, "_bucket").agg(F.max_by(picked, F.struct(*order)).alias("_last"))
    edges = last.select(*keys, "_bucket", F.lag("_last").over(along).alias("_edge"))
    local = slotted.withColumn("_inside", F.lag(picked).over(inside))
    return (
        join_null_safe(local, edges, [*keys, "_bucket"])
        .withColumn(name, F.coalesce("_inside", "_edge"))
        .drop("_bucket", "_inside", "_edge")
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "seq"
) -> DataFrame:
    """Dense 0-based position of each row within its key."""
    counted = running_total(df, keys, order, bucket, F.lit(1), name)
    return counted.withColumn(name, (F.col(name) - 1).cast("long"))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` first rows of each key; ``order`` must be total.

    Three cuts to ``n`` rows per key: in each map task, in each of a few hundred groups of map
    tasks, and of what is left. The grouping does not change the answer, only where it is found.
    """
    salted = df.withColumn("_salt", F.spark_partition_id() % SALTS)
    for group in ([*keys, "_salt"], list(keys)):
        position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        salted = salted.withColumn("_pos", position).filter(F.col("_pos") <= n).drop("_pos")
    return salted.drop("_salt")


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Column,
    value: str,
    found: Callable[[Column], Column],
    name: str = "next",
) -> DataFrame:
    """Adds ``name``: ``found(value)`` of the row after in its key (NULL on the last).

    ``bucket`` must not decrease along the order; which buckets or numbers are present does not
    matter. Inside a bucket this is a plain lead, after one exchange; the last row of a bucket takes
    the first one of the next bucket there is from a table with one row per bucket.
    """
    keys = list(keys)
    slotted = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    along = Window.partitionBy(*keys).orderBy("_bucket")
    first = slotted.groupBy(*keys, "_bucket").agg(F.min_by(F.struct(value), F.struct(order)).alias("_first"))
    edges = first.select(*keys, "_bucket", F.lead("_first").over(along).alias("_edge"))
    local = slotted.withColumn(name, found(F.col(value)))
    local = local.withColumn("_inside", F.lead(F.struct(name)).over(inside))
    joined = join_null_safe(local, edges, [*keys, "_bucket"])
    return joined.withColumns({
        f"{name}_own": F.col(name),
        name: F.when(F.col("_inside").isNotNull(), F.col(f"_inside.{name}")).otherwise(found(F.col(f"_edge.{value}"))),
    }).drop("_bucket", "_inside", "_edge")
