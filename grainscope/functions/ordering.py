"""Ranks and running totals over one long order, without a one-task window.

A window without a (fine) partition key sorts everything in one task. Here rows are
first put into order-preserving buckets, the window runs per bucket, and the bucket
totals, at most ``buckets + 1`` rows per partition value, supply the offsets. Bucket
borders come from a sample fixed by a hash of the order value; they affect balance only,
never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainscope.session import settle

_PER_BUCKET = 16


def order_buckets(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_order_bucket(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``: number of border values below the row's order value.

    The borders are every 16th of the ``16 * buckets`` distinct values with the smallest hash, so the broadcast side
    is one row of bounded size, and a value that many groups share counts once.
    """
    buckets = buckets or order_buckets(df)
    sample = (df.select(F.col(order).alias("_o")).distinct()
              .orderBy(F.xxhash64("_o"), "_o").limit(buckets * _PER_BUCKET)
              .agg(F.array_sort(F.collect_list("_o")).alias("_sample")))
    borders = sample.select(F.expr(
        f"filter(_sample, (c, i) -> (i + 1) % {_PER_BUCKET} = 0)").alias("_borders"))
    return (df.crossJoin(F.broadcast(borders))
            .withColumn("_bucket", F.size(F.filter("_borders", lambda c: c < F.col(order))))
            .drop("_borders"))


def running_totals(df: DataFrame, order: str, totals: dict[str, Column],
                   partition: Sequence[str] = (), descending: bool = False,
                   bucket: Column | None = None, buckets: int | None = None,
                   stored: bool = False) -> DataFrame:
    """Inclusive running sums along ``order`` within ``partition``.

    Borders, offsets and the sums themselves each read the input, so it is checkpointed
    first (one job) unless it is a ``stored`` table.

    ``order`` should be unique within a partition (aggregate ties first). ``bucket`` may
    give an order-preserving bucket directly, as for a hash order, which saves the sample.
    """
    part = list(partition)
    df = df if stored else settle(df)
    if bucket is None:
        rows = with_order_bucket(df, order, buckets)
    else:
        rows = df.withColumn("_bucket", bucket)
    for name, col in totals.items():
        rows = rows.withColumn(name, col)
    towards = F.desc if descending else F.asc
    inside = (Window.partitionBy(*part, "_bucket").orderBy(towards(order))
              .rowsBetween(Window.unboundedPreceding, 0))
    earlier = (Window.partitionBy(*(part or [F.lit(0)])).orderBy(towards("_bucket"))
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(*part, "_bucket").agg(
        *[F.sum(name).alias(f"_sum_{name}") for name in totals])
    offsets = offsets.select(*part, "_bucket", *[
        F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_off_{name}")
        for name in totals])
    for name in totals:
        rows = rows.withColumn(name, F.sum(name).over(inside))
    joined = rows.join(offsets, [*part, "_bucket"])
    for name in totals:
        joined = joined.withColumn(name, F.col(name) + F.col(f"_off_{name}"))
    return joined.drop("_bucket", *[f"_off_{name}" for name in totals])


def ranked(df: DataFrame, order: str, name: str = "rn", partition: Sequence[str] = (),
           descending: bool = False, bucket: Column | None = None) -> DataFrame:
    """Row number along a unique order, starting at 1."""
    return running_totals(df, order, {name: F.lit(1).cast("long")}, partition, descending, bucket)


def hash_ranked(df: DataFrame, hash_hex: str, name: str = "rn",
                partition: Sequence[str] = ()) -> DataFrame:
    """Row number along a hexadecimal digest: its leading digits are even buckets."""
    digits = 2
    while 16 ** digits < order_buckets(df):
        digits += 1
    return ranked(df, hash_hex, name, partition, bucket=F.substring(hash_hex, 1, digits))
