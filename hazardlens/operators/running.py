"""Running sums and last values over a total order, without a single-partition window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.session import scratch_path


def _ranged(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``order`` to partitions ``__pid``, written and read back.

    Written before it is read on two branches: range boundaries are sampled
    anew on each execution, so rows and totals must come from the same one.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, f"ranged-{uuid.uuid4().hex}")
    ranged = df.repartitionByRange(parts, *order).withColumn("__pid", F.spark_partition_id())
    ranged.write.parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def running_sums(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """``df`` with, per (name -> column) of ``sums``, the column's sum over all
    rows up to and including this one.

    Rows are range-partitioned on the order (partition i holds the i-th key
    range), summed inside their partition, and shifted by the totals of
    earlier partitions - one small row per partition. The order must be total
    (unique keys), as it is for distinct values.
    """
    ranged = _ranged(df, order)
    totals = ranged.groupBy("__pid").agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = totals.select("__pid", *[F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__{name}") for name in sums])
    inside = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(name) for name, c in sums.items()])
    return (local.join(F.broadcast(before), "__pid")
            .select(*df.columns, *[(F.col(name) + F.col(f"__{name}")).alias(name) for name in sums]))


def running_last(df: DataFrame, order: list, value: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``: the last non-null ``value`` of any row up to and
    including this one.

    Like ``running_sums``: a range partition finds its own last values, and the
    last value of the partitions before it is carried in - one small row per
    partition. No key decides where rows go, so no key can be too hot.
    """
    ranged = _ranged(df, order, parts)
    inside = Window.partitionBy("__pid").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", F.last(value, ignorenulls=True).over(upto).alias("__local"))
    # The last value of a partition is that of its last row with a value.
    newest = (ranged.where(F.col(value).isNotNull()).select("__pid", value, F.row_number().over(
        Window.partitionBy("__pid").orderBy(*[_reverse(c) for c in order])).alias("__nth"))
        .where("__nth = 1").select("__pid", F.col(value).alias("__end")))
    pids = ranged.select("__pid").distinct()
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = pids.join(newest, "__pid", "left").select("__pid", F.last("__end", ignorenulls=True).over(earlier).alias("__in"))
    return (local.join(F.broadcast(carried), "__pid")
            .select(*df.columns, F.coalesce("__local", "__in").alias(out)))


def _reverse(column: str):
    return F.col(column).desc()
