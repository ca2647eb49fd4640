"""Global ranks and running sums without a single ordered task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphtrails.scratch import Scratch

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low bits


def _ranged(df: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """Range-partitioned, sorted and written, with partition ``_p`` and row number ``_i`` inside it.

    Written before anything is derived from the partition numbers: the range bounds come from a
    sample and may differ in another run of the same plan.
    """
    mark = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", mark)
    return (
        scratch.save(placed, "ranged")
        .withColumn("_p", F.shiftright("_m", _ROW_BITS))
        .withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_m")
    )


def _offsets(sizes: DataFrame) -> DataFrame:
    """Running sum over partitions; one row per shuffle partition, so its size is a setting."""
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))


def dense_rank(df: DataFrame, order: list[Column], out: str, scratch: Scratch, start: int = 1) -> DataFrame:
    """Number all rows in ``order``, from ``start``. ``order`` must be a strict order."""
    ranged = _ranged(df, order, scratch)
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    return (
        ranged.join(_offsets(sizes), "_p")
        .withColumn(out, F.col("_base") + F.col("_i") + F.lit(start))
        .drop("_p", "_i", "_base")
    )


def prefix_sum(df: DataFrame, order: list[Column], value: str, out: str, scratch: Scratch) -> DataFrame:
    """Sum of ``value`` over all earlier rows in ``order``."""
    ranged = _ranged(df, order, scratch)
    sizes = ranged.groupBy("_p").agg(F.sum(value).alias("_n"))
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(_offsets(sizes), "_p")
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_p", "_i", "_base", "_inside")
    )
