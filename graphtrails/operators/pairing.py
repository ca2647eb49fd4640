"""Pairing the darts at every vertex: the links from which all trails are made.

A trail that arrives at a vertex over one dart leaves over its mate. Darts are paired in the order of
the level at which their edge becomes local, so at every level at most one dart of a vertex is open:
the one pairing serves the trails of all levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphtrails.operators.skew import GROUP_ROWS, hot_groups
from graphtrails.scratch import Scratch


def _pair(rows: DataFrame, groups: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    n = F.row_number().over(w)
    first = n % 2 == 1

    def other(name: str) -> Column:
        return F.when(first, F.lead(name).over(w)).otherwise(F.lag(name).over(w))

    return rows.withColumn("mate", other("dart")).withColumn("mate_level", other("level"))


def pair_darts(
    darts: DataFrame, scratch: Scratch | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Add ``mate`` and ``mate_level`` to ``(dart, tail, level, ...)``; null at an odd vertex's last dart.

    A hub's darts are paired inside ``(tail, level, salt)`` first. What is left over, at most one
    dart for each of those groups, is paired in level order.
    """
    hot = hot_groups(darts, ["tail"], group_rows)
    if hot is None:
        return _pair(darts, ["tail"], ["level", "dart"])
    scratch = scratch or Scratch.of(darts.sparkSession)
    salted = (
        darts.join(hot, "tail", "left")
        .withColumn("_hot", F.col("_salts").isNotNull())
        .withColumn("_level", F.when(F.col("_hot"), F.col("level")).otherwise(F.lit(-1)))
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("dart"), F.col("_salts")), F.lit(-1)))
        .drop("_salts")
    )
    once = scratch.save(_pair(salted, ["tail", "_level", "_salt"], ["level", "dart"]), "paired")
    left = F.col("mate").isNull() & F.col("_hot")
    again = _pair(once.filter(left).drop("mate", "mate_level"), ["tail"], ["level", "dart"])
    return once.filter(~left).unionByName(again).drop("_hot", "_level", "_salt")
