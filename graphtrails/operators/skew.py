"""Hot-group handling: find heavy keys and split their rows, by a salt or by order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphtrails.operators.ranks import dense_rank
from graphtrails.scratch import Scratch

#: A group up to this many rows is left to one task.
GROUP_ROWS = 1_000_000
#: At most this many heavy keys are shipped to the executors with the plan.
HOT_KEYS = 100_000


def hot_groups(df: DataFrame, keys: Sequence[str], cap: int = GROUP_ROWS) -> DataFrame | None:
    """Keys with more than ``cap`` rows and the number of salts each needs, or None without any.

    The count is combined before its shuffle. Up to ``HOT_KEYS`` keys come back as a local relation,
    whose exact size lets the planner broadcast it; a longer list stays a distributed table without
    any hint.
    """
    return few_hot(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, cap)


def few_hot(counts: DataFrame, keys: Sequence[str], cap: int) -> DataFrame | None:
    """``hot_groups`` of rows that are counted already, as ``_rows``."""
    heavy = counts.filter(F.col("_rows") > cap).select(*keys, F.ceil(F.col("_rows") / cap).cast("long").alias("_salts"))
    first = heavy.limit(HOT_KEYS + 1).collect()
    if not first:
        return None
    if len(first) > HOT_KEYS:
        return heavy
    return counts.sparkSession.createDataFrame(first, heavy.schema)


def ordered_chunks(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], list_rows: int = GROUP_ROWS, scratch: Scratch | None = None
) -> DataFrame:
    """Add ``chunk``: the place of a row in its group, by ``order``, over ``list_rows``.

    So a group's chunks follow each other in order, and each but the last is full. Only groups of more than one chunk, if there
    are any, are ranked, over range partitions; their keys are a written table, whose size the planner sees. ``order`` must be strict.
    """
    scratch = scratch or Scratch.of(rows.sparkSession)
    keys = list(keys)
    long = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > list_rows)
    long, seen = scratch.save(long.select(*keys), "long-groups", n=F.count(F.lit(1)))
    if not seen["n"]:
        return rows.withColumn("chunk", F.lit(0))
    short = rows.join(long, keys, "left_anti").withColumn("chunk", F.lit(0))
    # kept as one column, so that ranking carries rows of any names
    held = rows.join(long, keys, "left_semi").select(
        *keys, *[(c if isinstance(c, Column) else F.col(c)).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("_row"))
    ranked = dense_rank(held, [F.col(c) for c in keys] + [F.col(f"_o{i}") for i in range(len(order))], "_at", scratch, start=0)
    first = ranked.groupBy(*keys).agg(F.min("_at").alias("_first"))
    chunk = F.expr(f"cast((_at - _first) div {list_rows} AS int)").alias("chunk")
    return short.unionByName(ranked.join(first, keys).select("_row.*", chunk))
