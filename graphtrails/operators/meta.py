"""The weighted graph of partitions and the tree in which to merge them.

``meta(src, dst, weight)`` has both directions of every pair of parts with cut edges, and
``(src, null, 0)`` for a part without any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphtrails.operators.tables import attach_partition, partitioned_darts
from graphtrails.scratch import Scratch

META = "src int, dst int, weight long"
MERGE_TREE = "level int, part_a int, part_b int"


def meta_edge_map(pa: DataFrame) -> DataFrame:
    """Cut edges from each part to each other one, of partitioned adjacency."""
    return (
        partitioned_darts(pa)
        .filter(F.col("part") != F.col("npart"))
        .groupBy(F.col("part").alias("src"), F.col("npart").alias("dst"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _parted(g: DataFrame, vp: DataFrame) -> DataFrame:
    """Edges with the parts of their ends, which ``g`` may have already."""
    return g if "pu" in g.columns else attach_partition(g, vp)


def meta_graph(g: DataFrame, vp: DataFrame) -> DataFrame:
    """``meta`` of a partitioned edge table: one count by the pair of parts, combined before the
    shuffle; only the counts are turned both ways."""
    cut = _parted(g, vp).filter("pu <> pv").groupBy("pu", "pv").agg(F.count(F.lit(1)).alias("n"))
    pairs = (
        cut.selectExpr("inline(array(struct(pu AS src, pv AS dst, n), struct(pv AS src, pu AS dst, n)))")
        .groupBy("src", "dst")
        .agg(F.sum("n").alias("weight"))
    )
    parts = vp.select(F.col("part").cast("int").alias("src")).distinct()
    return (
        parts.join(pairs, "src", "left")
        .select("src", "dst", F.coalesce("weight", F.lit(0)).alias("weight"))
    )


def meta_symmetry(meta: DataFrame) -> DataFrame:
    """Pairs whose weights differ by direction; empty in a sound meta graph."""
    there = meta.filter(F.col("dst").isNotNull())
    back = there.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("reverse"))
    return there.join(back, ["src", "dst"], "full").filter(~F.col("weight").eqNullSafe(F.col("reverse")))


_MUTUAL = """
WITH ends AS (SELECT lo AS p, * FROM {edges} UNION ALL SELECT hi AS p, * FROM {edges}),
best AS (SELECT p, max(struct(weight, -lo AS lo, -hi AS hi)) AS b FROM ends GROUP BY p)
SELECT cast(-b.lo AS int) AS lo, cast(-b.hi AS int) AS hi FROM best GROUP BY b.lo, b.hi HAVING count(*) = 2"""


def max_weight_matching(meta: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(part_a, part_b)``: heaviest pairs first; ``part_b`` is null for a part left alone.

    In every round the pairs that both ends prefer are taken. As the order (weight, then the smaller
    pair) is strict, the result is that of going through all pairs in order.
    """
    scratch = scratch or Scratch.of(meta.sparkSession)
    size = F.count(F.lit(1))
    edges, seen = scratch.save(
        meta.filter("src < dst").selectExpr("src AS lo", "dst AS hi", "weight"), "meta-pairs", n=size
    )
    pairs = None
    while seen["n"]:
        taken = scratch.save(scratch.spark.sql(_MUTUAL, edges=edges), "mutual")
        pairs = taken if pairs is None else pairs.unionByName(taken)
        used = taken.selectExpr("inline(array(struct(lo AS p), struct(hi AS p)))")
        edges, seen = scratch.save(
            edges.join(used.withColumnRenamed("p", "lo"), "lo", "left_anti")
            .join(used.withColumnRenamed("p", "hi"), "hi", "left_anti"),
            "meta-pairs", n=size,
        )
    parts = meta.select("src").distinct()
    if pairs is None:
        return parts.selectExpr("src AS part_a", "cast(null AS int) AS part_b")
    used = pairs.selectExpr("inline(array(struct(lo AS src), struct(hi AS src)))")
    alone = parts.join(used, "src", "left_anti").selectExpr("src AS part_a", "cast(null AS int) AS part_b")
    return pairs.selectExpr("lo AS part_a", "hi AS part_b").unionByName(alone)


def pair_roots(pairs: DataFrame) -> DataFrame:
    """``(part, root)``: the larger id of a pair stays."""
    return pairs.selectExpr(
        "inline(filter(array(struct(part_a AS part, greatest(part_a, part_b) AS root),"
        " struct(part_b AS part, greatest(part_a, part_b) AS root)), x -> x.part IS NOT NULL))"
    )


def coarsen_meta(meta: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merge the pairs: add up the weights and drop what became internal."""
    roots = pair_roots(pairs)
    moved = (
        meta.join(roots.selectExpr("part AS src", "root AS _src"), "src")
        .join(roots.selectExpr("part AS dst", "root AS _dst"), "dst", "left")
        .filter("_dst IS NULL OR _src <> _dst")
        .groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
        .agg(F.sum("weight").alias("weight"))
        .filter("dst IS NOT NULL")
    )
    return (
        roots.select(F.col("root").alias("src")).distinct().join(moved, "src", "left")
        .select("src", "dst", F.coalesce("weight", F.lit(0)).alias("weight"))
    )


def merge_tree(meta: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(level, part_a, part_b)`` from level 1, until no two parts share a cut edge."""
    scratch = scratch or Scratch.of(meta.sparkSession)
    tree, level = None, 0
    linked = F.count_if(F.col("dst").isNotNull())
    now, seen = scratch.save(meta.select("src", "dst", "weight"), "meta", n=linked)
    while seen["n"]:
        level += 1
        pairs = scratch.save(
            max_weight_matching(now, scratch).select(F.lit(level).alias("level"), "part_a", "part_b"), "merge"
        )
        tree = pairs if tree is None else tree.unionByName(pairs)
        now, seen = scratch.save(coarsen_meta(now, pairs), "meta", n=linked)
    return tree if tree is not None else meta.sparkSession.createDataFrame([], MERGE_TREE)


def given_merge_tree(
    spark: SparkSession, levels: Sequence[Sequence[tuple[int, int | None]]]
) -> DataFrame:
    """A merge tree written down by hand: for each level its pairs. Each part once in a level."""
    rows = []
    for level, pairs in enumerate(levels, 1):
        seen = [p for pair in pairs for p in pair if p is not None]
        if len(seen) != len(set(seen)):
            raise ValueError(f"a part appears twice in level {level}")
        rows += [(level, a, b) for a, b in pairs]
    return spark.createDataFrame(rows, MERGE_TREE)


def tree_height(mt: DataFrame) -> int:
    return mt.agg(F.max("level")).first()[0] or 0


def part_roots(mt: DataFrame, parts: DataFrame) -> DataFrame:
    """``(level, part, root)`` for level 0 up to the top of the tree."""
    now = parts.select(F.col("part").cast("int").alias("part")).distinct().withColumn("root", F.col("part"))
    every = now.selectExpr("0 AS level", "part", "root")
    for level in range(1, tree_height(mt) + 1):
        up = pair_roots(mt.filter(F.col("level") == level)).selectExpr("part AS root", "root AS _up")
        now = now.join(up, "root", "left").select("part", F.coalesce("_up", "root").alias("root"))
        every = every.unionByName(now.select(F.lit(level).alias("level"), "part", "root"))
    return every


def edge_levels(
    g: DataFrame,
    vp: DataFrame,
    mt: DataFrame | None = None,
    roots: DataFrame | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Edges with their parts and the ``level`` at which both ends are in one part; null for never.

    Levels are worked out once for each pair of parts that share an edge, from the merge tree or the
    ``part_roots`` of one, and written: with its size known, the planner broadcasts that table rather
    than shuffle all edges to a few pairs of parts.
    """
    scratch = scratch or Scratch.of(g.sparkSession)
    parted = _parted(g, vp)
    cut = parted.filter("pu <> pv").select(
        F.least("pu", "pv").alias("lo"), F.greatest("pu", "pv").alias("hi")
    ).distinct()
    roots = part_roots(mt, vp) if roots is None else roots
    levels = scratch.save(
        cut.join(roots.selectExpr("part AS lo", "level", "root"), "lo")
        .join(roots.selectExpr("part AS hi", "level", "root"), ["hi", "level", "root"])
        .groupBy("lo", "hi")
        .agg(F.min("level").alias("_level")),
        "pair-levels",
    )
    return (
        parted.withColumn("lo", F.least("pu", "pv"))
        .withColumn("hi", F.greatest("pu", "pv"))
        .join(levels, ["lo", "hi"], "left")
        .select(*parted.columns, F.expr("IF(pu = pv, 0, _level)").alias("level"))
    )
