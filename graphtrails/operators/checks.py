"""Checks as queries. Every function returns offending rows or counts; sound data gives none or zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphtrails.operators.partition import Tour
from graphtrails.operators.tables import adjacency_to_edges, partitioned_darts
from graphtrails.scratch import Scratch, one_row


def edges_covered_once(steps: DataFrame, g: DataFrame) -> DataFrame:
    """One row: edges of the graph, edges walked, walked twice, and never walked. Keyed by ``eid``,
    so parallel edges and steps in opposite directions are told apart."""
    walked = steps.groupBy("eid").agg(F.count(F.lit(1)).alias("times"))
    both = g.select("eid", F.lit(1).alias("here")).join(walked, "eid", "full")
    return both.agg(
        F.count("here").alias("edges"),
        F.count_if(F.col("times") == 1).alias("walked_once"),
        F.count_if(F.col("times") > 1).alias("walked_again"),
        F.count_if(F.col("times").isNull()).alias("missed"),
        F.count_if(F.col("here").isNull()).alias("unknown"),
    )


def walk_breaks(steps: DataFrame, walk: str, closed: bool = True) -> DataFrame:
    """``(walk, seq)`` of steps whose end is not where the next one starts, and of walks that have
    gaps or, if they should, do not return.

    A join by position, so that a walk over the whole graph is not one group. It is made once; its few odd rows are written.
    """
    ahead = steps.select(walk, (F.col("seq") + 1).alias("_next"), "to_vid").join(
        steps.select(walk, F.col("seq").alias("_next"), F.col("from_vid").alias("_from")), [walk, "_next"], "left"
    ).filter((F.col("to_vid") != F.col("_from")) | F.col("_from").isNull())
    odd = Scratch.of(steps.sparkSession).save(ahead.select(walk, (F.col("_next") - 1).alias("seq"), "to_vid", "_from"), "odd-steps")
    off = odd.filter(F.col("to_vid") != F.col("_from")).select(walk, "seq")
    lasts = odd.filter(F.col("_from").isNull()).groupBy(walk).agg(
        F.count(F.lit(1)).alias("_n"), F.max("seq").alias("seq"), F.max_by("to_vid", "seq").alias("to_vid")
    )
    firsts = steps.filter("seq = 0").select(walk, F.col("from_vid").alias("_from"))
    returns = F.col("to_vid").eqNullSafe(F.col("_from")) if closed else F.col("_from").isNotNull()
    ends = lasts.join(firsts, walk, "left").filter((F.col("_n") > 1) | ~returns).select(walk, "seq")
    return off.unionByName(ends)


def circuit_summary(steps: DataFrame, g: DataFrame) -> DataFrame:
    """One row on a set of circuits: steps, distinct edges, breaks, and steps that are no edge."""
    ends = g.select("eid", F.col("u").alias("_u"), F.col("v").alias("_v"))
    right = F.expr("coalesce((from_vid = _u AND to_vid = _v) OR (from_vid = _v AND to_vid = _u), false)")
    by_edge = steps.join(ends, "eid", "left").groupBy("eid").agg(F.count_if(~right).alias("_wrong"))  # in the join's partitions
    edges = by_edge.agg(F.count("eid").alias("edges"), F.coalesce(F.sum("_wrong"), F.lit(0)).alias("wrong_edges"))
    total = steps.agg(F.count(F.lit(1)).alias("steps"), F.count_distinct("component").alias("circuits"))
    breaks = walk_breaks(steps, "component").agg(F.count(F.lit(1)).alias("breaks"))
    return one_row(total, breaks, edges).select("steps", "edges", "circuits", "breaks", "wrong_edges")


def trails_valid(tour: Tour) -> DataFrame:
    """``(level, part, verdict)``: ``valid``, ``wrong``, or ``no trails``.

    A trail is wrong if a step does not start where the last one ended, or if a plain step is not
    an edge of the merged part at that level.
    """
    steps = tour.steps.withColumn("_next", F.col("seq") + F.col("n_edges"))
    ahead = steps.withColumnRenamed("total", "_total").withColumn(
        "_next", F.when(F.col("closed"), F.col("_next") % F.col("_total")).otherwise(F.col("_next"))
    )
    following = tour.steps.select("level", "loop", F.col("seq").alias("_next"), F.col("from_vid").alias("_from"))
    joined = ahead.join(following, ["level", "loop", "_next"], "left")
    last = ~F.col("closed") & (F.col("_next") == F.col("_total"))
    broken = joined.withColumn("_bad", ~last & ~F.col("to_vid").eqNullSafe(F.col("_from")))
    edges = tour.edges.select(F.col("eid").alias("element"), "u", "v", F.col("level").alias("_level"))
    plain = broken.filter("NOT is_trail").join(edges, "element", "left").withColumn(
        "_bad",
        F.col("_bad") | ~F.coalesce(
            F.expr("_level <= level AND ((from_vid = u AND to_vid = v) OR (from_vid = v AND to_vid = u))"), F.lit(False)
        ),
    )
    bad = plain.select("level", "part", "_bad").unionByName(
        broken.filter("is_trail").select("level", "part", "_bad")
    ).groupBy("level", "part").agg(F.count_if("_bad").alias("_wrong"))
    parts = tour.roots.select("level", F.col("root").alias("part")).distinct()
    return parts.join(bad, ["level", "part"], "left").select(
        "level", "part",
        F.expr("CASE WHEN _wrong IS NULL THEN 'no trails' WHEN _wrong > 0 THEN 'wrong' ELSE 'valid' END").alias("verdict"),
    )


def local_coverage(tour: Tour) -> DataFrame:
    """``(level, edges, walked)``: edges that become local at a level and those in its trails."""
    walked = tour.steps.filter("NOT is_trail").groupBy("level").agg(F.count_distinct("element").alias("walked"))
    local = tour.edges.filter(F.col("level") <= tour.height)
    return local.groupBy("level").agg(F.count(F.lit(1)).alias("edges")).join(walked, "level", "left")


def adjacency_integrity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: directed edges of both adjacency tables, common ones, and those in only one."""
    count = lambda rows, name: rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias(name))
    both = count(adjacency_to_edges(left), "a").join(count(adjacency_to_edges(right), "b"), ["src", "dst"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        total(a).alias("left_edges"), total(b).alias("right_edges"), total(F.least(a, b)).alias("common"),
        total(F.greatest(a - b, F.lit(0))).alias("left_only"), total(F.greatest(b - a, F.lit(0))).alias("right_only"),
    )


def _one_way(darts: DataFrame) -> DataFrame:
    """Neighbour entries without as many entries the other way, or with another part there."""
    there = darts.groupBy("part", "vid", "npart", "nbr").agg(F.count(F.lit(1)).alias("n"))
    back = there.selectExpr("npart AS part", "nbr AS vid", "part AS npart", "vid AS nbr", "n AS m")
    return there.join(back, ["part", "vid", "npart", "nbr"], "left").filter(~F.col("n").eqNullSafe(F.col("m")))


def remote_edges_symmetric(pa: DataFrame) -> DataFrame:
    """Remote neighbours that are not in the part they are said to be in, or do not point back."""
    return _one_way(partitioned_darts(pa).filter("part <> npart")).select("part", "vid", "npart", "nbr")


def local_edges_symmetric(pa: DataFrame) -> DataFrame:
    """Local neighbours without a row of their own in the part, or that do not point back."""
    return _one_way(partitioned_darts(pa).filter("part = npart")).select("part", "vid", "npart", "nbr")


def self_part_not_remote(pa: DataFrame) -> DataFrame:
    """Rows whose own part is among the remote ones."""
    return pa.filter(F.map_contains_key("remote", F.col("part"))).select("part", "vid")


def boundary_contained(tour: Tour) -> DataFrame:
    """Ends of newly local edges that the level before did not carry as boundary vertices."""
    fresh = tour.edges.filter("level > 0").selectExpr(
        "level - 1 AS level", "inline(array(struct(u AS vid), struct(v AS vid)))"
    ).filter(F.col("level") < tour.height).distinct()
    return fresh.join(tour.classes.filter("vtype <> 'IN'").select("level", "vid"), ["level", "vid"], "left_anti")


def trail_invariants(tour: Tour, trails: DataFrame) -> DataFrame:
    """``(rule, violations)``: the rules that trails of every level keep."""
    types = tour.classes.select("level", "vid", "vtype")
    open_trails = trails.filter("kind = 'OB'")
    tips = open_trails.selectExpr("level", "inline(array(struct(source AS vid), struct(sink AS vid)))")
    closed = tour.steps.join(tour.loops.filter("closed").select("level", "loop"), ["level", "loop"], "left_semi")
    balance = closed.selectExpr(
        "level", "loop", "inline(array(struct(from_vid AS vid, 1 AS d), struct(to_vid AS vid, -1 AS d)))"
    ).groupBy("level", "loop", "vid").agg(F.sum("d").alias("d"))
    odd_ends = tips.groupBy("level", "vid").agg(F.count(F.lit(1)).alias("n")).join(types, ["level", "vid"], "full")
    even = trails.filter("kind = 'EB'").selectExpr("level", "source AS vid").distinct()
    rules = {
        "open trail with equal ends": open_trails.filter("source = sink"),
        "odd boundary vertex not at exactly one end": odd_ends.filter(
            "NOT ((coalesce(vtype, '') = 'OB' AND coalesce(n, 0) = 1) OR (coalesce(vtype, '') <> 'OB' AND n IS NULL))"
        ),
        "closed trail that does not return": balance.filter("d <> 0"),
        "trail without edges outside even boundary vertices": trails.filter("kind <> 'EB' AND n_edges < 1"),
        "even boundary vertex on no entry or several": types.filter("vtype = 'EB'").join(even, ["level", "vid"], "left_anti"),
        "internal cycle through an even boundary vertex": trails.filter("kind = 'IN'").select("level", "loop")
        .join(tour.steps, ["level", "loop"]).selectExpr("level", "from_vid AS vid")
        .join(types.filter("vtype = 'EB'"), ["level", "vid"], "left_semi"),
    }
    counted = [
        rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        for rule, rows in rules.items()
    ]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out
