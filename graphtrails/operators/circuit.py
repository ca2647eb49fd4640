"""Closed trails and Eulerian circuits over the whole graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphtrails.functions.graph import first_dart
from graphtrails.operators.chains import OPEN, chain_length, rank_chains, salted, start_of
from graphtrails.operators.hooks import climb, hook_round, relabel
from graphtrails.operators.pairing import pair_darts
from graphtrails.operators.ranks import dense_rank
from graphtrails.operators.skew import GROUP_ROWS, few_hot, hot_groups
from graphtrails.operators.tables import bidirect, degrees
from graphtrails.scratch import Scratch


def edge_links(g: DataFrame, scratch: Scratch, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges with the darts that theirs are paired with: ``(k, u, v, pa, pb)``.

    An odd vertex leaves one dart open; callers that need an even graph check it first.
    """
    darts = bidirect(g).select("dart", "eid", "tail", F.lit(0).alias("level"))
    paired = pair_darts(darts, scratch, group_rows)
    at_u = F.col("dart") == first_dart("eid")
    return scratch.save(
        paired.groupBy(F.col("eid").alias("k")).agg(
            F.max(F.when(at_u, F.col("tail"))).alias("u"),
            F.max(F.when(~at_u, F.col("tail"))).alias("v"),
            F.coalesce(F.max(F.when(at_u, F.col("mate"))), F.lit(OPEN)).alias("pa"),
            F.coalesce(F.max(F.when(~at_u, F.col("mate"))), F.lit(OPEN)).alias("pb"),
        ),
        "edge-links",
    )


def _rank_edges(links: DataFrame, scratch: Scratch) -> DataFrame:
    gap = lambda p: F.when(F.col(p) == OPEN, 1).otherwise(2).cast("long")
    return rank_chains(
        links.select("k", "pa", gap("pa").alias("ga"), "pb", gap("pb").alias("gb"), F.lit(1).cast("long").alias("own")), scratch
    )[0]


def _steps(links: DataFrame, places: DataFrame) -> DataFrame:
    """``(chain, closed, seq, eid, from_vid, to_vid)``."""
    back = F.col("r") == 1
    return (
        links.select("k", "u", "v")
        .join(places, "k")
        .select(
            "chain", "closed", start_of(F.lit(1)).alias("seq"), F.col("k").alias("eid"),
            F.when(back, F.col("v")).otherwise(F.col("u")).alias("from_vid"),
            F.when(back, F.col("u")).otherwise(F.col("v")).alias("to_vid"),
        )
    )


def trails(g: DataFrame, scratch: Scratch | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edge-disjoint trails of any graph: closed ones, and one open trail per two odd vertices."""
    scratch = scratch or Scratch.of(g.sparkSession)
    links = edge_links(g, scratch, group_rows)
    return _steps(links, _rank_edges(links, scratch)).withColumnRenamed("chain", "trail_id")


def closed_trails(g: DataFrame, scratch: Scratch | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(trail_id, seq, eid, from_vid, to_vid)`` of an even graph: every edge in one closed trail."""
    require_even(g)
    return trails(g, scratch, group_rows).drop("closed")


def require_even(g: DataFrame, counts: DataFrame | None = None) -> None:
    """``counts`` are the degrees, if they are there already."""
    odd = (degrees(g) if counts is None else counts).filter(F.col("degree") % 2 == 1).limit(1).collect()
    if odd:
        raise ValueError(f"odd degree {odd[0]['degree']} at vertex {odd[0]['vid']}: make the graph even first")


def start_vertex(g: DataFrame) -> DataFrame:
    """The vertex with the highest degree, the smallest of several."""
    return degrees(g).agg(
        F.max_by("vid", F.struct(F.col("degree"), -F.col("vid"))).alias("vid"),
        F.max("degree").alias("degree"),
    )


def next_starts(steps: DataFrame) -> DataFrame:
    """Where each closed trail starts."""
    return steps.filter(F.col("seq") == 0).select("trail_id", F.col("from_vid").alias("vid"))


def tour_counts(g: DataFrame) -> DataFrame:
    """Directed edges, and the edges a tour has to walk."""
    return bidirect(g).agg(
        F.count(F.lit(1)).alias("directed_edges"), (F.count(F.lit(1)) / 2).cast("long").alias("edges_to_walk")
    )


def _turn(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Hand ``out`` on to the previous row of the group, around in a ring."""
    w = Window.partitionBy(*groups).orderBy("arr")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("out", F.coalesce(F.lead("out").over(w), F.first("out").over(whole)))


def _splice(rows: DataFrame, group_rows: int, scratch: Scratch) -> DataFrame:
    """Exchange the ways out of the passages ``(place, obj, arr, out)`` that meet at a place.

    Passages of distinct closed trails become one closed trail. A place with very many is spliced
    inside salted groups first, then over one passage of each group.
    """
    hot = hot_groups(rows, ["place"], group_rows)
    if hot is None:
        return _turn(rows, ["place"])
    salted = (
        rows.join(hot, "place", "left")
        .withColumn("_hot", F.col("_salts").isNotNull())
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("arr"), F.col("_salts")), F.lit(-1)))
        .drop("_salts")
    )
    w = Window.partitionBy("place", "_salt").orderBy("arr")
    inside = _turn(salted.withColumn("_n", F.row_number().over(w)), ["place", "_salt"])
    inside = scratch.save(inside, "splice")
    lead = F.col("_hot") & (F.col("_n") == 1)
    over = _turn(inside.filter(lead), ["place"])
    return inside.filter(~lead).unionByName(over).drop("_hot", "_salt", "_n")


def _one_passage(rows: DataFrame, *more: str) -> DataFrame:
    """One passage for each trail and vertex, the one of the lowest ``arr``, with its values of ``more``."""
    return rows.groupBy("place", "obj").agg(*[F.min_by(c, "arr").alias(c) for c in more], F.min("arr").alias("arr"))


def _meeting(rows: DataFrame) -> DataFrame:
    """Passages at the places of several."""
    several = rows.groupBy("place").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return rows.join(several.select("place"), "place", "left_semi")


def _merge_trails(now: DataFrame, group_rows: int, scratch: Scratch) -> DataFrame | None:
    """Splice closed trails wherever they meet, until none do; return the changed links.

    ``now(place, obj, arr, out)``: trail ``obj`` comes into vertex ``place`` on step ``arr`` and leaves on ``out``. It is a written
    table of one passage for each trail and vertex, where several trails meet.
    """
    changes, number = None, 0
    while True:
        number += 1
        hooks, n = hook_round(now, ["place"], number, scratch)
        if n == 0:
            break
        joined = hooks.select("place", "obj").unionByName(
            hooks.select("place", F.col("parent").alias("obj")).distinct()
        )
        turned = scratch.save(
            _splice(now.join(joined, ["place", "obj"], "left_semi"), group_rows, scratch), "turned"
        )
        step = turned.select("arr", "out", F.lit(number).alias("round"))
        changes = step if changes is None else changes.unionByName(step)
        fresh = turned.select("place", "obj", F.col("out").alias("_out"))
        moved = now.join(fresh, ["place", "obj"], "left").withColumn("out", F.coalesce("_out", "out")).drop("_out")
        roots = climb(hooks, scratch)
        now = scratch.save(_meeting(scratch.save(_one_passage(relabel(moved, "obj", roots), "out"), "passages")), "meeting")
    if changes is None:
        return None
    return changes.groupBy("arr").agg(F.max_by("out", "round").alias("out"))


def euler_circuit(
    g: DataFrame, scratch: Scratch | None = None, group_rows: int = GROUP_ROWS, check: bool = True
) -> DataFrame:
    """One closed walk over all edges for each connected component of an even graph.

    ``(component, seq, eid, from_vid, to_vid)``; ``component`` is one of its edges.
    """
    scratch = scratch or Scratch.of(g.sparkSession)
    counts = scratch.save(degrees(g), "degrees")
    if check:
        require_even(g, counts)
    hot = few_hot(counts.withColumnRenamed("degree", "_rows"), ["vid"], group_rows)
    places = rank_chains(salted(scratch.spark.sql(_EDGES, edges=g), hot), scratch)[0]
    steps = places.select(
        "chain", start_of("len").alias("seq"), chain_length().alias("total"), F.col("k").alias("eid"),
        F.expr("IF(r = 1, b, a)").alias("from_vid"), F.expr("IF(r = 1, a, b)").alias("to_vid"))
    return circuit_of_trails(scratch.save(steps, "ranked"), scratch, group_rows)


# Edges as elements whose links are chosen as they are ranked.
_EDGES = """
SELECT eid AS k, 1L AS own, u AS a, 1L AS ga, -1L AS da, 0 AS qa, v AS b, 1L AS gb, -1L AS db, 0 AS qb, 0L AS tag FROM {edges}"""


def circuit_of_trails(steps: DataFrame, scratch: Scratch, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Splice the closed trails of the written ``steps(chain, seq, total, eid, from_vid, to_vid)``, and put their segments in order.

    A passage is named by the edge it comes in on and leaves on the edge of the next step, which is looked up only where trails meet.
    """
    passages = steps.select(F.col("to_vid").alias("place"), F.col("chain").alias("obj"), F.col("eid").alias("arr"), "seq", "total")
    met = _meeting(scratch.save(_one_passage(passages, "seq", "total"), "passages")).withColumn("_next", F.expr("(seq + 1) % total"))
    ahead = steps.select(F.col("chain").alias("obj"), F.col("seq").alias("_next"), F.col("eid").alias("out"))
    met = scratch.save(met.join(ahead, ["obj", "_next"]).drop("_next"), "meeting")
    changes = _merge_trails(met.select("place", "obj", "arr", "out"), group_rows, scratch)
    if changes is None:
        return steps.select(F.col("chain").alias("component"), "seq", "eid", "from_vid", "to_vid")
    cuts = met.join(changes.withColumnRenamed("out", "new_out"), "arr").select(
        F.col("obj").alias("chain"), "seq", "total", F.col("arr").alias("eid"), "out", "new_out")
    return scratch.save(_moved(steps, _segments(cuts, scratch)), "circuit")


# A segment by the edge of the cut at its end; the one over the trail's end goes to the first cut, all others to the next.
_SEGMENTS = """
WITH ahead AS (
  SELECT c.chain, c.total, c.out AS first_out, c.seq, n.eid AS seg, n.seq AS next_seq
  FROM {cuts} c LEFT JOIN {cuts} n ON n.i = c.i + 1 AND n.chain = c.chain)
SELECT chain, total, first_out, seg, (seq + 1) % total AS start, next_seq - seq AS len FROM ahead WHERE seg IS NOT NULL
UNION ALL
SELECT a.chain, a.total, a.first_out, f.seg, (a.seq + 1) % a.total, f.seq + a.total - a.seq
FROM ahead a JOIN (SELECT chain, min_by(eid, i) AS seg, min(seq) AS seq FROM {cuts} GROUP BY chain) f ON f.chain = a.chain
WHERE a.seg IS NULL"""

_SEGMENT_LINKS = """
SELECT c.eid AS i, s.seg AS after, l.len + s.len AS gap
FROM {cuts} c JOIN {segments} s ON s.first_out = c.new_out JOIN {segments} l ON l.seg = c.eid"""

_SEGMENT_ELEMENTS = """
SELECT k, max(pa) AS pa, max(ga) AS ga, max(pb) AS pb, max(gb) AS gb, max(own) AS own FROM (
  SELECT i AS k, null AS pa, null AS ga, 2 * after AS pb, gap AS gb, null AS own FROM {links} UNION ALL
  SELECT after, 2 * i + 1, gap, null, null, null FROM {links} UNION ALL
  SELECT seg, null, null, null, null, len FROM {segments})
GROUP BY k"""

# Where the places of a trail move to, from ``lo`` to below ``hi``; the segment over the trail's end has two ranges.
_SHIFTS = """
SELECT chain, component, inline(filter(array(
  named_struct('lo', start, 'hi', least(start + len, total), 'shift', at - start),
  named_struct('lo', 0L, 'hi', start + len - total, 'shift', at - start + total)), x -> x.lo < x.hi))
FROM {placed}"""


def _segments(cuts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(chain, component, lo, hi, shift)``: how the stretches between changed links are placed in the circuits.

    ``cuts(chain, seq, total, eid, out, new_out)`` are the steps whose way out changed, from the edge ``out`` to ``new_out``. A
    segment runs from one cut of its trail to the next and is named by the edge of the cut at its end, so the segment that names a
    circuit names its component: nothing is joined by the circuit, which may hold all segments. Only segments are ranked.
    """
    spark = scratch.spark
    cuts, seen = scratch.save(
        dense_rank(cuts, [F.col("chain"), F.col("seq")], "i", scratch, start=0), "cuts", n=F.count(F.lit(1)))
    segments = scratch.save(spark.sql(_SEGMENTS, cuts=cuts), "segments")
    linked = scratch.save(spark.sql(_SEGMENT_LINKS, cuts=cuts, segments=segments), "segment-links")
    places, _ = rank_chains(spark.sql(_SEGMENT_ELEMENTS, links=linked, segments=segments), scratch, seen["n"])
    placed = places.withColumnRenamed("chain", "component").join(
        segments.withColumnRenamed("seg", "k"), "k").select("chain", "component", "start", "len", "total", start_of("len").alias("at"))
    return scratch.save(spark.sql(_SHIFTS, placed=placed), "shifts")


#: Steps of a trail that are placed in one window.
BLOCK_STEPS = 1 << 16


def _moved(steps: DataFrame, shifts: DataFrame) -> DataFrame:
    """Steps at their places in the circuits: each takes the shift of the last range that begins at or before it.

    A range is repeated in every block of steps that it goes on into, so blocks are placed independently.
    """
    block = lambda c: F.expr(f"{c} div {BLOCK_STEPS}")
    begins = shifts.select(
        "chain", F.explode(F.sequence(block("lo"), block("(hi - 1)"))).alias("_b"), "lo", "shift", "component"
    ).select("chain", "_b", F.greatest("lo", F.col("_b") * BLOCK_STEPS).alias("seq"), "shift", "component", F.lit(0).alias("_step"))
    rows = steps.select("chain", block("seq").alias("_b"), "seq", "eid", "from_vid", "to_vid", F.lit(1).alias("_step")).unionByName(
        begins, allowMissingColumns=True)
    upto = Window.partitionBy("chain", "_b").orderBy("seq", "_step").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    return rows.select(
        F.coalesce(last("component"), "chain").alias("component"), (F.col("seq") + F.coalesce(last("shift"), F.lit(0))).alias("seq"),
        "eid", "from_vid", "to_vid", "_step",
    ).filter("_step = 1").drop("_step")
