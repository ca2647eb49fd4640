"""Making every degree even: pair up the odd vertices by new edges.

Odd vertices are ranked by degree, highest first, and neighbours in rank are paired, so that most
pairs lie inside one degree. Pairs that are already adjacent are ranked anew in a random order, some
rounds; each one left then exchanges partners with an accepted pair. The exchange finds a fitting
pair whenever there is one, by set difference, without trying pairs one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphtrails.operators.hooks import components
from graphtrails.operators.ranks import dense_rank
from graphtrails.operators.tables import degrees, odd_by_degree
from graphtrails.scratch import Scratch, one_row

ON_UNMATCHED = ("parallel", "null", "error")


def _near(g: DataFrame, odd: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct adjacent pairs ``(lo, hi)`` of odd vertices; copies of an edge fold before the shuffle."""
    pairs = (
        g.filter(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
        .distinct()
    )
    ids = odd.select("vid")
    return scratch.save(
        pairs.join(ids.withColumnRenamed("vid", "lo"), "lo", "left_semi").join(
            ids.withColumnRenamed("vid", "hi"), "hi", "left_semi"
        ),
        "near",
    )


def _judge(ranked: DataFrame, near: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Pair positions ``2k-1`` and ``2k``; flag the pairs that are adjacent already."""
    pairs = ranked.groupBy(F.expr("shiftright(pos + 1, 1)").alias("no")).agg(
        F.max(F.expr("IF(pos % 2 = 1, vid, null)")).alias("a"),
        F.max(F.expr("IF(pos % 2 = 0, vid, null)")).alias("b"),
    )
    flagged = _flag(pairs, near, "a", "b", "bad").select("a", "b", "bad")
    saved, seen = scratch.save(flagged, "pairs", bad=F.count_if("bad"))
    return saved, seen["bad"]


def _flag(rows: DataFrame, near: DataFrame, x: str, y: str, out: str) -> DataFrame:
    known = near.withColumn(out, F.lit(True))
    return (
        rows.withColumn("lo", F.least(x, y))
        .withColumn("hi", F.greatest(x, y))
        .join(known, ["lo", "hi"], "left")
        .drop("lo", "hi")
        .withColumn(out, F.coalesce(out, F.lit(False)))
    )


# Slots that a rejected pair cannot swap with, both ways round, counted from a random start of its own.
_BLOCKED = """
WITH sides AS (
  SELECT a AS vid, no AS slot, 0 AS side FROM {pool}
  UNION ALL SELECT b, no, 1 FROM {pool}),
asking AS (
  SELECT a AS vid, no AS id, 0 AS role FROM {pool} WHERE bad
  UNION ALL SELECT b, no, 1 FROM {pool} WHERE bad),
links AS (SELECT lo AS vid, hi AS nbr FROM {near} UNION ALL SELECT hi, lo FROM {near}),
hits AS (
  SELECT asking.id, role ^ side AS way, slot
  FROM asking JOIN links USING (vid) JOIN sides ON sides.vid = links.nbr
  UNION ALL SELECT no, way, no FROM {pool} LATERAL VIEW explode(array(0, 1)) AS way WHERE bad)
SELECT DISTINCT id, way, pmod(slot - 1 - pmod(xxhash64(id, {turn}), {size}), {size}) AS q FROM hits"""

# The first slot that nothing blocks; each slot to one pair.
_CHOICE = """
WITH tries AS (
  SELECT id, way, q + 1 AS q FROM {blocked}
  UNION ALL SELECT no, way, cast(0 AS long) FROM {pool} LATERAL VIEW explode(array(0, 1)) AS way WHERE bad),
free AS (
  SELECT t.id, min(struct(t.q, t.way)) AS best
  FROM tries t LEFT ANTI JOIN {blocked} b ON t.id = b.id AND t.way = b.way AND t.q = b.q
  WHERE t.q < {size} GROUP BY t.id)
SELECT slot, min(struct(id, way)).id AS id, min(struct(id, way)).way AS way
FROM (SELECT id, best.way AS way,
             pmod(best.q + pmod(xxhash64(id, {turn}), {size}), {size}) + 1 AS slot FROM free)
GROUP BY slot"""

# A rejected pair may be chosen while it chooses: of such choices the one with the lowest number stays.
_WINNERS = """
SELECT c.* FROM {choice} c
LEFT JOIN {choice} other ON other.id = c.slot LEFT JOIN {choice} taker ON taker.slot = c.id
WHERE (other.id IS NULL OR c.id < other.id) AND (taker.id IS NULL OR c.id < taker.id)"""

_SWAP = """
SELECT inline(array(
  struct(r.a AS a, IF(w.way = 0, p.a, p.b) AS b), struct(r.b AS a, IF(w.way = 0, p.b, p.a) AS b)))
FROM {won} w JOIN {pool} p ON p.no = w.slot JOIN {pool} r ON r.no = w.id"""


def _exchange(pairs: DataFrame, near: DataFrame, scratch: Scratch) -> DataFrame:
    """Swap partners of rejected pairs with any other pair until no swap is left; ``(a, b, bad)``.

    Every turn settles at least one pair if any can be settled: choices start at random slots, so
    most rejected pairs find one of their own at once.
    """
    spark = scratch.spark
    turn, pool = 0, pairs
    while True:
        turn += 1
        pool, seen = scratch.save(
            dense_rank(pool, [F.col("a")], "no", scratch), "pool",
            size=F.count(F.lit(1)), bad=F.count_if("bad"),
        )
        size = seen["size"]
        if not seen["bad"]:
            return pool
        blocked = scratch.save(spark.sql(_BLOCKED, pool=pool, near=near, size=size, turn=turn), "blocked")
        choice = scratch.save(spark.sql(_CHOICE, blocked=blocked, pool=pool, size=size, turn=turn), "choice")
        won, seen = scratch.save(spark.sql(_WINNERS, choice=choice), "won", n=F.count(F.lit(1)))
        if not seen["n"]:
            return pool
        used = won.selectExpr("inline(array(struct(slot AS no), struct(id AS no)))")
        swapped = spark.sql(_SWAP, won=won, pool=pool).withColumn("bad", F.lit(False))
        pool = pool.join(used, "no", "left_anti").select("a", "b", "bad").unionByName(swapped)


def match_odd_vertices(
    g: DataFrame, rounds: int = 4, on_unmatched: str = "parallel", scratch: Scratch | None = None
) -> DataFrame:
    """``(vid, degree, sink, sink_degree)``: the new neighbour of every odd vertex, both ways.

    A pair without any legal partner gets a parallel edge, a null sink, or raises, by
    ``on_unmatched``.
    """
    if on_unmatched not in ON_UNMATCHED:
        raise ValueError(f"on_unmatched must be one of {ON_UNMATCHED}")
    scratch = scratch or Scratch.of(g.sparkSession)
    odd = scratch.save(odd_by_degree(g, scratch), "odd")
    near = _near(g, odd, scratch)
    pairs, bad = _judge(odd, near, scratch)
    settled = pairs.filter(~F.col("bad"))
    number = 1
    while bad > 1 and number < rounds:
        number += 1
        again = pairs.filter("bad").selectExpr("inline(array(struct(a AS vid), struct(b AS vid)))")
        order = [F.xxhash64("vid", F.lit(number))]
        pairs, bad = _judge(dense_rank(again, order, "pos", scratch), near, scratch)
        settled = settled.unionByName(pairs.filter(~F.col("bad")))
    if bad:
        settled = _exchange(settled.unionByName(pairs.filter("bad")), near, scratch)
        unmatched = settled.filter("bad").count()
        if unmatched and on_unmatched == "error":
            raise ValueError(f"{unmatched} pairs of odd vertices have no legal partner")
        if on_unmatched == "null":
            settled = settled.filter(~F.col("bad"))
    sinks = settled.selectExpr("inline(array(struct(a AS vid, b AS sink), struct(b AS vid, a AS sink)))")
    of_sink = odd.select(F.col("vid").alias("sink"), F.col("degree").alias("sink_degree"))
    return scratch.save(
        odd.select("vid", "degree").join(sinks, "vid", "left").join(of_sink, "sink", "left")
        .select("vid", "degree", "sink", "sink_degree"),
        "matches",
    )


def added_edges(g: DataFrame, matches: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """New edges with ids above all old ones."""
    scratch = scratch or Scratch.of(g.sparkSession)
    top = g.agg(F.max("eid")).first()[0]
    pairs = matches.filter(F.col("vid") < F.col("sink")).select(F.col("vid").alias("u"), F.col("sink").alias("v"))
    return dense_rank(pairs, [F.col("u")], "eid", scratch, start=(top or 0) + 1).select("eid", "u", "v")


def eulerize(
    g: DataFrame, rounds: int = 4, on_unmatched: str = "parallel", scratch: Scratch | None = None
) -> DataFrame:
    """The graph with the added edges."""
    matches = match_odd_vertices(g, rounds, on_unmatched, scratch)
    return g.unionByName(added_edges(g, matches, scratch))


def match_report(matches: DataFrame) -> DataFrame:
    """Per degree: odd vertices, matched inside the degree, across degrees, and left over."""
    same = F.col("sink_degree") == F.col("degree")
    return matches.groupBy("degree").agg(
        F.count(F.lit(1)).alias("vertices"),
        F.count_if(same).alias("matched_same_degree"),
        F.count_if(~same).alias("matched_other_degree"),
        F.count_if(F.col("sink").isNull()).alias("unmatched"),
    )


def unmatched(g: DataFrame, matches: DataFrame) -> DataFrame:
    """Odd vertices without a new neighbour."""
    odd = degrees(g).filter(F.col("degree") % 2 == 1)
    return odd.join(matches.filter(F.col("sink").isNotNull()).select("vid"), "vid", "left_anti")


def euler_preconditions(g: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row: vertices, odd vertices, and connected components."""
    parity = degrees(g).agg(
        F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("degree") % 2 == 1).alias("odd_vertices")
    )
    parts = components(g, scratch).agg(F.count_distinct("component").alias("components"))
    return one_row(parity, parts)
