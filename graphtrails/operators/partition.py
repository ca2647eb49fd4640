"""Trails inside partitions and their continuation, level by level, as partitions merge.

Each level links only what is new there: its own edges, and every open trail of the level before as
a single element. At every vertex the ends it meets are linked two by two, so at most one stays open
and goes on. Linking and ranking are one contraction (``chains``); no partition is ever brought
together in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from graphtrails.operators.chains import chain_length, rank_chains, salted, start_of
from graphtrails.operators.circuit import circuit_of_trails, require_even
from graphtrails.operators.hooks import meeting_roots
from graphtrails.operators.meta import edge_levels, merge_tree, meta_graph, pair_roots, part_roots, tree_height
from graphtrails.operators.skew import GROUP_ROWS, few_hot, ordered_chunks
from graphtrails.operators.tables import attach_partition, bidirect
from graphtrails.scratch import Scratch


def classify_vertices(g: DataFrame, vp: DataFrame) -> DataFrame:
    """``(part, vid, vtype, n_local, n_remote)``: odd boundary, even boundary or internal."""
    darts = bidirect(attach_partition(g, vp))
    counts = darts.groupBy("part", F.col("tail").alias("vid")).agg(
        F.count_if(F.col("part") == F.col("hpart")).alias("n_local"),
        F.count_if(F.col("part") != F.col("hpart")).alias("n_remote"),
    )
    return counts.select("part", "vid", _vtype().alias("vtype"), "n_local", "n_remote")


def _vtype():
    return F.expr("CASE WHEN n_remote = 0 THEN 'IN' WHEN n_remote % 2 = 1 THEN 'OB' ELSE 'EB' END")


def vertex_class_counts(classes: DataFrame) -> DataFrame:
    return classes.groupBy("part", "vtype").agg(F.count(F.lit(1)).alias("vertices"))


def level_classes(edges: DataFrame, roots: DataFrame, height: int) -> DataFrame:
    """Vertex classes of every level, one pass over the darts.

    ``(level, part, vid, vtype, n_local, n_new, n_remote)``; ``part`` is the merged one, ``n_new``
    counts the darts that become local here. Internal vertices are left out of the levels after.
    """
    darts = bidirect(edges)
    above = [F.count_if(F.col("level") > i).alias(f"above{i}") for i in range(height + 1)]
    counts = darts.groupBy(F.col("part").alias("_part"), F.col("tail").alias("vid")).agg(
        F.count(F.lit(1)).alias("n"), *above
    )
    rows = ", ".join(
        f"named_struct('level', {i}, 'n_local', n - above{i}, "
        f"'n_new', {f'above{i - 1}' if i else 'n'} - above{i}, 'n_remote', above{i}, "
        f"'carried', {f'above{i - 1} > 0' if i else 'true'})"
        for i in range(height + 1)
    )
    by_level = counts.selectExpr("_part", "vid", f"inline(array({rows}))").filter("carried")
    return by_level.join(roots.withColumnRenamed("part", "_part"), ["level", "_part"]).select(
        "level", F.col("root").alias("part"), "vid", _vtype().alias("vtype"), "n_local", "n_new", "n_remote"
    )


STEPS = ["level", "part", "loop", "seq", "element", "is_trail", "n_edges", "closed", "total", "from_vid", "to_vid"]


@dataclass
class Tour:
    """All tables of one run over a partitioned even graph."""

    tree: DataFrame  #: merge tree (level, part_a, part_b)
    roots: DataFrame  #: (level, part, root)
    height: int
    edges: DataFrame  #: (eid, u, v, pu, pv, level)
    #: edges with the darts theirs are linked to and from which level on, joined when read: (eid, u, v, pu, pv, level, mate_u, mate_v, link_u, link_v)
    links: DataFrame
    darts: DataFrame  #: of links: (dart, eid, tail, head, part, hpart, level, mate, link)
    classes: DataFrame  #: see level_classes
    loops: DataFrame  #: (level, part, loop, closed, n_edges)
    steps: DataFrame  #: (level, part, loop, seq, element, is_trail, n_edges, closed, total, from_vid, to_vid)
    ends: DataFrame  #: (level, loop, side, vid) of open trails
    scratch: Scratch


# The darts that are linked, both ways, and from which level on.
_MATES = """
SELECT shiftright(dart, 1) AS eid, max(IF(dart & 1 = 0, mate, null)) AS mate_u, max(IF(dart & 1 = 1, mate, null)) AS mate_v,
       max(IF(dart & 1 = 0, link, null)) AS link_u, max(IF(dart & 1 = 1, link, null)) AS link_v
FROM (SELECT link, inline(array(named_struct('dart', da, 'mate', db), named_struct('dart', db, 'mate', da))) FROM {links})
GROUP BY shiftright(dart, 1)"""

_DARTS = """
SELECT inline(array(
  named_struct('dart', 2 * eid, 'eid', eid, 'tail', u, 'head', v, 'part', pu, 'hpart', pv, 'level', level, 'mate', mate_u, 'link', link_u),
  named_struct('dart', 2 * eid + 1, 'eid', eid, 'tail', v, 'head', u, 'part', pv, 'hpart', pu, 'level', level, 'mate', mate_v, 'link', link_v)))
FROM {links}"""

# What a level adds: its own edges, and every open trail of the level before as a single element. A tag is the part and if it is a trail.
_EDGES = """
SELECT eid AS k, 1L AS own, u AS a, 1L AS ga, -1L AS da, 0 AS qa, v AS b, 1L AS gb, -1L AS db, 0 AS qb, 2L * pu AS tag
FROM {edges} WHERE level = {level}"""

_TRAILS = """
SELECT c.chain AS k, l.n_edges AS own, c.a, l.n_edges AS ga, c.da, 0 AS qa, c.b, l.n_edges AS gb, c.db, 0 AS qb, 2L * l.part + 1 AS tag
FROM {chains} c JOIN {loops} l ON c.chain = l.loop WHERE NOT c.closed"""

_STEPS = """
SELECT {level} AS level, root.root AS part, p.chain AS loop, p.seq, p.k AS element, p.tag & 1 = 1 AS is_trail, p.len AS n_edges, p.closed,
       p.total, IF(p.r = 1, p.b, p.a) AS from_vid, IF(p.r = 1, p.a, p.b) AS to_vid
FROM {places} p JOIN {root} root ON shiftright(p.tag, 1) = root.part"""


def partition_tour(
    g: DataFrame,
    vp: DataFrame,
    mt: DataFrame | None = None,
    scratch: Scratch | None = None,
    group_rows: int = GROUP_ROWS,
    check: bool = True,
) -> Tour:
    """Trails of all levels of an even graph, along ``mt`` or the heaviest-first merge tree."""
    spark = g.sparkSession
    scratch = scratch or Scratch.of(spark)
    if check:
        require_even(g)
    parted = scratch.save(attach_partition(g, vp), "parted")
    tree = mt if mt is not None else merge_tree(meta_graph(parted, vp), scratch)
    height = tree_height(tree)
    roots = scratch.save(part_roots(tree, vp), "roots")
    leveled = edge_levels(parted, vp, roots=roots, scratch=scratch).withColumn("level", F.coalesce("level", F.lit(height + 1)))
    edges, seen = scratch.save(
        leveled, "edges", by="level", **{f"n{i}": F.count_if(F.col("level") == i) for i in range(height + 1)})
    classes = scratch.save(level_classes(edges, roots, height), "classes")
    hot = hot_groups_of(classes, group_rows)
    loops, steps, ends, links, trails = [], [], [], [], None
    for level in range(height + 1):
        elements, n = spark.sql(_EDGES, edges=edges, level=level), seen[f"n{level}"]
        if trails is not None:
            trails, met = scratch.save(trails, "trail-bodies", n=F.count(F.lit(1)))
            elements, n = elements.unionByName(trails), n + met["n"]
        places, chains, linked = rank_chains(salted(elements, hot), scratch, n)
        # elements of one loop have the same root; there are few parts, and the planner sees that
        placed = places.withColumn("seq", start_of("len")).withColumn("total", chain_length())
        root = roots.filter(F.col("level") == level).select("part", "root")
        steps.append(scratch.save(spark.sql(_STEPS, places=placed, root=root, level=level), "steps"))
        # a loop is named by one of its elements
        loops.append(scratch.save(steps[-1].filter("element = loop").select(
            "level", "part", "loop", "closed", F.col("total").alias("n_edges")), "loops"))
        trails = spark.sql(_TRAILS, chains=chains, loops=loops[-1])
        ends.append(chains.filter("NOT closed").selectExpr(
            f"{level} AS level", "chain AS loop", "inline(array(struct(0 AS side, a AS vid), struct(1 AS side, b AS vid)))"))
        links.append(linked.withColumn("link", F.lit(level)))
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    paired = edges.join(spark.sql(_MATES, links=union(links)), "eid", "left")
    return Tour(
        tree, roots, height, edges, paired, spark.sql(_DARTS, links=paired), classes, union(loops), union(steps), union(ends), scratch
    )


def hot_groups_of(classes: DataFrame, cap: int) -> DataFrame | None:
    """Vertices with more than ``cap`` edges that become local, and the number of salts each needs, or None without any."""
    size = classes.groupBy("vid").agg(F.max("n_local").alias("_rows"))
    return few_hot(size, ["vid"], cap)


# The steps of a level in the closed trails of the last one: those of open trails by the place of their trail, ``above``.
_PLACED = """
SELECT s.loop AS chain, s.total AS whole, s.seq AS at, 0 AS r, s.element, s.is_trail, s.n_edges, s.from_vid, s.to_vid
FROM {steps} s WHERE s.closed
UNION ALL
SELECT u.chain, u.whole, u.at + IF(u.r = 1, s.total - s.seq - s.n_edges, s.seq), u.r, s.element, s.is_trail, s.n_edges,
       IF(u.r = 1, s.to_vid, s.from_vid), IF(u.r = 1, s.from_vid, s.to_vid)
FROM {steps} s JOIN {above} u ON s.loop = u.loop WHERE NOT s.closed"""

# Where the trails of the level before are placed, and if they are walked from their second end.
_ABOVE = """
SELECT p.element AS loop, p.chain, p.whole, p.at, IF(p.from_vid = e.vid, 0, 1) AS r
FROM {placed} p JOIN {ends} e ON p.element = e.loop WHERE p.is_trail AND e.side = 0 AND e.level = {below}"""


def ranked_steps(tour: Tour) -> DataFrame:
    """``(chain, seq, total, eid, from_vid, to_vid)``: every edge at its place in the closed trail that it is part of at last.

    From the last level down, the steps of an open trail are placed by the place of that trail; nothing is ranked again.
    """
    spark, scratch = tour.scratch.spark, tour.scratch
    above = spark.createDataFrame([], "loop long, chain long, whole long, at long, r int")
    edges = []
    for level in reversed(range(tour.height + 1)):
        placed = scratch.save(spark.sql(_PLACED, steps=tour.steps.filter(F.col("level") == level), above=above), "placed")
        edges.append(placed.filter("NOT is_trail"))
        above = spark.sql(_ABOVE, placed=placed, ends=tour.ends, below=level - 1)
    return reduce(DataFrame.unionByName, edges).select(
        "chain", F.col("at").alias("seq"), F.col("whole").alias("total"), F.col("element").alias("eid"), "from_vid", "to_vid")


def tour_circuit(tour: Tour, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The circuit of each component, made of the tour's own trails by splicing the closed ones."""
    if tour.ends.filter(F.col("level") == tour.height).limit(1).count() or tour.edges.filter(F.col("level") > tour.height).limit(1).count():
        raise ValueError("the merge tree leaves trails open: there is no circuit of them")
    return circuit_of_trails(ranked_steps(tour), tour.scratch, group_rows)


def trail_table(tour: Tour) -> DataFrame:
    """``(level, part, trail_id, loop, kind, source, sink, n_edges)``, one row per loop.

    An open trail runs between two odd boundary vertices. A closed one belongs to the smallest even
    boundary vertex on it, if any; closed trails of one owner meet there and form one trail. An even
    boundary vertex that owns none has a trail without edges (``loop`` is null).
    """
    even = tour.classes.filter("vtype = 'EB'").select("level", F.col("vid").alias("from_vid"), F.lit(True).alias("eb"))
    closed = tour.loops.filter("closed").select("level", "part", "loop", "n_edges")
    owners = (
        tour.steps.join(closed.select("level", "loop"), ["level", "loop"], "left_semi")
        .select("level", "loop", "from_vid").distinct()
        .join(even, ["level", "from_vid"], "left")
        .groupBy("level", "loop")
        .agg(F.min(F.when(F.col("eb"), F.col("from_vid"))).alias("owner"), F.min("from_vid").alias("first"))
    )
    rings = closed.join(owners, ["level", "loop"])
    fused = rings.filter("owner IS NOT NULL").groupBy("level", "owner").agg(F.min("loop").alias("trail_id"))
    rings = rings.join(fused, ["level", "owner"], "left").selectExpr(
        "level", "part", "coalesce(trail_id, loop) AS trail_id", "loop",
        "IF(owner IS NULL, 'IN', 'EB') AS kind", "coalesce(owner, first) AS source",
        "cast(null AS long) AS sink", "n_edges",
    )
    tips = tour.ends.groupBy("level", "loop").agg(
        F.max(F.expr("IF(side = 0, vid, null)")).alias("source"),
        F.max(F.expr("IF(side = 1, vid, null)")).alias("sink"),
    )
    paths = tour.loops.filter("NOT closed").join(tips, ["level", "loop"]).selectExpr(
        "level", "part", "loop AS trail_id", "loop", "'OB' AS kind", "source", "sink", "n_edges"
    )
    lone = (
        tour.classes.filter("vtype = 'EB'").select("level", "part", "vid")
        .join(fused.select("level", F.col("owner").alias("vid")), ["level", "vid"], "left_anti")
        .selectExpr(
            "level", "part", "-1 - vid AS trail_id", "cast(null AS long) AS loop", "'EB' AS kind",
            "vid AS source", "cast(null AS long) AS sink", "cast(0 AS long) AS n_edges",
        )
    )
    return paths.unionByName(rings).unionByName(lone)


def spliced_steps(tour: Tour, trails: DataFrame | None = None) -> DataFrame:
    """Steps of even boundary trails ``(level, part, trail_id, seq, element, is_trail, n_edges, total, from_vid, to_vid)``.

    All rings of one owner are one closed walk: each is turned to begin at the owner, and they follow
    each other in the order of their ids, so ``seq`` counts edges over the whole trail.
    """
    trails = trail_table(tour) if trails is None else trails
    rings = trails.filter("kind = 'EB' AND loop IS NOT NULL").select("level", "loop", "trail_id", "source", F.col("n_edges").alias("_n"))
    mine = Window.partitionBy("level", "trail_id")
    rings = rings.withColumn("_base", F.coalesce(
        F.sum("_n").over(mine.orderBy("loop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rings = rings.withColumn("_whole", F.sum("_n").over(mine))
    steps = tour.steps.join(rings, ["level", "loop"])
    first = steps.filter("from_vid = source").groupBy("level", "loop").agg(F.min("seq").alias("_first"))
    return steps.join(first, ["level", "loop"]).select(
        "level", "part", "trail_id", (F.col("_base") + F.pmod(F.col("seq") - F.col("_first"), F.col("_n"))).alias("seq"),
        "element", "is_trail", "n_edges", F.col("_whole").alias("total"), "from_vid", "to_vid")


def local_trails(tour: Tour, kind: str, level: int = 0, trails: DataFrame | None = None) -> DataFrame:
    """Trails of one kind (``OB``, ``EB`` or ``IN``) at one level; level 0 is inside the partitions."""
    trails = trail_table(tour) if trails is None else trails
    return (
        trails.filter((F.col("kind") == kind) & (F.col("level") == level))
        .groupBy("level", "part", "trail_id", "kind", "source", "sink")
        .agg(F.sum("n_edges").alias("n_edges"))
    )


def trail_vertices(tour: Tour, trails: DataFrame) -> DataFrame:
    """Distinct ``(level, part, vid, trail_id, kind)``: which trails touch which vertices."""
    on_steps = tour.steps.selectExpr(
        "level", "loop", "inline(array(struct(from_vid AS vid), struct(to_vid AS vid)))"
    ).distinct()
    named = trails.filter("loop IS NOT NULL").select("level", "part", "loop", "trail_id", "kind")
    lone = trails.filter("loop IS NULL").selectExpr("level", "part", "source AS vid", "trail_id", "kind")
    return (
        on_steps.join(named, ["level", "loop"])
        .select("level", "part", "vid", "trail_id", "kind").distinct().unionByName(lone)
    )


def attach_internal_cycles(tour: Tour, trails: DataFrame | None = None) -> DataFrame:
    """``(level, part, cycle, host)``: the boundary trail that each internal cycle is reached from.

    Cycles that share vertices form clusters; a cluster goes to the smallest trail it touches, and
    has a null host if it touches none.
    """
    trails = trail_table(tour) if trails is None else trails
    touch = tour.scratch.save(trail_vertices(tour, trails), "touch")
    cycles = touch.filter("kind = 'IN'").selectExpr("level", "part", "vid", "trail_id AS obj")
    roots = meeting_roots(cycles, ["level", "vid"], tour.scratch)
    hosts = touch.filter("kind <> 'IN'").groupBy("level", "vid").agg(F.min("trail_id").alias("host"))
    rooted = cycles.join(roots, "obj", "left").withColumn("root", F.coalesce("root", "obj"))
    reached = rooted.join(hosts, ["level", "vid"]).groupBy("level", "root").agg(F.min("host").alias("host"))
    members = rooted.select("level", "part", "obj", "root").distinct()
    return members.join(reached, ["level", "root"], "left").select("level", "part", F.col("obj").alias("cycle"), "host")


def pivot_vertices(
    tour: Tour, trails: DataFrame | None = None, attached: DataFrame | None = None
) -> DataFrame:
    """``(level, part, vid, vtype, trail_id)``: all trails through boundary vertices and through
    internal vertices on more than one; a cycle counts under its host's id."""
    trails = trail_table(tour) if trails is None else trails
    attached = attach_internal_cycles(tour, trails) if attached is None else attached
    hosts = attached.selectExpr("level", "cycle AS trail_id", "host")
    through = (
        trail_vertices(tour, trails).join(hosts, ["level", "trail_id"], "left")
        .select("level", "vid", F.coalesce("host", "trail_id").alias("trail_id")).distinct()
        .join(tour.classes.select("level", "part", "vid", "vtype"), ["level", "vid"])
    )
    # two counts that combine before their shuffle: no vertex's trails are brought together
    several = through.filter("vtype = 'IN'").groupBy("level", "vid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    inside = through.filter("vtype = 'IN'").join(several.drop("n"), ["level", "vid"], "left_semi")
    return through.filter("vtype <> 'IN'").unionByName(inside).select("level", "part", "vid", "vtype", "trail_id")


def trail_ends(tour: Tour, trails: DataFrame | None = None) -> DataFrame:
    """``(level, part, trail_id, end, vid, other)``: two rows for an open trail, one for a closed one
    at an even boundary vertex."""
    trails = trail_table(tour) if trails is None else trails
    bounds = trails.filter("kind <> 'IN'").select("level", "part", "trail_id", "source", "sink").distinct()
    return bounds.selectExpr(
        "level", "part", "trail_id",
        "inline(filter(array(struct('source' AS end, source AS vid, sink AS other),"
        " struct('sink' AS end, sink AS vid, source AS other)), x -> x.vid IS NOT NULL))",
    )


def _cut_darts(tour: Tour, vids: DataFrame | None = None) -> DataFrame:
    """``(dart, vid, nbr, part, hpart, level)`` of edges between parts, those of ``vids`` only if they are given."""
    rows = bidirect(tour.edges.filter("level > 0")).select(
        "dart", F.col("tail").alias("vid"), F.col("head").alias("nbr"), "part", "hpart", "level")
    return rows if vids is None else rows.join(vids, "vid", "left_semi")


def remote_darts(tour: Tour, vids: DataFrame | None = None) -> DataFrame:
    """``(level, part, vid, rpart, nbr)``: neighbours still in another part, by the merged part."""
    levels = F.sequence(F.lit(0), F.least(F.col("level") - 1, F.lit(tour.height)))
    rows = _cut_darts(tour, vids).withColumn("level", F.explode(levels))
    own = tour.roots.selectExpr("level", "part", "root AS _own")
    far = tour.roots.selectExpr("level", "part AS hpart", "root AS rpart")
    return rows.join(own, ["level", "part"]).join(far, ["level", "hpart"]).selectExpr(
        "level", "_own AS part", "vid", "rpart", "nbr", "dart"
    )


def end_remotes(tour: Tour, trails: DataFrame | None = None, vids: DataFrame | None = None) -> DataFrame:
    """Trail ends with their remote neighbours: ``(level, part, trail_id, end, vid, other, rpart, nbr, dart)``."""
    return trail_ends(tour, trails).join(remote_darts(tour, vids), ["level", "part", "vid"])


def boundary_count(trails: DataFrame) -> DataFrame:
    """Path ends that each part carries on: two for an open trail, one at an even boundary vertex."""
    ends = trails.filter("kind <> 'IN'").select("level", "part", "trail_id", "sink").distinct()
    return ends.groupBy("level", "part").agg(F.sum(F.expr("IF(sink IS NULL, 1L, 2L)")).alias("path_ends"))


def trail_report(trails: DataFrame) -> DataFrame:
    """Trails and edges by level, part and kind."""
    return trails.groupBy("level", "part", "kind").agg(
        F.count_distinct("trail_id").alias("trails"), F.sum("n_edges").alias("edges")
    )


def relabel_remote(pa: DataFrame, pairs: DataFrame, list_rows: int = GROUP_ROWS) -> DataFrame:
    """Partitioned adjacency after a merge: remote neighbours move to the surviving part's entry.

    The own part keeps its id and the partner's entry stays remote; ``merged_vertices`` says what
    becomes local.
    """
    roots = Scratch.of(pa.sparkSession).save(pair_roots(pairs), "pair-roots")  # small, and known to be
    far = pa.select("part", "vid", "chunk", F.explode("remote").alias("_p", "_l")).join(
        roots.withColumnRenamed("part", "_p"), "_p", "left"
    ).withColumn("_p", F.coalesce("root", "_p"))
    merged = far.groupBy("part", "vid", "chunk", "_p").agg(F.array_sort(F.flatten(F.collect_list("_l"))).alias("_l"))
    maps = merged.groupBy("part", "vid", "chunk").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_p", "_l")))).alias("_remote")
    )
    return pa.join(maps, ["part", "vid", "chunk"], "left").select(
        "part", "vid", "chunk", "local", F.coalesce("_remote", "remote").alias("remote")
    )


def merged_vertices(tour: Tour) -> DataFrame:
    """The vertex table of every merge: ``(level, part, vid, vtype, n_new, n_trail_ends, n_remote)``.

    ``n_new`` neighbours become local; an open trail of the level before counts as one edge at each
    of its two ends.
    """
    before = tour.ends.groupBy((F.col("level") + 1).alias("level"), "vid").agg(F.count(F.lit(1)).alias("n_trail_ends"))
    return tour.classes.filter("level > 0").join(before, ["level", "vid"], "left").select(
        "level", "part", "vid", "vtype", "n_new", F.coalesce("n_trail_ends", F.lit(0)).alias("n_trail_ends"), "n_remote"
    )


def pass_through(tree: DataFrame) -> DataFrame:
    """``(level, part)``: merged parts that had no partner at a level and keep their trails."""
    return tree.filter("part_b IS NULL").selectExpr("level", "part_a AS part")


def level_report(tour: Tour) -> DataFrame:
    """Per level and part: vertices by class, open trails, and cut edges that are left."""
    counts = tour.classes.groupBy("level", "part").agg(
        *[F.count_if(F.col("vtype") == t).alias(n) for t, n in (("OB", "odd_boundary"), ("EB", "even_boundary"), ("IN", "internal"))],
        F.sum("n_remote").alias("cut_edges"),
    )
    opened = tour.loops.filter("NOT closed").groupBy("level", "part").agg(F.count(F.lit(1)).alias("open_trails"))
    return counts.join(opened, ["level", "part"], "left").withColumn("open_trails", F.coalesce("open_trails", F.lit(0)))


#: Darts between parts whose vertices a task brings together with their trail ends.
LIST_TASK_ROWS = 500_000
_LIST_ROWS = 1 << 14
_LISTS = pa.schema([
    ("level", pa.int32()), ("part", pa.int32()), ("trail_id", pa.int64()), ("end", pa.string()), ("vid", pa.int64()),
    ("other", pa.int64()), ("chunk", pa.int32()), ("remote", pa.map_(pa.int32(), pa.list_(pa.int64())))])


def _lists_at_ends(parts: np.ndarray, roots: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The remote neighbours of all trail ends that a task holds, by part; ``roots`` has a row for each level."""
    full = [b for b in batches if b.num_rows]
    if not full:
        return
    held = pa.Table.from_batches(full).combine_chunks()
    is_end = held.column("is_end").to_numpy()
    darts, ends = held.filter(pa.array(~is_end)), held.filter(pa.array(is_end))
    column = lambda table, c: table.column(c).to_numpy()
    order = np.lexsort((column(darts, "of"), column(darts, "vid")))
    vid, nbr, top = (column(darts, c)[order] for c in ("vid", "of", "level"))
    place = lambda c: np.searchsorted(parts, column(darts, c)[order])
    own, far = place("part"), place("side")
    for level, root in enumerate(roots):
        mine = ends.filter(pa.array(column(ends, "level") == level))
        cut = np.flatnonzero(top > level)
        if not len(cut) or not mine.num_rows:
            continue
        rpart = root[far[cut]]
        cut = cut[np.lexsort((rpart, vid[cut]))]  # stable: neighbours stay in order
        rpart = root[far[cut]]
        new_vid = np.append(True, vid[cut][1:] != vid[cut][:-1])
        new_list = new_vid | np.append(True, rpart[1:] != rpart[:-1])
        starts = np.flatnonzero(new_list)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(cut)), pa.int32()), pa.array(nbr[cut], pa.int64()))
        of_vid = np.append(np.flatnonzero(new_vid[starts]), len(starts))
        maps = pa.MapArray.from_arrays(pa.array(of_vid, pa.int32()), pa.array(rpart[starts], pa.int32()), lists)
        first = np.flatnonzero(new_vid)
        here = vid[cut][first]
        at = np.minimum(np.searchsorted(here, column(mine, "vid")), len(here) - 1)
        meets = (here[at] == column(mine, "vid")) & (root[own[cut][first]][at] == column(mine, "part"))
        mine, at = mine.filter(pa.array(meets)), at[meets]
        names = pa.array(["source", "sink"]).take(mine.column("side").combine_chunks())
        for a in range(0, len(at), _LIST_ROWS):
            some = mine.slice(a, _LIST_ROWS)
            flat = lambda c: some.column(c).combine_chunks()
            yield pa.record_batch([
                flat("level"), flat("part"), flat("of"), names.slice(a, _LIST_ROWS), flat("vid"), flat("other"),
                pa.array(np.zeros(some.num_rows, np.int32)), maps.take(pa.array(at[a:a + _LIST_ROWS]))], schema=_LISTS)


def part_lists(tour: Tour, trails: DataFrame | None = None, list_rows: int = GROUP_ROWS) -> DataFrame:
    """``end_remotes`` collected: ``(level, part, trail_id, end, vid, other, chunk, remote)``.

    A vertex has the same neighbours at all of its ends, and at a level those of the level before but for what became local. So
    darts are shuffled once for all levels, to where the vertex's ends are, and no row of ``end_remotes`` is made of them. Only
    the ends of a vertex of more than ``list_rows`` have several chunks, ranked over all tasks.
    """
    below = tour.classes.filter("level = 0")
    long, seen = tour.scratch.save(
        below.filter(F.col("n_remote") > list_rows).select("vid"), "long-groups", n=F.count(F.lit(1)))
    some = below.agg(F.sum("n_remote")).first()[0] or 0
    darts = _cut_darts(tour).selectExpr(
        "vid", "cast(level AS int) AS level", "part", "hpart AS side", "nbr AS of", "cast(null AS long) AS other", "false AS is_end")
    ends = trail_ends(tour, trails).selectExpr(
        "vid", "cast(level AS int) AS level", "part", "IF(end = 'sink', 1, 0) AS side", "trail_id AS of", "other", "true AS is_end")
    meeting = darts.unionByName(ends)
    if seen["n"]:
        meeting = meeting.join(long, "vid", "left_anti")
    known = tour.roots.collect()  # a row for each part and level
    parts = sorted({r["part"] for r in known})
    roots = np.zeros((tour.height + 1, len(parts)), np.int32)
    for r in known:
        roots[r["level"], np.searchsorted(parts, r["part"])] = r["root"]
    tasks = max(1, -(-some // LIST_TASK_ROWS))
    columns = "level int, part int, trail_id long, end string, vid long, other long, chunk int, remote map<int,array<long>>"
    lists = meeting.repartition(tasks, "vid").coalesce(tasks).mapInArrow(partial(_lists_at_ends, np.array(parts, np.int64), roots), columns)
    if not seen["n"]:
        return lists
    keys = ["level", "part", "trail_id", "end", "vid", "other"]
    chunks = ordered_chunks(end_remotes(tour, trails, long), ["level", "trail_id", "end"], ["rpart", "nbr", "dart"], list_rows, tour.scratch)
    each = chunks.groupBy(*keys, "chunk", "rpart").agg(F.array_sort(F.collect_list("nbr")).alias("_l"))
    return lists.unionByName(each.groupBy(*keys, "chunk").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rpart", "_l")))).alias("remote")))
