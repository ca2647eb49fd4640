"""Reshaping: edges, darts, adjacency lists, numbering and partitioned adjacency.

Every edge ``eid`` has two darts, ``2*eid`` leaving ``u`` and ``2*eid + 1`` leaving ``v``. Adjacency
lists are one row per vertex; the neighbours of a vertex with more than ``list_rows`` of them are
spread over rows that differ in ``chunk``, so that no list outgrows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphtrails.functions.graph import first_dart
from graphtrails.operators.ranks import dense_rank
from graphtrails.operators.skew import GROUP_ROWS, ordered_chunks
from graphtrails.scratch import Scratch

ADJACENCY = "vid long, chunk int, nbrs array<long>"
PART_ADJACENCY = "part int, vid long, chunk int, local array<long>, remote map<int,array<long>>"


def bidirect(g: DataFrame) -> DataFrame:
    """Both directions of every edge; a self-loop gives two rows."""
    extra = [c for c in g.columns if c not in ("eid", "u", "v", "pu", "pv")]
    parted = "pu" in g.columns

    def side(n: int, tail: str, head: str, part: str, hpart: str) -> Column:
        fields = [
            (first_dart("eid") + F.lit(n)).alias("dart"),
            F.col("eid"),
            F.col(tail).alias("tail"),
            F.col(head).alias("head"),
        ]
        if parted:
            fields += [F.col(part).alias("part"), F.col(hpart).alias("hpart")]
        return F.struct(*fields, *[F.col(c) for c in extra])

    return g.select(
        F.inline(F.array(side(0, "u", "v", "pu", "pv"), side(1, "v", "u", "pv", "pu")))
    )


def adjacency(g: DataFrame, list_rows: int = GROUP_ROWS) -> DataFrame:
    """Sorted neighbours of every vertex, parallel edges kept; a longer list goes over several rows, in order."""
    darts = ordered_chunks(bidirect(g).select("tail", "head", "dart"), ["tail"], ["head", "dart"], list_rows)
    return darts.groupBy(F.col("tail").alias("vid"), "chunk").agg(
        F.sort_array(F.collect_list("head")).alias("nbrs")
    )


def adjacency_to_edges(adj: DataFrame) -> DataFrame:
    """Lists back to directed pairs ``(src, dst)``."""
    return adj.select(F.col("vid").alias("src"), F.explode("nbrs").alias("dst"))


def degrees(g: DataFrame) -> DataFrame:
    ends = g.select(F.explode(F.array("u", "v")).alias("vid"))  # reads no edge ids
    return ends.groupBy("vid").agg(F.count(F.lit(1)).alias("degree"))


def adjacency_degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("vid").agg(F.sum(F.size("nbrs").cast("long")).alias("degree"))


def degree_histogram(g: DataFrame) -> DataFrame:
    """Vertices per degree."""
    return degrees(g).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))


def split_by_parity(g: DataFrame, list_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Adjacency of the even and of the odd vertices."""
    adj = adjacency(g, list_rows)
    odd = degrees(g).filter(F.col("degree") % 2 == 1).select("vid")
    return adj.join(odd, "vid", "left_anti"), adj.join(odd, "vid", "left_semi")


def parity_counts(g: DataFrame) -> DataFrame:
    """Vertices and directed edges on the even and on the odd side."""
    return (
        degrees(g)
        .groupBy((F.col("degree") % 2).alias("parity"))
        .agg(F.count(F.lit(1)).alias("vertices"), F.sum("degree").alias("edges"))
    )


def odd_by_degree(g: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Odd vertices, highest degree first, numbered from 1 as ``pos``."""
    scratch = scratch or Scratch.of(g.sparkSession)
    odd = degrees(g).filter(F.col("degree") % 2 == 1)
    return dense_rank(odd, [F.col("degree").desc(), F.col("vid")], "pos", scratch)


def renumber_vertices(adj: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Dense ids ``rel_vid`` from 1, in the order of ``vid``."""
    scratch = scratch or Scratch.of(adj.sparkSession)
    return dense_rank(adj.select("vid").distinct(), [F.col("vid")], "rel_vid", scratch)


def _required(value: Column, vid: Column, what: str) -> Column:
    message = F.concat(F.lit(f"vertex without {what}: "), vid.cast("string"))
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(message).cast("long"))


def remap_adjacency(adj: DataFrame, vm: DataFrame, list_rows: int = GROUP_ROWS) -> DataFrame:
    """Adjacency in dense ids. A vertex that the map lacks is an error.

    Neighbours are mapped one per row, then collected again. Both joins have a key that is unique on
    the map's side, so a hub only makes one side's partition long, which adaptive execution splits.
    """
    src = vm.select("vid", F.col("rel_vid").alias("_src"))
    dst = vm.select(F.col("vid").alias("_nbr"), F.col("rel_vid").alias("_dst"))
    mapped = (
        adj.join(src, "vid", "left")
        .select(
            _required(F.col("_src"), F.col("vid"), "dense id").alias("rel_vid"),
            "chunk",
            F.posexplode_outer("nbrs").alias("_pos", "_nbr"),
        )
        .join(dst, "_nbr", "left")
        .withColumn(
            "_dst",
            F.when(F.col("_nbr").isNotNull(), _required(F.col("_dst"), F.col("_nbr"), "dense id")),
        )
    )
    mapped = Scratch.of(adj.sparkSession).save(mapped.select("rel_vid", F.col("chunk").alias("_old"), "_pos", "_dst"), "mapped")
    chunks = ordered_chunks(mapped, ["rel_vid"], ["_dst", "_old", "_pos"], list_rows)
    return chunks.groupBy(F.col("rel_vid").alias("vid"), "chunk").agg(
        F.sort_array(F.collect_list("_dst")).alias("nbrs")
    )


def missing_parts(g: DataFrame, vp: DataFrame) -> DataFrame:
    """Vertices of the graph that the partition map lacks."""
    return degrees(g).select("vid").join(vp.select("vid"), "vid", "left_anti")


def absolute_parts(rel_parts: DataFrame, vm: DataFrame) -> DataFrame:
    """Partition map by dense id to one by vertex id."""
    return rel_parts.join(vm, "rel_vid").select("vid", "part")


def partition_map_gaps(vm: DataFrame, rel_parts: DataFrame) -> DataFrame:
    """Dense ids that only one of the vertex map and the partition map has; empty if they agree."""
    left = vm.select("rel_vid", F.lit(True).alias("in_vertex_map"))
    right = rel_parts.select("rel_vid", F.lit(True).alias("in_partition_map"))
    return left.join(right, "rel_vid", "full").filter(
        F.col("in_vertex_map").isNull() | F.col("in_partition_map").isNull()
    )


def unique_parts(vp: DataFrame) -> DataFrame:
    """A partition map with one row per vertex; unlike parts of one vertex are an error."""
    unlike = F.raise_error(F.concat(F.lit("several parts for vertex "), F.col("vid").cast("string"))).cast("int")
    return vp.groupBy("vid").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).select(
        "vid", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.when(F.col("_lo").isNotNull(), unlike)).cast("int").alias("part"))


def attach_partition(g: DataFrame, vp: DataFrame, vm: DataFrame | None = None) -> DataFrame:
    """Edges with the parts ``pu``, ``pv`` of both ends. An end without part is an error.

    ``vp`` is keyed by vertex id, or by dense id when the vertex map ``vm`` is given. A vertex that it
    repeats counts once; with unlike parts it is an error. So both lookups keep the number of rows; the
    planner broadcasts the map when it is small.
    """
    if vm is not None:
        vp = absolute_parts(vp, vm)
    vp = unique_parts(vp)
    of_u = vp.select(F.col("vid").alias("u"), F.col("part").cast("int").alias("pu"))
    of_v = vp.select(F.col("vid").alias("v"), F.col("part").cast("int").alias("pv"))
    return (
        g.join(of_u, "u", "left")
        .join(of_v, "v", "left")
        .withColumn("pu", _required(F.col("pu"), F.col("u"), "part").cast("int"))
        .withColumn("pv", _required(F.col("pv"), F.col("v"), "part").cast("int"))
        .select(*g.columns, "pu", "pv")
    )


def split_local_remote(
    g: DataFrame, vp: DataFrame, vm: DataFrame | None = None, list_rows: int = GROUP_ROWS
) -> DataFrame:
    """Partitioned adjacency: neighbours in the same part, and the others by their part."""
    darts = bidirect(attach_partition(g, vp, vm))
    return collect_parts(darts.select("part", "tail", "hpart", "head", "dart"), ["dart"], list_rows)


def collect_parts(rows: DataFrame, ties: list[str], list_rows: int = GROUP_ROWS) -> DataFrame:
    """Group ``(part, tail, hpart, head)`` rows; a null head keeps a vertex without neighbours.

    In a list over several rows the local neighbours come first, then the others by their part. ``ties`` tell equal rows apart.
    """
    order = [F.coalesce(F.col("hpart") != F.col("part"), F.lit(False)), "hpart", "head", *ties]
    chunks = ordered_chunks(rows, ["part", "tail"], order, list_rows)
    by_part = chunks.groupBy("part", F.col("tail").alias("vid"), "chunk", "hpart").agg(
        F.sort_array(F.collect_list("head")).alias("_list")
    )
    return by_part.groupBy("part", "vid", "chunk").agg(
        F.flatten(F.collect_list(F.when(F.col("hpart") == F.col("part"), F.col("_list")))).alias("local"),
        F.map_from_entries(
            F.sort_array(
                F.collect_list(F.when(F.col("hpart") != F.col("part"), F.struct("hpart", "_list")))
            )
        ).alias("remote"),
    )


def group_remote_by_part(
    rows: DataFrame, vp: DataFrame | None = None, list_rows: int = GROUP_ROWS
) -> DataFrame:
    """``(part, vid, local, remote_ids)`` rows to partitioned adjacency.

    ``remote_ids`` are plain vertex ids, looked up in ``vp``; or, without ``vp``, structs
    ``(vid, part)``.
    """
    local = rows.select(
        "part", F.col("vid").alias("tail"), F.posexplode_outer("local").alias("_pos", "head")
    ).withColumn("hpart", F.when(F.col("head").isNotNull(), F.col("part")))
    remote = rows.select("part", F.col("vid").alias("tail"), F.posexplode("remote_ids").alias("_pos", "_r"))
    if vp is None:
        remote = remote.select("part", "tail", "_pos", F.col("_r.vid").alias("head"), F.col("_r.part").alias("hpart"))
    else:
        found = vp.select(F.col("vid").alias("_r"), F.col("part").cast("int").alias("hpart"))
        remote = (
            remote.join(found, "_r", "left")
            .select(
                "part", "tail", "_pos", F.col("_r").alias("head"),
                _required(F.col("hpart"), F.col("_r"), "part").cast("int").alias("hpart"),
            )
        )
    both = Scratch.of(rows.sparkSession).save(local.unionByName(remote), "listed")
    return collect_parts(both, ["_pos"], list_rows)


def partitioned_darts(pa: DataFrame) -> DataFrame:
    """Partitioned adjacency to rows ``(part, vid, nbr, npart)``; parallel edges stay."""
    local = pa.select("part", "vid", F.explode("local").alias("nbr"), F.col("part").alias("npart"))
    remote = pa.select("part", "vid", F.explode("remote").alias("npart", "_n")).select(
        "part", "vid", F.explode("_n").alias("nbr"), "npart"
    )
    return local.unionByName(remote)


def flatten_partitioned(pa: DataFrame) -> DataFrame:
    """Drop the parts: local and remote neighbours in one sorted list."""
    return pa.select(
        "vid",
        "chunk",
        F.array_sort(F.concat("local", F.flatten(F.map_values("remote")))).alias("nbrs"),
    )
