"""Whole jobs: from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphtrails.operators.circuit import euler_circuit
from graphtrails.operators.eulerize import eulerize
from graphtrails.operators.partition import Tour, partition_tour, trail_table
from graphtrails.operators.skew import ordered_chunks
from graphtrails.operators.tables import (
    absolute_parts,
    adjacency,
    adjacency_degrees,
    adjacency_to_edges,
    flatten_partitioned,
    group_remote_by_part,
    partition_map_gaps,
    partitioned_darts,
    remap_adjacency,
    renumber_vertices,
    split_local_remote,
    unique_parts,
)
from graphtrails.scratch import Scratch
from graphtrails.sources.binary import (
    read_adjacency_binary,
    read_partitioned_binary,
    read_vertex_map,
    write_adjacency_binary,
    write_partitioned_binary,
    write_vertex_map,
)
from graphtrails.sources.text import (
    csr_tables,
    partitioned_lines,
    read_adjacency_text,
    read_edge_list,
    read_partition_map_lines,
    read_partition_map_pairs,
    read_partitioned_text,
    write_adjacency_blogel,
    write_adjacency_csv,
    write_lines,
    write_metis_text,
    write_trails,
)

MAP_FORMATS = ("lines", "pairs")


def _edges_of_pairs(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Each undirected edge of directed pairs ``(src, dst)`` once, with ids."""
    counts = pairs.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("src") < F.col("dst")).alias("_up"))
    say = lambda what: F.raise_error(F.concat(F.lit(what), F.concat_ws(" - ", F.col("u").cast("string"), F.col("v").cast("string")))).cast("long")
    copies = F.when((F.col("u") == F.col("v")) & (F.col("n") % 2 == 1), say("self-loop listed an odd number of times: ")).when(
        (F.col("u") != F.col("v")) & (2 * F.col("_up") != F.col("n")), say("edge not listed from both ends alike: ")
    ).otherwise(F.expr("n div 2"))
    edges = counts.select("u", "v", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_c"))
    return scratch.save(edges.select(F.monotonically_increasing_id().alias("eid"), "u", "v"), "edges")


def edges_of_adjacency(adj: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Each undirected edge of an adjacency table once, with ids.

    A pair adjacent ``n`` times makes ``n`` edges; a self-loop is listed twice. Lists that don't agree from
    both ends are an error, and so is a self-loop listed an odd number of times.
    """
    return _edges_of_pairs(adjacency_to_edges(adj), scratch or Scratch.of(adj.sparkSession))


def graph_of_partitioned(pa: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and partition map of a partitioned adjacency; remotes must name the part that their vertex is in."""
    scratch = scratch or Scratch.of(pa.sparkSession)
    darts = partitioned_darts(pa)
    edges = _edges_of_pairs(darts.select(F.col("vid").alias("src"), F.col("nbr").alias("dst")), scratch)
    named = pa.select("vid", "part").unionByName(darts.select(F.col("nbr").alias("vid"), F.col("npart").alias("part")))
    return edges, scratch.save(unique_parts(named), "parts")


EDGE_FORMATS = ("edges", "adjacency_text", "adjacency_binary")


def edges_to_euler_graph(
    spark: SparkSession, path: str, out: str, sep: str = "\t", format: str = "edges", **matching
) -> DataFrame:
    """Edge list, adjacency text or adjacency binary to the binary adjacency of an even graph; returns the manifest."""
    scratch = Scratch.of(spark)
    if format == "edges":
        g = read_edge_list(spark, path, sep, scratch)
    elif format == "adjacency_text":
        g = edges_of_adjacency(read_adjacency_text(spark, path), scratch)
    elif format == "adjacency_binary":
        g = edges_of_adjacency(read_adjacency_binary(spark, path), scratch)
    else:
        raise ValueError(f"format must be one of {EDGE_FORMATS}")
    return write_adjacency_binary(adjacency(eulerize(g, scratch=scratch, **matching)), out)


PARTITIONED_FORMATS = ("binary", "parts", "plain")


def tour_of_file(
    spark: SparkSession, path: str, out: str, format: str = "binary", map_path: str | None = None
) -> Tour:
    """Partitioned adjacency files to the trails of every merge level, as tables below ``out``.

    ``plain`` text has no parts of remotes and needs a partition map of lines ``vid part``. Written are
    ``trails`` (one row per loop) and ``steps`` in walking order.
    """
    scratch = Scratch.of(spark)
    if format == "binary":
        pa = read_partitioned_binary(spark, path)
    elif format in PARTITIONED_FORMATS:
        pa = read_partitioned_text(spark, path, format)
    else:
        raise ValueError(f"format must be one of {PARTITIONED_FORMATS}")
    if format == "plain":
        if map_path is None:
            raise ValueError("remotes without parts need a partition map")
        pa = group_remote_by_part(pa, unique_parts(read_partition_map_pairs(spark, map_path)))
    g, parts = graph_of_partitioned(scratch.save(pa, "partitioned"), scratch)
    tour = partition_tour(g, parts, scratch=scratch)
    trail_table(tour).write.parquet(f"{out}/trails")
    order = ["level", "loop", "seq"]
    tour.steps.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{out}/steps")
    return tour


def export_for_partitioner(
    adj: DataFrame, out: str, metis: bool = True, csr: bool = False, relabelled: bool = False
) -> DataFrame:
    """Write the vertex map, and on request the graph in dense ids; returns the vertex map."""
    scratch = Scratch.of(adj.sparkSession)
    vm = scratch.save(renumber_vertices(adj, scratch), "vertex-map")
    write_vertex_map(vm, f"{out}/vertex_map")
    if metis or csr or relabelled:
        rel = scratch.save(remap_adjacency(adj, vm), "relabelled")
        if metis:
            write_metis_text(rel, f"{out}/metis")
        if csr:
            offsets, targets = csr_tables(rel, scratch)
            for name, table in (("csr_offsets", offsets), ("csr_targets", targets)):
                table.write.parquet(f"{out}/{name}")
        if relabelled:
            write_adjacency_binary(rel, f"{out}/relabelled")
    return vm


def import_partitioning(
    spark: SparkSession, adj_path: str, map_path: str, out: str,
    vertex_map_path: str | None = None, format: str = "lines", splits: int = 8,
) -> DataFrame:
    """Attach a partitioner's answer to a binary adjacency and write it split; returns the manifest.

    ``lines`` maps are by dense id and need the vertex map; ``pairs`` maps are by dense id with a
    vertex map and by vertex id without.
    """
    if format not in MAP_FORMATS:
        raise ValueError(f"format must be one of {MAP_FORMATS}")
    if format == "lines" and vertex_map_path is None:
        raise ValueError("a map by line number needs the vertex map")
    scratch = Scratch.of(spark)
    g = edges_of_adjacency(read_adjacency_binary(spark, adj_path), scratch)
    if format == "lines":
        parts = read_partition_map_lines(spark, map_path, scratch)
    else:
        parts = read_partition_map_pairs(spark, map_path)
        if vertex_map_path is not None:
            parts = parts.withColumnRenamed("vid", "rel_vid")
    if vertex_map_path is not None:
        vm = scratch.save(read_vertex_map(spark, vertex_map_path), "vertex-map")
        gaps = partition_map_gaps(vm, parts).limit(1).collect()
        if gaps:
            raise ValueError(f"vertex map and partition map differ, first at dense id {gaps[0]['rel_vid']}")
        parts = absolute_parts(parts, vm)
    return write_partitioned_binary(split_local_remote(g, scratch.save(parts, "parts")), out, splits)


def circuit_of_file(spark: SparkSession, path: str, out: str) -> None:
    """Binary adjacency of an even graph to its circuits as a table in walking order."""
    scratch = Scratch.of(spark)
    g = edges_of_adjacency(read_adjacency_binary(spark, path), scratch)
    write_trails(euler_circuit(g, scratch), out, "component")


# --- one graph file to another ---------------------------------------------------------------------


def adjacency_text_to_binary(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Adjacency text to binary adjacency; returns the manifest."""
    return write_adjacency_binary(read_adjacency_text(spark, path), out)


def keep_even_vertices(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The vertices of even degree of a binary adjacency, with their lists; returns the manifest."""
    adj = Scratch.of(spark).save(read_adjacency_binary(spark, path), "adjacency")
    odd = adjacency_degrees(adj).filter(F.col("degree") % 2 == 1)
    return write_adjacency_binary(adj.join(odd, "vid", "left_anti"), out)


def flatten_partitioned_file(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Partitioned binary to binary adjacency without parts, every list in order; returns the manifest."""
    return write_adjacency_binary(_in_order(flatten_partitioned(read_partitioned_binary(spark, path))), out)


def canonical_file(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Binary adjacency with vertices and neighbours ascending, so that equal graphs are equal files; returns the manifest."""
    return write_adjacency_binary(_in_order(read_adjacency_binary(spark, path)), out)


def _in_order(adj: DataFrame) -> DataFrame:
    """Lists in order, over all the rows that a vertex has."""
    each = adj.select("vid", F.col("chunk").alias("_old"), F.posexplode_outer("nbrs").alias("_pos", "nbr"))
    each = Scratch.of(adj.sparkSession).save(each, "listed")
    return ordered_chunks(each, ["vid"], ["nbr", "_old", "_pos"]).groupBy("vid", "chunk").agg(F.array_sort(F.collect_list("nbr")).alias("nbrs"))


def meta_graph_of_file(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Partitioned binary to the table of cut edges between parts; returns it."""
    pa = read_partitioned_binary(spark, path)
    darts = Scratch.of(spark).save(partitioned_darts(pa), "darts")
    meta = darts.filter("part <> npart").groupBy(F.col("part").alias("src"), F.col("npart").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    meta.write.parquet(out)
    return spark.read.schema(meta.schema).parquet(out)


def adjacency_file_to_csv(spark: SparkSession, path: str, out: str, src_sep: str = ",", sink_sep: str = ",") -> None:
    write_adjacency_csv(_in_order(read_adjacency_binary(spark, path)), out, src_sep, sink_sep)


def adjacency_file_to_blogel(spark: SparkSession, path: str, out: str, src_sep: str = "\t", sink_sep: str = " ") -> None:
    write_adjacency_blogel(_in_order(read_adjacency_binary(spark, path)), out, src_sep, sink_sep)


def degrees_of_file(spark: SparkSession, path: str, out: str) -> None:
    """Binary adjacency to lines ``degree,vertices`` in order of degree."""
    counts = adjacency_degrees(read_adjacency_binary(spark, path)).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))
    write_lines(counts.select("degree", F.concat_ws(",", "degree", "vertices").alias("line")), out, ["degree"])


def partitioned_file_to_text(spark: SparkSession, path: str, out: str) -> None:
    """Partitioned binary to lines ``part:v l1,l2 p:r1,r2``, in order of part and vertex."""
    write_lines(partitioned_lines(read_partitioned_binary(spark, path)), out, ["part", "vid", "chunk"])
