"""Text formats: readers as column expressions, writers as line columns.

``*_lines`` functions return ``(line, ...)`` with the columns to order by; ``write_lines`` writes them
in that order over many files whose names sort like their content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphtrails.functions.graph import join_longs
from graphtrails.operators.partition import Tour, part_lists
from graphtrails.operators.ranks import prefix_sum
from graphtrails.operators.tables import adjacency_degrees, degree_histogram
from graphtrails.scratch import Scratch

DIALECTS = ("parts", "plain")
#: A line ``(part,[v0, v1, ...])``, or a stretch of one.
_STRETCH = r"^(?:\s*\(\s*(-?\d+)\s*,\s*\[)?([-\d,\s]*)(\]\s*\)\s*)?$"


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", scratch: Scratch | None = None) -> DataFrame:
    """``edges(eid, u, v)`` from lines ``u <sep> v``; any other line, also one without a vertex, is an error.

    ``eid`` follows from the place of the line in its file split. The table is written here, so that
    ids are the same in every later scan.
    """
    scratch = scratch or Scratch.of(spark)
    pairs = spark.read.schema("u long, v long").csv(path, sep=sep, mode="FAILFAST")
    lacks = F.raise_error(F.lit("malformed line: an edge without a vertex")).cast("long")
    both = lambda c: F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.col(c)).otherwise(lacks).alias(c)
    return scratch.save(pairs.select(F.monotonically_increasing_id().alias("eid"), both("u"), both("v")), "edge-list")


def _whole(text: Column, kind: str = "long") -> Column:
    """A whole number; anything else is an error, whatever the session's ANSI mode."""
    number = F.trim(text).try_cast(kind)
    return F.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("malformed number: "), F.coalesce(text, F.lit("null")))).cast(kind))


def _longs(text: Column, sep: str) -> Column:
    """The numbers between separators; a missing text is an error."""
    there = F.when(text.isNotNull(), text).otherwise(F.raise_error(F.lit("malformed line: no list")).cast("string"))
    return F.transform(F.filter(F.split(there, sep), lambda x: F.trim(x) != ""), lambda x: _whole(x))


def read_adjacency_text(spark: SparkSession, path: str) -> DataFrame:
    """``adjacency`` from lines ``v:n1, n2``."""
    halves = F.split("value", ":", 2)
    return spark.read.text(path).filter("trim(value) <> ''").select(
        _whole(F.get(halves, 0)).alias("vid"), F.lit(0).alias("chunk"), _longs(F.get(halves, 1), ",").alias("nbrs")
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it, also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def remote_map(remotes: Column) -> Column:
    """List of structs ``(vid, part)`` to a map from part to sorted vertices, inside the row.

    The list is sorted once and cut where the part changes.
    """
    ranked = F.sort_array(F.transform(remotes, lambda x: F.struct(x["part"].alias("part"), x["vid"].alias("vid"))))

    def firsts(rows: Column) -> Column:
        places = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == 0) | (F.get(rows, i)["part"] != F.get(rows, i - 1)["part"]))

    def cut(rows: Column, first: Column) -> Column:
        end = lambda j: F.coalesce(F.get(first, j + 1), F.size(rows))
        return F.map_from_arrays(
            F.transform(first, lambda i: F.get(rows, i)["part"]),
            F.transform(first, lambda i, j: F.transform(F.slice(rows, i + 1, end(j) - i), lambda x: x["vid"])),
        )

    return _bound(ranked, lambda rows: _bound(firsts(rows), lambda first: cut(rows, first)))


def read_partitioned_text(spark: SparkSession, path: str, dialect: str = "parts") -> DataFrame:
    """Lines ``part@v&l1,l2#r1:p1,r2:p2``; the remote half may be missing, the local one empty.

    Dialect ``parts`` gives partitioned adjacency. In ``plain``, remotes have no part: the result is
    ``(part, vid, local, remote_ids)``, for ``group_remote_by_part`` with a partition map.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    head = F.split("value", "@", 2)
    body = F.split(F.get(head, 1), "&", 2)
    lists = F.split(F.get(body, 1), "#", 2)
    remote = F.coalesce(F.get(lists, F.lit(1)), F.lit(""))
    rows = spark.read.text(path).filter("trim(value) <> ''").select(
        _whole(F.get(head, 0), "int").alias("part"),
        _whole(F.get(body, 0)).alias("vid"),
        _longs(F.get(lists, 0), ",").alias("local"),
        remote.alias("_remote"),
    )
    if dialect == "plain":
        return rows.select("part", "vid", "local", _longs(F.col("_remote"), ",").alias("remote_ids"))
    fields = F.filter(F.split("_remote", ","), lambda x: F.trim(x) != "")
    structs = F.transform(
        fields,
        lambda x: F.struct(
            _whole(F.get(F.split(x, ":"), 0)).alias("vid"),
            _whole(F.get(F.split(x, ":"), 1), "int").alias("part"),
        ),
    )
    return rows.select(
        "part", "vid", F.lit(0).alias("chunk"), F.array_sort("local").alias("local"), remote_map(structs).alias("remote")
    )


def read_partition_map_lines(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """``(rel_vid, part)``: line ``k`` over all files in name order holds the part of dense vertex ``k``.

    Lines are numbered inside their file split; splits get their base from a running count.
    """
    scratch = scratch or Scratch.of(spark)
    lines = spark.read.text(path).select(
        _whole(F.col("value"), "int").alias("part"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_at"),
    )
    lines = scratch.save(lines, "partition-map")
    splits = lines.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    bases = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(bases, ["_file", "_at"]).select(
        (F.col("_base") + F.col("_id") - F.col("_first") + 1).alias("rel_vid"), "part"
    )


def read_partition_map_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``vertex_part`` from lines ``vid part ...``."""
    fields = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(
        _whole(F.get(fields, 0)).alias("vid"), _whole(F.get(fields, 1), "int").alias("part")
    )


def canonical_adjacency(adj: DataFrame) -> DataFrame:
    """Neighbours ascending in every row; the comparable form. Writers put the vertices in order."""
    return adj.select("vid", "chunk", F.array_sort("nbrs").alias("nbrs"))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def write_pieces(pieces: DataFrame, path: str, order: list[str]) -> None:
    """Write ``text`` in order, without line ends of its own, over files whose names sort like their content.

    A line may be made of pieces that several tasks write; the files after each other are the text.
    """
    from graphtrails.sources.binary import write_text  # which reads text's helpers

    write_text(pieces.repartitionByRange(*order).sortWithinPartitions(*order).select("text"), path)


def adjacency_csv_lines(adj: DataFrame, src_sep: str = ",", sink_sep: str = ",") -> DataFrame:
    """``v <src_sep> n1 <sink_sep> n2 ...``; a vertex without neighbours gets no separator."""
    vid = F.col("vid").cast("string")
    full = F.concat(vid, F.lit(src_sep), join_longs(F.col("nbrs"), sink_sep))
    return adj.select("vid", "chunk", F.when(F.size("nbrs") > 0, full).otherwise(vid).alias("line"))


def adjacency_blogel_lines(adj: DataFrame, src_sep: str = "\t", sink_sep: str = " ") -> DataFrame:
    """``v <src_sep> degree <sink_sep> n1 ...``; on every line of a vertex the degree is that of the whole vertex."""
    sinks = F.transform("nbrs", lambda x: x.cast("string"))
    degree = F.col("degree").cast("string")
    return adj.join(adjacency_degrees(adj), "vid").select(
        "vid", "chunk",
        F.concat(
            F.col("vid").cast("string"), F.lit(src_sep), F.array_join(F.concat(F.array(degree), sinks), sink_sep)
        ).alias("line"),
    )


def _pieces(adj: DataFrame, head: Column, sep: str) -> DataFrame:
    """``(vid, chunk, text)``: a vertex's line in as many pieces as its list has rows; the last one ends the line."""
    last = adj.groupBy("vid").agg(F.max("chunk").alias("_last"))
    lead = F.when(F.col("chunk") == 0, head).otherwise(F.lit(sep))
    end = F.when(F.col("chunk") == F.col("_last"), "\n").otherwise("")
    return adj.join(last, "vid").select("vid", "chunk", F.concat(lead, join_longs(F.array_sort("nbrs"), sep), end).alias("text"))


def adjacency_csv_pieces(adj: DataFrame, src_sep: str = ",", sink_sep: str = ",") -> DataFrame:
    """The lines of ``adjacency_csv_lines``, one for each vertex however long its list is, in pieces for ``write_pieces``."""
    vid = F.col("vid").cast("string")
    return _pieces(adj, F.when(F.size("nbrs") > 0, F.concat(vid, F.lit(src_sep))).otherwise(vid), sink_sep)


def adjacency_blogel_pieces(adj: DataFrame, src_sep: str = "\t", sink_sep: str = " ") -> DataFrame:
    """``v <src_sep> degree <sink_sep> n1 ...``, one line for each vertex, in pieces for ``write_pieces``."""
    head = F.concat(F.col("vid").cast("string"), F.lit(src_sep), F.col("degree").cast("string"))
    full = F.when(F.size("nbrs") > 0, F.concat(head, F.lit(sink_sep))).otherwise(head)
    return _pieces(adj.join(adjacency_degrees(adj), "vid"), full, sink_sep)


def write_adjacency_csv(adj: DataFrame, path: str, src_sep: str = ",", sink_sep: str = ",") -> None:
    write_pieces(adjacency_csv_pieces(adj, src_sep, sink_sep), path, ["vid", "chunk"])


def write_adjacency_blogel(adj: DataFrame, path: str, src_sep: str = "\t", sink_sep: str = " ") -> None:
    write_pieces(adjacency_blogel_pieces(adj, src_sep, sink_sep), path, ["vid", "chunk"])


def _remote_text(remote: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(remote)),
            lambda e: F.concat(e["key"].cast("string"), F.lit(":"), join_longs(e["value"]), F.lit(" ")),
        ),
        "",
    )


def partitioned_lines(pa: DataFrame) -> DataFrame:
    """``part:v l1,l2 p:r1,r2 p:r3`` with a space after every group."""
    local = F.when(F.size("local") > 0, F.concat(join_longs(F.col("local")), F.lit(" "))).otherwise(F.lit(""))
    head = F.concat(F.col("part").cast("string"), F.lit(":"), F.col("vid").cast("string"), F.lit(" "))
    return pa.select("part", "vid", "chunk", F.concat(head, local, _remote_text(F.col("remote"))).alias("line"))


def boundary_lines(tour: Tour, trails: DataFrame | None = None) -> DataFrame:
    """One line per trail end: ``part:v other p:r1,r2``; a closed trail's end has no ``other``."""
    lists = part_lists(tour, trails)
    other = F.when(F.col("other").isNotNull(), F.concat(F.col("other").cast("string"), F.lit(" "))).otherwise(F.lit(""))
    head = F.concat(F.col("part").cast("string"), F.lit(":"), F.col("vid").cast("string"), F.lit(" "))
    return lists.select("level", "part", "vid", "chunk", F.concat(head, other, _remote_text(F.col("remote"))).alias("line"))


def write_boundary_state(tour: Tour, path: str, trails: DataFrame | None = None) -> None:
    """``boundary_lines`` of every level, in a folder for each; an end with many neighbours has several lines."""
    boundary_lines(tour, trails).select("level", "line").write.partitionBy("level").text(path)


def read_boundary_state(spark: SparkSession, path: str) -> DataFrame:
    """``(level, part, vid, other, rpart, nbr)``: a row for each neighbour of an end; ``other`` is null at closed trails."""
    lines = spark.read.schema("value string, level int").text(path)
    wrong = F.raise_error(F.concat(F.lit("not a line of a trail end: "), "value"))
    # possessive: a group that may give back is matched by recursion, too deep for a long list
    good = F.col("value").rlike(r"^\d+:\d+ (?:\d+ )?+(?:\d+:\d+(?:,\d+)*+ )*+$")
    words = lines.select("level", F.split(F.when(good, F.rtrim("value")).otherwise(wrong.cast("string")), " ").alias("_w"))
    head, second = F.split(F.col("_w")[0], ":"), F.get("_w", F.lit(1))
    lone = F.coalesce(~second.contains(":"), F.lit(False))
    # what is the same for many rows is cut out before it is repeated, so no row drags or cuts a whole list again
    ends = words.select(
        "level", head[0].cast("int").alias("part"), head[1].cast("long").alias("vid"), F.when(lone, second).cast("long").alias("other"), "_w")
    entry = F.split("_e", ":")
    entries = F.explode(F.filter("_w", lambda x, i: (i > 0) & x.contains(":")))
    lists = ends.select("level", "part", "vid", "other", entries.alias("_e")).select(
        "level", "part", "vid", "other", entry[0].cast("int").alias("rpart"), entry[1].alias("_l"))
    return lists.select("level", "part", "vid", "other", "rpart", F.explode(F.split("_l", ",")).alias("nbr")).withColumn(
        "nbr", F.col("nbr").cast("long"))


def metis_lines(adj_rel: DataFrame) -> DataFrame:
    """``(rel_vid, line)``: row 0 holds vertices and edges, row ``k`` the neighbours of vertex ``k``.

    A line is one row here, so a vertex whose list is split over rows is an error; ``write_metis_text`` takes it.
    """
    split = F.raise_error(F.concat(F.lit("list too long for one row: vertex "), F.col("vid").cast("string")))
    body = adj_rel.select(
        F.when(F.col("chunk") == 0, F.col("vid")).otherwise(split.cast("long")).alias("rel_vid"),
        join_longs(F.array_sort("nbrs"), " ").alias("line"),
    )
    return _metis_header(adj_rel).unionByName(body)


def _metis_header(adj_rel: DataFrame) -> DataFrame:
    odd = F.raise_error(F.lit("odd number of directed edges")).cast("long")
    edges = F.coalesce(F.sum("degree"), F.lit(0))
    return adjacency_degrees(adj_rel).agg(
        F.lit(0).cast("long").alias("rel_vid"),
        F.concat_ws(
            " ", F.count(F.lit(1)).cast("string"),
            F.when(edges % 2 == 0, F.shiftright(edges, 1)).otherwise(odd).cast("string"),
        ).alias("line"),
    )


def write_metis_text(adj_rel: DataFrame, path: str) -> None:
    """The lines of ``metis_lines`` as files that follow each other; a vertex of any degree has one line, in pieces of its rows."""
    header = _metis_header(adj_rel).select(F.col("rel_vid").alias("vid"), F.lit(0).alias("chunk"), F.concat("line", F.lit("\n")).alias("text"))
    write_pieces(header.unionByName(_pieces(adj_rel, F.lit(""), " ")), path, ["vid", "chunk"])


def csr_tables(adj_rel: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """``csr_offsets(rel_vid, byte_offset)`` with an end row, and ``csr_targets(rel_vid, pos, sink)``.

    Offsets are those of a file of longs: a header of 3, one offset for each vertex and one for the
    end, then all neighbours. ``pos`` counts from 0 inside a vertex.
    """
    scratch = scratch or Scratch.of(adj_rel.sparkSession)
    sums = scratch.save(
        prefix_sum(adjacency_degrees(adj_rel), [F.col("vid")], "degree", "before", scratch), "prefix"
    )
    vertices = sums.count()
    at = lambda n: (F.lit(3 + vertices + 1) + n) * 8
    end = sums.agg(
        F.lit(vertices + 1).cast("long").alias("rel_vid"), at(F.coalesce(F.sum("degree"), F.lit(0))).alias("byte_offset")
    )
    offsets = sums.select(F.col("vid").alias("rel_vid"), at(F.col("before")).alias("byte_offset")).unionByName(end)
    earlier = Window.partitionBy("vid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = adj_rel.select("vid", "chunk", F.size("nbrs").cast("long").alias("_n"))
    bases = sizes.select("vid", "chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    targets = (
        adj_rel.join(bases, ["vid", "chunk"])
        .select(F.col("vid").alias("rel_vid"), "_base", F.posexplode(F.array_sort("nbrs")).alias("_pos", "sink"))
        .select("rel_vid", (F.col("_base") + F.col("_pos")).alias("pos"), "sink")
    )
    return offsets, targets


def degree_histogram_lines(g: DataFrame) -> DataFrame:
    return degree_histogram(g).select("degree", F.concat_ws(",", "degree", "vertices").alias("line"))


def write_trails(steps: DataFrame, path: str, trail: str = "trail_id") -> None:
    """Steps as a table in ``(trail, seq)`` order, however long a trail is."""
    order = [trail, "seq"]
    steps.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def trail_lines(steps: DataFrame, trail: str = "trail_id", line_steps: int = 1_000_000) -> DataFrame:
    """``id,v0,v1,...`` for display; a longer trail goes over several lines ``piece`` by ``piece``.

    A piece ends with the vertex that the next one starts with.
    """
    piece = F.floor(F.col("seq") / line_steps).cast("long").alias("piece")
    rows = steps.groupBy(trail, piece).agg(
        F.array_sort(F.collect_list(F.struct("seq", "from_vid", "to_vid"))).alias("_s")
    )
    vertices = F.concat(F.transform("_s", lambda s: s["from_vid"]), F.array(F.element_at("_s", -1)["to_vid"]))
    return rows.select(trail, "piece", F.concat_ws(",", F.col(trail).cast("string"), join_longs(vertices)).alias("line"))


def write_trail_lines(steps: DataFrame, path: str, trail: str = "trail_id") -> None:
    """The lines of ``trail_lines``, in the order of trails and pieces."""
    write_lines(trail_lines(steps, trail), path, [trail, "piece"])


def trail_tuple_pieces(steps: DataFrame, trail: str = "trail_id", line_steps: int = 1_000_000) -> DataFrame:
    """``(part, trail, piece, text)``: lines ``(part,[v0, v1, ...])``, one for each trail, in pieces of ``line_steps`` steps."""
    piece = F.floor(F.col("seq") / line_steps).cast("long").alias("piece")
    rows = steps.groupBy("part", trail, piece).agg(F.array_sort(F.collect_list(F.struct("seq", "from_vid", "to_vid"))).alias("_s"))
    ends = steps.groupBy("part", trail).agg((F.max("seq") / line_steps).cast("long").alias("_last"))
    visits = join_longs(F.transform("_s", lambda s: s["from_vid"]), ", ")
    lead = F.when(F.col("piece") == 0, F.concat(F.lit("("), F.col("part").cast("string"), F.lit(",["))).otherwise(", ")
    end = F.concat(F.lit(", "), F.element_at("_s", -1)["to_vid"].cast("string"), F.lit("])\n"))
    return rows.join(ends, ["part", trail]).select(
        "part", trail, "piece", F.concat(lead, visits, F.when(F.col("piece") == F.col("_last"), end).otherwise("")).alias("text"))


def write_trail_text(steps: DataFrame, path: str, trail: str = "trail_id", line_steps: int = 1_000_000) -> None:
    """Lines ``(part,[v0, v1, ...])`` as ``read_trail_text`` takes them; no trail is gathered in one row."""
    write_pieces(trail_tuple_pieces(steps, trail, line_steps), path, ["part", trail, "piece"])


def read_trail_text(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """``(part, trail_id, seq, from_vid, to_vid)`` from lines ``(part,[v0, v1, ...])``; any other line is an error.

    A line may go on in the files after its own, in name order, as ``write_trail_text`` leaves it; such stretches are
    placed by what is before them, not gathered. Trails are numbered by their line, in a table that is written here.
    """
    scratch = scratch or Scratch.of(spark)
    part, body = (F.regexp_extract("value", _STRETCH, i) for i in (1, 2))
    wrong = F.raise_error(F.concat(F.lit("malformed trail: "), F.substring("value", 1, 1000))).cast("int")
    lines = spark.read.text(path).filter("trim(value) <> ''").select(
        F.when(part != "", part.cast("int")).when(F.regexp_extract("value", _STRETCH, 0) == "", wrong).alias("part"),
        F.monotonically_increasing_id().alias("trail_id"), _longs(body, ",").alias("_v"),
        F.when(part == "", body.rlike(r"^\s*,")).alias("_goes_on"), F.regexp_extract("value", _STRETCH, 3).alias("_close"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    lines = scratch.save(lines, "trail-lines")
    stretches = _placed_stretches(lines.filter("part IS NULL OR _close = ''"), lines, scratch)
    lines = lines.select("trail_id", "part", "_v").join(stretches, "trail_id", "left")
    from_before = F.when(F.col("_last").isNotNull(), F.concat(F.array("_last"), "_v")).otherwise(F.col("_v"))
    lines = lines.select(
        F.coalesce("_part", "part").alias("part"), F.coalesce("_trail", "trail_id").alias("trail_id"),
        F.coalesce(F.col("_base") - F.when(F.col("_last").isNotNull(), 1).otherwise(0), F.lit(0)).alias("_base"), from_before.alias("_v"))
    steps = F.arrays_zip(F.slice("_v", F.lit(1), F.greatest(F.size("_v") - 1, F.lit(0))).alias("a"), F.slice("_v", 2, F.size("_v")).alias("b"))
    return lines.select("part", "trail_id", "_base", F.posexplode(steps).alias("_i", "_s")).select(
        "part", "trail_id", (F.col("_base") + F.col("_i")).alias("seq"), F.col("_s.a").alias("from_vid"), F.col("_s.b").alias("to_vid"))


def _placed_stretches(cut: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``(trail_id, _trail, _part, _base, _last)`` of lines cut by the ends of files: their trail, and vertices and the last vertex before.

    There are at most two for each file; the windows hold no list. One that nothing goes on or that goes on nothing is an error.
    """
    place = F.struct("_at", "trail_id")
    edges = lines.groupBy("_file").agg(F.min(place).alias("_first"), F.max(place).alias("_final"))
    here = cut.select(
        "trail_id", "_file", "_at", "part", "_goes_on", (F.col("_close") == "").alias("_open"),
        F.size("_v").cast("long").alias("_n"), F.try_element_at("_v", F.lit(-1)).alias("_end")).join(edges, "_file")
    order = Window.orderBy("_file", "_at", "trail_id")
    files = lines.select("_file").distinct().select("_file", F.row_number().over(Window.orderBy("_file")).alias("_f"))
    here = scratch.save(here.join(files, "_file").withColumn("_head", F.count("part").over(order)), "trail-stretches")
    before = Window.partitionBy("_head").orderBy("_file", "_at", "trail_id").rowsBetween(Window.unboundedPreceding, -1)
    held = here.select(
        "*", F.lag("_open").over(order).alias("_open_before"), F.lag("_f").over(order).alias("_f_before"),
        F.lead("part").over(order).alias("_part_after"), F.lead("_f").over(order).alias("_f_after"))
    first, final = F.col("_first.trail_id") == F.col("trail_id"), F.col("_final.trail_id") == F.col("trail_id")
    continues = F.col("_goes_on") & first & F.coalesce(F.col("_open_before") & (F.col("_f_before") == F.col("_f") - 1), F.lit(False))
    continued = final & F.col("_part_after").isNull() & F.coalesce(F.col("_f_after") == F.col("_f") + 1, F.lit(False))
    wrong = held.filter((F.col("part").isNull() & ~continues) | (F.col("_open") & ~continued)).select("_file", "trail_id").limit(1).collect()
    if wrong:
        raise ValueError(f"malformed trail: a line without its other half in {wrong[0]['_file']}")
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return scratch.save(here.select(
        "trail_id", F.first("trail_id").over(whole).alias("_trail"), F.first("part").over(whole).alias("_part"),
        F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"), F.last("_end", ignorenulls=True).over(before).alias("_last")), "trail-places")
