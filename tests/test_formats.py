import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from graphtrails.operators import checks, tables
from graphtrails.plans import jobs
from graphtrails.sources import binary, text


def _write(path, data):
    path.mkdir()
    (path / "a.bin").write_bytes(data)
    return str(path)


def test_edge_list_and_bad_lines(spark, tmp_path):
    good, bad = tmp_path / "good.tsv", tmp_path / "bad.tsv"
    good.write_text("1\t2\n2\t2\n")
    assert sorted((r.u, r.v) for r in text.read_edge_list(spark, str(good)).collect()) == [(1, 2), (2, 2)]
    bad.write_text("1\t2\n2\t2\t3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        text.read_edge_list(spark, str(bad)).collect()


def test_adjacency_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1:2, 3\n2:1\n9:\n")
    rows = {r.vid: r.nbrs for r in text.read_adjacency_text(spark, str(tmp_path / "a.txt")).collect()}
    assert rows == {1: [2, 3], 2: [1], 9: []}


def test_partitioned_text_dialects(spark, tmp_path):
    (tmp_path / "p.txt").write_text("0@1&2,2#5:1,7:2,6:1\n0@2&1\n1@5&#1:0\n")
    rows = {r.vid: r for r in text.read_partitioned_text(spark, str(tmp_path / "p.txt")).collect()}
    assert rows[1].local == [2, 2] and rows[1].remote == {1: [5, 6], 2: [7]}
    assert rows[2].remote == {} and rows[5].local == [] and rows[5].part == 1
    (tmp_path / "q.txt").write_text("0@1&2,2#5,7,6\n1@5&#1\n2@7&#1\n1@6&#1\n0@2&1,1\n")
    plain = text.read_partitioned_text(spark, str(tmp_path / "q.txt"), "plain")
    vp = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (6, 1), (7, 2)], "vid long, part int")
    grouped = {r.vid: r for r in tables.group_remote_by_part(plain, vp).collect()}
    assert grouped[1].remote == {1: [5, 6], 2: [7]} and grouped[5].local == []


def test_adjacency_bytes(spark, tmp_path):
    data = struct.pack(">iqqq", 3, 7, 8, 9) + struct.pack(">iq", 1, 4)
    src = _write(tmp_path / "in", data)
    adj = binary.read_adjacency_binary(spark, src)
    assert {r.vid: r.nbrs for r in adj.collect()} == {7: [8, 9], 4: []}
    split = binary.read_adjacency_binary(spark, src, list_rows=1)
    assert sorted((r.vid, r.chunk, r.nbrs) for r in split.collect()) == [(4, 0, []), (7, 0, [8]), (7, 1, [9])]
    out = str(tmp_path / "out")
    manifest = binary.write_adjacency_binary(adj.coalesce(1), out).collect()
    assert [sum(c) for c in zip(*(tuple(r)[1:] for r in manifest))] == [2, 2, len(data)]
    assert sorted(tuple(r) for r in binary.read_adjacency_binary(spark, out).collect()) == sorted(tuple(r) for r in adj.collect())
    with pytest.raises(Exception, match="ends inside a record"):
        binary.read_adjacency_binary(spark, _write(tmp_path / "cut", data[:-3])).collect()


def test_partitioned_bytes(spark, tmp_path):
    packed = (5 << 56) | 12
    data = struct.pack(">bqiqqiq", 3, 7, 2, 8, 9, 1, packed) + struct.pack(">bqii", 0, 4, 0, 0)
    pa = binary.read_partitioned_binary(spark, _write(tmp_path / "in", data))
    rows = {r.vid: r for r in pa.collect()}
    assert rows[7].local == [8, 9] and rows[7].remote == {5: [12]} and rows[7].part == 3
    assert rows[4].local == [] and rows[4].remote == {}
    manifest = binary.write_partitioned_binary(pa, str(tmp_path / "out"), splits=2).collect()
    files = {r.file[:11]: (tmp_path / "out" / r.file).read_bytes() for r in manifest}
    assert files == {"split-00000": data[-17:], "split-00001": data[:-17]}
    many = binary.write_partitioned_binary(pa.union(pa), str(tmp_path / "many"), splits=1, file_bytes=1).collect()
    assert sum(r.vertices for r in many) == 4


def test_long_lists_go_over_rows(graph):
    g = graph([(0, i) for i in range(1, 30)] + [(0, 0)])
    adj = tables.adjacency(g, list_rows=5)
    rows = [r for r in adj.collect() if r.vid == 0]
    whole = [0, 0, *range(1, 30)]
    assert {r.chunk: r.nbrs for r in rows} == {c: whole[5 * c:5 * c + 5] for c in range(7)}
    row = checks.adjacency_integrity(adj, tables.adjacency(g)).first()
    assert row.common == 60 and row.left_only == row.right_only == 0
    offsets, targets = text.csr_tables(tables.remap_adjacency(adj, tables.renumber_vertices(adj), list_rows=5))
    assert sorted(r.pos for r in targets.filter("rel_vid = 1").collect()) == list(range(31))
    with pytest.raises(Exception, match="too long for one row"):
        text.metis_lines(adj).collect()


def _joined(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("*.bin"))).decode()


def test_lines_of_several_pieces(spark, graph, tmp_path):
    g = graph([(1, i) for i in range(2, 31)] + [(1, 1), (5, 6)])
    adj = tables.adjacency(g, list_rows=5).union(spark.createDataFrame([(99, 0, [])], tables.ADJACENCY))
    text.write_adjacency_csv(adj, str(tmp_path / "csv"), ":", " ")
    lines = _joined(tmp_path / "csv").split("\n")
    assert lines[0] == "1:" + " ".join(map(str, [1, 1, *range(2, 31)])) and lines[-3:] == ["30:1", "99", ""]
    text.write_adjacency_blogel(adj, str(tmp_path / "blogel"))
    lines = _joined(tmp_path / "blogel").split("\n")
    assert lines[0] == "1\t31 " + " ".join(map(str, [1, 1, *range(2, 31)])) and lines[-2] == "99\t0"
    text.write_metis_text(tables.remap_adjacency(adj, tables.renumber_vertices(adj), list_rows=4), str(tmp_path / "metis"))
    lines = _joined(tmp_path / "metis").split("\n")
    assert lines[:2] == ["31 31", " ".join(map(str, [1, 1, *range(2, 31)]))] and lines[-2:] == ["", ""] and len(lines) == 33
    steps = spark.createDataFrame([(2, 7, i, 10 + i, 11 + i) for i in range(20)] + [(0, 3, 0, 5, 5)], "part int, trail_id long, seq long, from_vid long, to_vid long")
    text.write_trail_text(steps, str(tmp_path / "trails"), line_steps=3)
    assert _joined(tmp_path / "trails") == "(0,[5, 5])\n(2,[" + ", ".join(map(str, range(10, 31))) + "])\n"


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_malformed_lines_are_errors(spark, tmp_path, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        readers = {
            text.read_adjacency_text: ["1:2, x", "1", "a:1"], text.read_partition_map_pairs: ["1 x", "1", "x 2"],
            text.read_partitioned_text: ["0@1&2#x:1", "0@1&2#3", "0@1", "0:1&2", "0@1&a", "x@1&2"], text.read_partition_map_lines: ["x"],
        }
        for reader, wrong in readers.items():
            for i, line in enumerate(wrong):
                path = tmp_path / f"{reader.__name__}-{i}"
                path.write_text(line + "\n")
                with pytest.raises(Exception, match="malformed"):
                    reader(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)



def test_binary_names_and_targets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "graph.dat").write_bytes(struct.pack(">iqq", 2, 7, 8))
    for path in (tmp_path / "in", tmp_path / "in" / "graph.dat"):
        assert [r.vid for r in binary.read_adjacency_binary(spark, str(path)).collect()] == [7]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no files to read"):
        binary.read_adjacency_binary(spark, str(tmp_path / "none"))
    adj = binary.read_adjacency_binary(spark, str(tmp_path / "in"))
    with pytest.raises(Exception, match="is not empty"):
        binary.write_adjacency_binary(adj, str(tmp_path / "in"))


def test_chunks_survive_files(spark, graph, tmp_path):
    g = graph([(0, i) for i in range(1, 30)] + [(0, 0), (3, 4)])
    adj, whole = tables.adjacency(g, list_rows=5), tables.adjacency(g)
    binary.write_adjacency_binary(adj, str(tmp_path / "adj"))
    back = binary.read_adjacency_binary(spark, str(tmp_path / "adj"))
    assert back.count() == adj.count() == back.select("vid", "chunk").distinct().count()
    offsets, targets = text.csr_tables(tables.remap_adjacency(back, tables.renumber_vertices(back), list_rows=5))
    assert sorted(r.pos for r in targets.filter("rel_vid = 1").collect()) == list(range(31))
    assert checks.adjacency_integrity(back, whole).first().left_only == 0
    degrees = {r.line.split("\t")[1].split(" ")[0] for r in text.adjacency_blogel_lines(back).filter("vid = 0").collect()}
    assert degrees == {"31"}
    vp = g.selectExpr("inline(array(struct(u AS vid), struct(v AS vid)))").distinct().selectExpr("vid", "cast(vid % 3 AS int) AS part")
    pa = tables.split_local_remote(g, vp, list_rows=5)
    binary.write_partitioned_binary(pa, str(tmp_path / "pa"), splits=2)
    again = binary.read_partitioned_binary(spark, str(tmp_path / "pa"))
    assert again.count() == pa.count() == again.select("vid", "chunk").distinct().count()
    rows = lambda t: sorted(map(tuple, tables.partitioned_darts(t).collect()))
    assert rows(again) == rows(pa)


def test_faulty_adjacency(spark):
    adj = lambda rows: spark.createDataFrame([(v, 0, n) for v, n in rows], tables.ADJACENCY)
    edges = lambda rows: sorted((r.u, r.v) for r in jobs.edges_of_adjacency(adj(rows)).collect())
    assert edges([(1, [2, 2, 1, 1]), (2, [1, 1])]) == [(1, 1), (1, 2), (1, 2)]
    with pytest.raises(Exception, match="both ends alike: 3 - 5"):
        edges([(5, [3]), (3, [])])
    with pytest.raises(Exception, match="odd number of times: 4 - 4"):
        edges([(4, [4])])


def test_repeated_map_keys(spark, graph):
    g = graph([(0, 1)])
    vp = lambda rows: spark.createDataFrame(rows, "vid long, part int")
    assert tables.attach_partition(g, vp([(0, 0), (1, 2), (1, 2)])).count() == 1
    with pytest.raises(Exception, match="several parts for vertex 1"):
        tables.attach_partition(g, vp([(0, 0), (1, 2), (1, 3)])).collect()


def test_edge_without_a_vertex(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("1\t2\n3\t\n")
    with pytest.raises(Exception, match="edge without a vertex"):
        text.read_edge_list(spark, str(tmp_path / "e.tsv"))


def test_graph_of_partitioned(spark, graph):
    g = graph([(0, 1), (1, 2), (2, 0), (2, 2), (0, 1)])
    vp = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "vid long, part int")
    edges, parts = jobs.graph_of_partitioned(tables.split_local_remote(g, vp))
    pairs = lambda t: sorted((min(r.u, r.v), max(r.u, r.v)) for r in t.collect())
    assert pairs(edges) == pairs(g) and sorted(map(tuple, parts.collect())) == [(0, 0), (1, 0), (2, 1)]


def test_trail_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("(3,[5, 6, 5])\n (4, [7,8]) \n")
    rows = sorted((r.part, r.seq, r.from_vid, r.to_vid) for r in text.read_trail_text(spark, str(tmp_path / "t.txt")).collect())
    assert rows == [(3, 0, 5, 6), (3, 1, 6, 5), (4, 0, 7, 8)]
    (tmp_path / "u.txt").write_text("3: 5 6\n")
    with pytest.raises(Exception, match="malformed trail"):
        text.read_trail_text(spark, str(tmp_path / "u.txt"))


def test_missing_part_is_an_error(spark, graph):
    g = graph([(0, 1)])
    vp = spark.createDataFrame([(0, 0)], "vid long, part int")
    assert [r.vid for r in tables.missing_parts(g, vp).collect()] == [1]
    with pytest.raises(Exception, match="vertex without part: 1"):
        tables.attach_partition(g, vp).collect()


def test_checks_find_faults(spark):
    pa = spark.createDataFrame(
        [(0, 1, 0, [2], {1: [5], 0: [2]}), (0, 2, 0, [], {}), (1, 5, 0, [], {})], tables.PART_ADJACENCY
    )
    assert checks.remote_edges_symmetric(pa).count() == 1
    assert checks.local_edges_symmetric(pa).count() >= 1
    assert [r.vid for r in checks.self_part_not_remote(pa).collect()] == [1]


def test_walk_breaks_finds_jumps_and_gaps(spark):
    schema = "w long, seq long, from_vid long, to_vid long"
    good = [(1, 0, 5, 6), (1, 1, 6, 5)]
    assert checks.walk_breaks(spark.createDataFrame(good, schema), "w").count() == 0
    jump = [(1, 0, 5, 6), (1, 1, 7, 5)]
    assert checks.walk_breaks(spark.createDataFrame(jump, schema), "w").count() == 1
    gap = [(1, 0, 5, 6), (1, 2, 6, 5)]
    assert checks.walk_breaks(spark.createDataFrame(gap, schema), "w").count() == 1
    unclosed = [(1, 0, 5, 6), (1, 1, 6, 7)]
    rows = spark.createDataFrame(unclosed, schema)
    assert checks.walk_breaks(rows, "w").count() == 1 and checks.walk_breaks(rows, "w", closed=False).count() == 0


def test_trail_lines_over_pieces(spark):
    steps = spark.createDataFrame([(9, i, i, i + 1) for i in range(5)], "trail_id long, seq long, from_vid long, to_vid long")
    lines = {r.piece: r.line for r in text.trail_lines(steps, line_steps=3).collect()}
    assert lines == {0: "9,0,1,2,3", 1: "9,3,4,5"}


@pytest.mark.parametrize("range_bytes, list_rows", [(64, 3), (200, 2), (16, 1), (1 << 20, 5)])
def test_binary_by_range_equals_the_stream(spark, tmp_path, range_bytes, list_rows):
    """A plain decoder over bytes gives the lists; ranges of any size give the same, under numbers that don't repeat."""
    rng = random.Random(range_bytes)
    lists = [(v, [rng.randrange(1 << 40) for _ in range(n)]) for v, n in enumerate([0, 1, 3, 0, 40, 2, 7, 1, 90, 0, 5])]
    data = b"".join(struct.pack(f">iq{len(n)}q", len(n) + 1, v, *n) for v, n in lists)
    path = _write(tmp_path / "adj", data)
    rows = binary.read_adjacency_binary(spark, path, list_rows, range_bytes).collect()
    assert max(len(r.nbrs) for r in rows) <= list_rows
    assert len({(r.vid, r.chunk) for r in rows}) == len(rows)
    for v, n in lists:
        own = sorted((r for r in rows if r.vid == v), key=lambda r: r.chunk)
        assert [r.chunk for r in own] == list(range(len(own))) and sum((r.nbrs for r in own), []) == n
    both = [(v % 3, v, n, [(5 << 56) | x for x in n[::2]]) for v, n in lists]
    data = b"".join(struct.pack(f">bqi{len(a)}qi{len(b)}q", p, v, len(a), *a, len(b), *b) for p, v, a, b in both)
    rows = binary.read_partitioned_binary(spark, _write(tmp_path / "part", data), False, list_rows, range_bytes).collect()
    for p, v, a, b in both:
        own = sorted((r for r in rows if r.vid == v), key=lambda r: r.chunk)
        assert {r.part for r in own} == {p} and [r.chunk for r in own] == list(range(len(own)))
        assert sum((r.local for r in own), []) == a and [x.vid for r in own for x in r.remote_ids] == [x & ((1 << 56) - 1) for x in b]
    if range_bytes < 1000:
        with pytest.raises(Exception, match="inside a record"):
            binary.read_adjacency_binary(spark, _write(tmp_path / "cut", data[:-3]), list_rows, range_bytes).collect()


def test_one_vertex_fills_several_files(spark, tmp_path):
    rows = [(1, 0, [5]), *[(2, c, [10 * c, 10 * c + 1, 10 * c + 2]) for c in range(9)], (3, 0, []), (4, 0, [7, 8])]
    adj = spark.createDataFrame(rows, "vid long, chunk int, nbrs array<long>").repartition(3)
    manifest = binary.write_adjacency_binary(adj, str(tmp_path / "adj"), file_bytes=100).collect()
    assert len(manifest) >= 3 and sum(m.vertices for m in manifest) == len(rows) and sum(m.edges for m in manifest) == 30
    assert max(m.bytes for m in manifest) <= 100 + 36
    for list_rows in (3, 2):
        back = binary.read_adjacency_binary(spark, str(tmp_path / "adj"), list_rows).collect()
        assert len({(r.vid, r.chunk) for r in back}) == len(back)
        own = sorted((r for r in back if r.vid == 2), key=lambda r: r.chunk)
        assert sum((r.nbrs for r in own), []) == [10 * c + i for c in range(9) for i in range(3)]
    (tmp_path / "adj" / "part-left-over.bin").write_bytes(b"not in the manifest")
    assert binary.read_adjacency_binary(spark, str(tmp_path / "adj")).count() == len(rows)


def test_long_remote_list_is_sorted_once(spark):
    size = 4000
    remotes = F.expr(f"transform(sequence(1L, {size}L), x -> named_struct('vid', x * 7919L % {size}L, 'part', cast(x % 5 AS int)))")
    begun = time.monotonic()
    row = spark.range(1).select(text.remote_map(remotes).alias("m")).first()
    assert time.monotonic() - begun < 60  # sorted anew for every entry it took minutes
    assert row.m == {p: sorted(x * 7919 % size for x in range(1, size + 1) if x % 5 == p) for p in range(5)}


def test_trails_cut_by_the_ends_of_files(spark, tmp_path):
    rows = [(p, t, i, 100 * t + i, 100 * t + i + 1) for p, t, n in ((0, 1, 40), (0, 2, 1), (1, 3, 7), (2, 4, 90)) for i in range(n)]
    steps = spark.createDataFrame(rows, "part int, trail_id long, seq long, from_vid long, to_vid long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text.write_trail_text(steps, str(tmp_path / "trails"), line_steps=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "trails").glob("*.bin"))
    assert not all(f.read_bytes().endswith(b"])\n") for f in files)
    back = text.read_trail_text(spark, str(tmp_path / "trails"))
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in back.collect()) == sorted(r[:1] + r[2:] for r in rows)
    assert back.select("part", "trail_id").distinct().count() == 4


@pytest.mark.parametrize("files", [["(0,[1, 2", "(1,[3, 4])\n"], ["(0,[1, 2])\n", ", 3])\n"], ["(0,[1, 2", " 3])\n"], ["(0,[1, 2\n, 3])\n"], ["(0,[1, 2"]])
def test_trails_without_their_other_half(spark, tmp_path, files):
    for i, content in enumerate(files):
        (tmp_path / f"{i}.txt").write_text(content)
    with pytest.raises(Exception, match="malformed trail"):
        text.read_trail_text(spark, str(tmp_path))
