import random

import pytest
from pyspark.sql import functions as F

from graphtrails.operators import checks, partition as part
from graphtrails.operators.eulerize import eulerize
from graphtrails.operators.meta import given_merge_tree
from graphtrails.sources import text


def _run(spark, g, parts, **options):
    vp = spark.createDataFrame(sorted(parts.items()), "vid long, part int")
    tour = part.partition_tour(g, vp, **options)
    trails = tour.scratch.save(part.trail_table(tour), "trails")
    assert {r.verdict for r in checks.trails_valid(tour).collect()} <= {"valid", "no trails"}
    assert all(r.violations == 0 for r in checks.trail_invariants(tour, trails).collect())
    assert all(r.edges == r.walked for r in checks.local_coverage(tour).collect())
    assert checks.boundary_contained(tour).count() == 0
    return tour, trails


def _circuit_ok(tour, circuits):
    row = checks.circuit_summary(part.tour_circuit(tour), tour.edges).first()
    size = tour.edges.count()
    assert row.asDict() == dict(steps=size, edges=size, circuits=circuits, breaks=0, wrong_edges=0)


def test_cycle_in_two_parts_with_odd_boundary(spark, graph):
    g = graph([(1, 2), (2, 3), (3, 4), (4, 1)])
    tour, trails = _run(spark, g, {1: 0, 2: 0, 3: 1, 4: 1})
    kinds = sorted((r.level, r.part, r.kind, r.n_edges) for r in trails.collect())
    assert kinds == [(0, 0, "OB", 1), (0, 1, "OB", 1), (1, 1, "IN", 4)]
    _circuit_ok(tour, 1)


def test_cycle_in_two_parts_with_even_boundary(spark, graph):
    g = graph([(1, 2), (2, 3), (3, 4), (4, 1)])
    tour, trails = _run(spark, g, {1: 0, 2: 1, 3: 0, 4: 1})
    lone = [(r.source, r.n_edges, r.loop) for r in trails.filter("level = 0").collect()]
    assert sorted(lone) == [(v, 0, None) for v in (1, 2, 3, 4)]
    counts = {(r.level, r.part): r.path_ends for r in part.boundary_count(trails).collect()}
    assert counts == {(0, 0): 2, (0, 1): 2}


def test_boundary_state_comes_back(spark, graph, tmp_path):
    """Ends of every level through files: an open trail has its other end, a closed one none."""
    g = graph([(1, 2), (2, 3), (3, 4), (4, 1), (1, 5), (5, 6), (6, 1), (5, 7), (7, 8), (8, 5)])
    parts = {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3, 8: 3}
    tour, trails = _run(spark, g, parts)
    text.write_boundary_state(tour, f"{tmp_path}/state", trails)
    got = sorted(map(tuple, text.read_boundary_state(spark, f"{tmp_path}/state").collect()), key=str)
    rows = part.end_remotes(tour, trails).select("level", "part", "vid", "other", "rpart", "nbr").collect()
    assert got == sorted(map(tuple, rows), key=str) and {r[0] for r in got} == set(range(tour.height))
    assert {r[3] is None for r in got} == {True, False}


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("line", ["0:1 2:x ", "0:1", "0 2:3 ", "0:1 5 6 2:3 "])
def test_malformed_boundary_lines_raise(spark, tmp_path, ansi, line):
    spark.createDataFrame([(line, 0)], "line string, level int").write.partitionBy("level").text(f"{tmp_path}/state")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="not a line of a trail end"):
            text.read_boundary_state(spark, f"{tmp_path}/state").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_an_end_off_the_vertex_table_is_a_violation(spark, graph):
    tour, trails = _run(spark, graph([(1, 2), (2, 3), (3, 4), (4, 1)]), {1: 0, 2: 0, 3: 1, 4: 1})
    moved = trails.withColumn("source", F.expr("IF(kind = 'OB' AND part = 0, 99L, source)"))
    found = {r.rule: r.violations for r in checks.trail_invariants(tour, moved).collect()}
    assert found.pop("odd boundary vertex not at exactly one end") == 2 and not any(found.values())


def test_rings_of_one_owner_are_one_walk(spark, graph):
    # two triangles of part 0 meet at 1, which has two edges to part 1
    g = graph([(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 1), (1, 9), (9, 1)])
    tour, trails = _run(spark, g, {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 9: 1})
    steps = part.spliced_steps(tour, trails).filter("level = 0").orderBy("seq").collect()
    assert [r.seq for r in steps] == list(range(6)) and {r.total for r in steps} == {6}
    assert steps[0].from_vid == 1 == steps[-1].to_vid and len({r.trail_id for r in steps}) == 1
    assert all(a.to_vid == b.from_vid for a, b in zip(steps, steps[1:]))


def test_closed_trail_of_odd_boundary_vertices_is_kept(spark, graph):
    # a-b, a-c twice, c-d locally, one cut edge each; and a self-loop at such a vertex, b
    g = graph([(1, 2), (1, 3), (1, 3), (3, 4), (2, 2), (1, 11), (2, 11), (3, 12), (4, 12), (11, 11)])
    tour, trails = _run(spark, g, {1: 0, 2: 0, 3: 0, 4: 0, 11: 1, 12: 1})
    local = trails.filter("level = 0 AND part = 0").collect()
    assert sum(r.n_edges for r in local) == 5
    hosts = part.attach_internal_cycles(tour, trails).filter("level = 0").collect()
    assert all(r.host is not None for r in hosts)
    _circuit_ok(tour, 1)


def test_disconnected_graph_keeps_several_roots(spark, graph):
    g = graph([(1, 2), (2, 3), (3, 1), (5, 6), (6, 7), (7, 5)])
    tour, _ = _run(spark, g, {1: 0, 2: 0, 3: 1, 5: 2, 6: 3, 7: 3})
    top = tour.roots.filter(tour.roots.level == tour.height)
    assert {r.root for r in top.collect()} == {1, 3}
    _circuit_ok(tour, 2)


@pytest.mark.parametrize("parts, group_rows", [(7, 1_000_000), (4, 4)])
def test_random_graph(spark, graph, parts, group_rows):
    rng = random.Random(parts)
    pairs = [(rng.randrange(35), rng.randrange(35) if rng.random() < 0.7 else 1) for _ in range(150)]
    pairs += [(v, v + 1) for v in range(34)]
    g = eulerize(graph(pairs))
    tour, trails = _run(spark, g, {v: v % parts for v in range(35)}, group_rows=group_rows)
    report = part.level_report(tour).collect()
    assert all(2 * r.open_trails == r.odd_boundary for r in report)
    if parts == 7:
        assert part.pass_through(tour.tree).count() >= 1
    assert all((r.n_new + r.n_trail_ends + r.n_remote) % 2 == 0 for r in part.merged_vertices(tour).collect())
    _circuit_ok(tour, 1)


def test_given_tree_that_stops_early(spark, graph):
    g = graph([(1, 2), (2, 3), (3, 4), (4, 1)])
    tree = given_merge_tree(spark, [[(0, 1), (2, 3)]])
    tour, trails = _run(spark, g, {1: 0, 2: 1, 3: 2, 4: 3}, mt=tree)
    assert trails.filter("level = 1 AND kind = 'OB'").count() == 2


def test_boundary_line_with_a_long_list(spark, tmp_path):
    line = "0:1 9 " + "2:" + ",".join(map(str, range(50_000))) + " " + "".join(f"{p}:7 " for p in range(3, 5000))
    spark.createDataFrame([(line, 0)], "line string, level int").write.partitionBy("level").text(f"{tmp_path}/state")
    assert text.read_boundary_state(spark, f"{tmp_path}/state").count() == 54_997


def test_elements_of_a_level_are_counted_as_they_are_written(spark, graph, monkeypatch):
    seen, real = [], part.rank_chains

    def rank(elements, scratch, rows=None):
        seen.append((rows, elements.count()))
        return real(elements, scratch, rows)

    monkeypatch.setattr(part, "rank_chains", rank)
    tour, _ = _run(spark, graph([(1, 2), (2, 3), (3, 4), (4, 1), (1, 1)]), {1: 0, 2: 0, 3: 1, 4: 1})
    assert len(seen) == tour.height + 1 and all(rows == n for rows, n in seen)
    assert max(r.level for r in tour.loops.collect()) == tour.height


def test_no_table_of_a_tour_has_a_row_for_each_dart(spark, graph, monkeypatch):
    rng, rows, real = random.Random(3), {}, part.Scratch.save

    def save(self, df, name, *args, **options):
        out = real(self, df, name, *args, **options)
        rows.setdefault(name, []).append((out[0] if isinstance(out, tuple) else out).count())
        return out

    monkeypatch.setattr(part.Scratch, "save", save)
    g = eulerize(graph([(rng.randrange(9), rng.randrange(9)) for _ in range(90)] + [(v, v + 1) for v in range(8)]))
    tour = part.partition_tour(g, spark.createDataFrame([(v, v % 3) for v in range(9)], "vid long, part int"))
    size = tour.edges.count()
    assert max(n for name in rows for n in rows[name] if not name.startswith("contract")) <= size
    assert sum(rows["trail-bodies"]) <= 9 * tour.height  # only open trails are written again
    assert tour.darts.count() == 2 * size and tour.darts.select("dart").distinct().count() == 2 * size
