import random

import pytest
from pyspark.sql import functions as F

from graphtrails.operators import partition as part
from graphtrails.operators.eulerize import eulerize
from graphtrails.sources import text


def _tour(spark, graph, parts=5):
    rng = random.Random(11)
    pairs = [(rng.randrange(40), rng.randrange(40) if rng.random() < 0.7 else 1) for _ in range(160)]
    g = eulerize(graph(pairs + [(v, v + 1) for v in range(39)]))
    tour = part.partition_tour(g, spark.createDataFrame([(v, v * v % parts) for v in range(40)], "vid long, part int"))
    return tour, tour.scratch.save(part.trail_table(tour), "trails")


@pytest.mark.parametrize("list_rows, task_rows", [(1_000_000, 500_000), (1_000_000, 20), (6, 20), (1, 1_000)])
def test_lists_at_ends_are_the_remotes_in_order(spark, graph, monkeypatch, list_rows, task_rows):
    monkeypatch.setattr(part, "LIST_TASK_ROWS", task_rows)
    tour, trails = _tour(spark, graph)
    keys = ["level", "part", "trail_id", "end", "vid", "other"]
    rows, want = part.end_remotes(tour, trails).collect(), {}
    for r in sorted(rows, key=lambda r: (r.rpart, r.nbr, r.dart)):
        want.setdefault(tuple(r[k] for k in keys), []).append((r.rpart, r.nbr))
    got = {}
    lists = part.part_lists(tour, trails, list_rows).collect()
    for r in sorted(lists, key=lambda r: r.chunk):
        flat = [(p, n) for p in sorted(r.remote) for n in r.remote[p]]
        got.setdefault(tuple(r[k] for k in keys), []).append(flat)
    assert {k: sum(v, []) for k, v in got.items()} == want and len({k[0] for k in want}) > 1
    if list_rows == 1_000_000:
        assert all(len(v) == 1 for v in got.values())
    else:
        assert all(len(chunk) == list_rows for v in got.values() for chunk in v[:-1]) and max(map(len, got.values())) > 1


def test_darts_are_not_shuffled_once_for_every_level(spark, graph):
    tour, trails = _tour(spark, graph)
    plan = text.boundary_lines(tour, trails)._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence" not in plan and "collect_list" not in plan
    assert part.part_lists(tour, trails).agg(F.count_distinct("level")).first()[0] == tour.height


def test_no_remotes_no_lists(spark, graph):
    tour = part.partition_tour(graph([(0, 1), (1, 2), (2, 0)]), spark.createDataFrame([(v, 0) for v in range(3)], "vid long, part int"))
    assert part.part_lists(tour).count() == 0


def test_a_long_line_is_not_cut_again_for_each_neighbour(spark, tmp_path):
    line = "0:1 9 " + "".join(f"{p}:" + ",".join(map(str, range(p, 3000 + p))) + " " for p in (2, 3))
    spark.createDataFrame([(line, 0)], "line string, level int").write.partitionBy("level").text(f"{tmp_path}/state")
    rows = text.read_boundary_state(spark, f"{tmp_path}/state")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # neither a list nor the words of a line go on with what is exploded from them
    kept = [g.split("), [")[1].split("]")[0] for g in plan.splitlines() if "Generate explode" in g]
    assert len(kept) == 2 and not any(c in k for c in ("_e#", "_w#", "_l#") for k in kept)
    assert "split(_e" not in plan[:plan.index("Generate explode")]
    got = {(r.level, r.part, r.vid, r.other, r.rpart): (r.n, r.s) for r in rows.groupBy("level", "part", "vid", "other", "rpart").agg(
        F.count("nbr").alias("n"), F.sum("nbr").alias("s")).collect()}
    assert got == {(0, 0, 1, 9, p): (3000, sum(range(p, 3000 + p))) for p in (2, 3)}
