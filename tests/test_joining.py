import glob
import random

import pytest
from pyspark.sql import functions as F

from graphtrails.operators import chains, checks, partition as part
from graphtrails.operators.eulerize import eulerize


@pytest.mark.parametrize("group_rows", [1_000_000, 30])
def test_rounds_of_many_tasks_hand_on_few_rows(spark, graph, monkeypatch, group_rows):
    """Whatever the number of tasks, what all rounds together hand on is about as much as the elements."""
    monkeypatch.setattr(chains, "TASK_ROWS", 40)
    monkeypatch.setattr(chains, "GROUP_ROWS", 30)
    handed, real = [], part.Scratch.save

    def save(self, df, name, *args, **options):
        out = real(self, df, name, *args, **options)
        if name == "contract":
            table = out[0] if isinstance(out, tuple) else out
            handed.append(table.filter(F.col("kind").isin(chains.STAYS, chains.WORD)).count())
        return out

    monkeypatch.setattr(part.Scratch, "save", save)
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60) if rng.random() < 0.8 else 1) for _ in range(500)]
    g = eulerize(graph(pairs + [(v, v + 1) for v in range(59)]))
    vp = spark.createDataFrame([(v, v % 4) for v in range(60)], "vid long, part int")
    tour = part.partition_tour(g, vp, group_rows=group_rows)
    trails = tour.scratch.save(part.trail_table(tour), "trails")
    elements = tour.steps.count()
    assert len(handed) > 2 * (tour.height + 1)
    assert sum(handed) <= 1.5 * elements
    assert {r.verdict for r in checks.trails_valid(tour).collect()} == {"valid"}
    assert all(r.violations == 0 for r in checks.trail_invariants(tour, trails).collect())
    assert all(r.edges == r.walked for r in checks.local_coverage(tour).collect())
    assert all(2 * r.open_trails == r.odd_boundary for r in part.level_report(tour).collect())
    size = tour.edges.count()
    row = checks.circuit_summary(part.tour_circuit(tour), tour.edges).first()
    assert row.asDict() == dict(steps=size, edges=size, circuits=1, breaks=0, wrong_edges=0)


@pytest.mark.parametrize("form", ["links", "ends"])
def test_a_task_holds_its_rows_at_any_number_of_shuffle_partitions(spark, monkeypatch, form):
    """The session has 4 shuffle partitions; a first round over 400 elements still has tasks of about 10 rows each."""
    monkeypatch.setattr(chains, "TASK_ROWS", 10)
    files, real = [], part.Scratch.save

    def save(self, df, name, *args, **options):
        out = real(self, df, name, *args, **options)
        if name == "contract":
            table = out[0] if isinstance(out, tuple) else out
            files.append(len(glob.glob(f"{table._scratch_path}/part-*")))
            raise StopIteration  # the first round is enough
        return out

    monkeypatch.setattr(part.Scratch, "save", save)
    if form == "links":
        rows = [(k, 2 * k - 1 if k else -1, 2, 2 * k + 2 if k < 399 else -1, 2, 1) for k in range(400)]
        elements = spark.createDataFrame(rows, "k long, pa long, ga long, pb long, gb long, own long")
    else:
        rows = [(k, 1, k, 1, -1, 0, k + 1, 1, -1, 0, 0) for k in range(400)]
        elements = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c[0] == 'q' else 'long'}" for c in chains.ENDS))
    with pytest.raises(StopIteration):
        chains.rank_chains(elements, part.Scratch.of(spark))
    assert files[0] >= 30


def test_each_vertex_keeps_one_open_end_at_most(spark, monkeypatch):
    """Places and ends of trails that many small tasks link: a star of paths, of any length and direction."""
    monkeypatch.setattr(chains, "TASK_ROWS", 5)
    rng = random.Random(2)
    rows = [(k, length, rng.randrange(25), length, -1, 0, rng.randrange(25), length, -1, 0, 7 * k)
            for k, length in enumerate(rng.randrange(1, 6) for _ in range(151))]
    schema = ", ".join(f"{c} {'int' if c[0] == 'q' else 'long'}" for c in chains.ENDS)
    places, ends, links = chains.rank_chains(spark.createDataFrame(rows, schema), part.Scratch.of(spark))
    places = places.withColumn("seq", chains.start_of("len")).withColumn("total", chains.chain_length()).collect()
    assert sorted(p.k for p in places) == list(range(151)) and all(p.tag == 7 * p.k for p in places)
    degree = [0] * 25
    for r in rows:
        degree[r[2]] += 1
        degree[r[6]] += 1
    tips = [v for e in ends.collect() if not e.closed for v in (e.a, e.b)]
    assert sorted(tips) == [v for v in range(25) if degree[v] % 2]
    assert links.count() == sum(d // 2 for d in degree)
    ends = {e.chain: e for e in ends.collect()}
    for chain, end in ends.items():
        walk = sorted((p for p in places if p.chain == chain), key=lambda p: p.seq)
        turned = [(p.b, p.a) if p.r else (p.a, p.b) for p in walk]
        assert [p.seq for p in walk] == [sum(q.len for q in walk[:i]) for i in range(len(walk))]
        assert {p.total for p in walk} == {sum(p.len for p in walk)}
        assert all(one[1] == two[0] for one, two in zip(turned, turned[1:]))
        assert turned[-1][1] == turned[0][0] if end.closed else (turned[0][0], turned[-1][1]) == (end.a, end.b)
