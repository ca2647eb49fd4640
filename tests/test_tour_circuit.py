import random

import pytest

from graphtrails.operators import chains, circuit, partition as part
from graphtrails.operators.checks import circuit_summary
from graphtrails.operators.eulerize import eulerize
from graphtrails.operators.meta import given_merge_tree


def _even(graph, seed=5):
    rng = random.Random(seed)
    pairs = [(rng.randrange(30), rng.randrange(30) if rng.random() < 0.7 else 1) for _ in range(120)]
    return eulerize(graph(pairs + [(v, v + 1) for v in range(29)] + [(50, 51), (51, 50), (60, 60)]))


def _ranked_tables(monkeypatch):
    seen, real = [], chains.rank_chains

    def rank(elements, scratch, rows=None):
        seen.append((elements.count(), "qa" in elements.columns))
        return real(elements, scratch, rows)

    for module in (part, circuit):
        monkeypatch.setattr(module, "rank_chains", rank)
    return seen


def test_a_tour_is_not_ranked_again_for_its_circuit(spark, graph, monkeypatch):
    g = spark.createDataFrame(_even(graph).collect(), "eid long, u long, v long")
    vp = spark.createDataFrame([(v, v % 4) for v in [*range(30), 50, 51, 60]], "vid long, part int")
    tour = part.partition_tour(g, vp, group_rows=10)
    seen = _ranked_tables(monkeypatch)
    steps = tour.scratch.save(part.tour_circuit(tour, group_rows=4), "circuit")
    size = g.count()
    assert sum(n for n, _ in seen) < size  # segments only
    row = circuit_summary(steps, g).first().asDict()
    assert row == dict(steps=size, edges=size, circuits=3, breaks=0, wrong_edges=0)


def test_edges_of_a_circuit_are_linked_as_they_are_ranked(graph, monkeypatch):
    g = _even(graph, 6)
    seen = _ranked_tables(monkeypatch)
    steps = circuit.euler_circuit(g, group_rows=7)
    size = g.count()
    assert seen[0] == (size, True) and all(n < size for n, _ in seen[1:])
    row = circuit_summary(steps, g).first().asDict()
    assert row == dict(steps=size, edges=size, circuits=3, breaks=0, wrong_edges=0)


def test_a_tour_with_open_ends_has_no_circuit(spark, graph):
    g = graph([(1, 2), (2, 3), (3, 4), (4, 1)])
    vp = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3)], "vid long, part int")
    tour = part.partition_tour(g, vp, given_merge_tree(spark, [[(0, 1), (2, 3)]]))
    with pytest.raises(ValueError, match="leaves trails open"):
        part.tour_circuit(tour)


def test_summary_finds_faults(spark, graph):
    steps = spark.createDataFrame(
        [(1, 0, 0, 1, 2), (1, 1, 1, 2, 3), (1, 2, 9, 3, 4), (1, 4, 1, 2, 1)], "component long, seq long, eid long, from_vid long, to_vid long")
    row = circuit_summary(steps, graph([(1, 2), (2, 3), (3, 1)])).first().asDict()
    assert row == dict(steps=4, edges=3, circuits=1, breaks=1, wrong_edges=2)
