import itertools
import random

import pytest

from graphtrails.operators.eulerize import eulerize, match_odd_vertices, match_report, unmatched
from graphtrails.operators.tables import degrees


def _sinks(g, **options):
    return {r.vid: r.sink for r in match_odd_vertices(g, **options).collect()}


def test_path_gets_one_edge(graph):
    assert _sinks(graph([(1, 2), (2, 3)])) == {1: 3, 3: 1}


def test_single_edge_by_policy(graph):
    g = graph([(1, 2)])
    assert _sinks(g) == {1: 2, 2: 1}
    assert _sinks(g, on_unmatched="null") == {1: None, 2: None}
    assert unmatched(g, match_odd_vertices(g, on_unmatched="null")).count() == 2
    with pytest.raises(ValueError, match="no legal partner"):
        match_odd_vertices(g, on_unmatched="error")
    with pytest.raises(ValueError, match="on_unmatched"):
        match_odd_vertices(g, on_unmatched="drop")


def test_complete_graph_has_no_match(graph):
    g = graph(list(itertools.combinations(range(4), 2)))
    assert set(_sinks(g, on_unmatched="null").values()) == {None}
    assert degrees(eulerize(g)).filter("degree % 2 = 1").count() == 0


@pytest.mark.parametrize("rounds", [1, 4])
def test_rejected_pairs_find_other_partners(graph, rounds):
    # two single edges: ranks put both pairs on existing edges
    sinks = _sinks(graph([(1, 2), (3, 4)]), rounds=rounds)
    assert all(sinks[sinks[v]] == v for v in sinks) and {sinks[1], sinks[2]} == {3, 4}


def test_every_odd_vertex_gets_a_new_neighbour(graph):
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(150)]
    g = graph(pairs)
    near = {frozenset(p) for p in pairs}
    matches = match_odd_vertices(g, rounds=2)
    sinks = {r.vid: r.sink for r in matches.collect()}
    report = match_report(matches).collect()
    odd = {r.vid for r in degrees(g).filter("degree % 2 = 1").collect()}
    assert set(sinks) == odd == {v for v in sinks if sinks[v] is not None}
    assert sum(r.matched_same_degree + r.matched_other_degree for r in report) == len(odd)
    assert all(sinks[sinks[v]] == v and sinks[v] != v and frozenset((v, sinks[v])) not in near for v in sinks)
