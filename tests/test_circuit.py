import random

import pytest

from graphtrails.operators.circuit import closed_trails, euler_circuit, start_vertex, trails
from graphtrails.operators.eulerize import eulerize
from graphtrails.operators.hooks import components

TRIANGLE = [(0, 1), (1, 2), (2, 0)]
SHAPES = {
    "triangle": (TRIANGLE, 1),
    "triangles sharing a vertex": (TRIANGLE + [(0, 3), (3, 4), (4, 0)], 1),
    "two separate triangles": (TRIANGLE + [(5, 6), (6, 7), (7, 5)], 2),
    "self-loop": ([(3, 3)], 1),
    "double edge": ([(3, 4), (3, 4)], 1),
    "self-loops at one vertex": ([(3, 3)] * 4, 1),
    "star of triangles": ([e for i in range(1, 40, 2) for e in [(0, i), (i, i + 1), (i + 1, 0)]], 1),
}


def _check(rows, pairs, circuits):
    assert sorted(r.eid for r in rows) == list(range(len(pairs)))
    walks = {}
    for r in rows:
        walks.setdefault(r[0], []).append(r)
        assert sorted((r.from_vid, r.to_vid)) == sorted(pairs[r.eid])
    for walk in walks.values():
        walk.sort(key=lambda r: r.seq)
        assert [r.seq for r in walk] == list(range(len(walk)))
        assert all(a.to_vid == b.from_vid for a, b in zip(walk, walk[1:] + walk[:1]))
    if circuits is not None:
        assert len(walks) == circuits


@pytest.mark.parametrize("group_rows", [1_000_000, 2])
def test_circuits_of_shapes(graph, group_rows):
    """All shapes side by side, in one graph of several components."""
    pairs, circuits = [], 0
    for i, (shape, count) in enumerate(SHAPES.values()):
        pairs += [(u + 1000 * i, v + 1000 * i) for u, v in shape]
        circuits += count
    _check(euler_circuit(graph(pairs), group_rows=group_rows).collect(), pairs, circuits)


def test_empty_graph(graph):
    assert euler_circuit(graph([])).count() == 0


def test_circuit_of_random_multigraph(graph):
    rng = random.Random(1)
    pairs = [(rng.randrange(30), rng.randrange(30) if rng.random() < 0.6 else 0) for _ in range(120)]
    even = eulerize(graph(pairs)).collect()
    by_id = {r.eid: (r.u, r.v) for r in even}
    all_pairs = [by_id[i] for i in range(len(by_id))]
    count = len({r.component for r in components(graph(all_pairs)).collect()})
    _check(euler_circuit(graph(all_pairs), group_rows=8).collect(), all_pairs, count)
    _check(closed_trails(graph(all_pairs)).collect(), all_pairs, None)


def test_open_trails_end_at_odd_vertices(graph):
    rows = trails(graph([(0, 1), (1, 2), (2, 3)])).collect()
    ends = {r.from_vid for r in rows if r.seq == 0} | {r.to_vid for r in rows if r.seq == 2}
    assert ends == {0, 3} and not any(r.closed for r in rows)


def test_odd_graph_is_refused(graph):
    with pytest.raises(ValueError, match="odd degree"):
        euler_circuit(graph([(0, 1)]))


def test_start_vertex_takes_the_smallest_of_the_highest(graph):
    row = start_vertex(graph(TRIANGLE)).first()
    assert (row.vid, row.degree) == (0, 2)


def test_components(graph):
    rows = components(graph(TRIANGLE + [(7, 9), (9, 8), (4, 4)])).collect()
    assert {r.vid: r.component for r in rows} == {0: 0, 1: 0, 2: 0, 7: 7, 8: 7, 9: 7, 4: 4}
