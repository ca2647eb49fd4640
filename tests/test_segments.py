"""Circuits whose trails are cut and joined at many places, with blocks of a few steps."""

import random

import pytest

from graphtrails.operators import circuit


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_segments_make_one_walk_per_component(graph, monkeypatch, block):
    monkeypatch.setattr(circuit, "BLOCK_STEPS", block)
    rng = random.Random(block)
    pairs, where = [], {}
    for part in range(3):
        size = rng.randrange(3, 20)
        for i in range(8):
            ring = [100 * part, *[rng.randrange(size) + 100 * part for _ in range(rng.randrange(8))]]
            pairs += zip(ring, ring[1:] + ring[:1])
        where |= {e: part for e in range(len(where), len(pairs))}
    walks = {}
    for r in circuit.euler_circuit(graph(pairs)).collect():
        walks.setdefault(r.component, []).append(r)
    assert len(walks) == 3 and sorted(r.eid for w in walks.values() for r in w) == list(range(len(pairs)))
    for name, walk in walks.items():
        walk.sort(key=lambda r: r.seq)
        assert [r.seq for r in walk] == list(range(len(walk))) and {where[r.eid] for r in walk} == {where[name]}
        assert all(a.to_vid == b.from_vid for a, b in zip(walk, walk[1:] + walk[:1]))
        assert all(sorted((r.from_vid, r.to_vid)) == sorted(pairs[r.eid]) for r in walk)
