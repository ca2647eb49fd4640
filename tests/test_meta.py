import random

import pytest

from graphtrails.operators import meta


def _greedy(edges, parts):
    free, pairs = set(parts), []
    for w, a, b in sorted(((w, a, b) for (a, b), w in edges.items()), key=lambda x: (-x[0], x[1], x[2])):
        if a in free and b in free:
            free -= {a, b}
            pairs.append((a, b))
    return sorted(pairs) + sorted((p, None) for p in free)


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_is_that_of_going_through_all_pairs(spark, seed):
    rng = random.Random(seed)
    parts = range(9)
    edges = {(a, b): rng.randrange(1, 5) for a in parts for b in parts if a < b and rng.random() < 0.5}
    rows = [r for (a, b), w in edges.items() for r in ((a, b, w), (b, a, w))]
    rows += [(p, None, 0) for p in parts if not any(p in e for e in edges)]
    table = spark.createDataFrame(rows, meta.META)
    got = [tuple(r) for r in meta.max_weight_matching(table).collect()]
    assert sorted(got, key=str) == sorted(_greedy(edges, parts), key=str)
    assert meta.meta_symmetry(table).count() == 0


def test_tree_of_separate_parts_stops(spark):
    table = spark.createDataFrame([(0, 1, 2), (1, 0, 2), (2, None, 0)], meta.META)
    tree = sorted((tuple(r) for r in meta.merge_tree(table).collect()), key=str)
    assert tree == [(1, 0, 1), (1, 2, None)]


def test_given_tree_names_each_part_once(spark):
    with pytest.raises(ValueError, match="twice"):
        meta.given_merge_tree(spark, [[(0, 1), (1, 2)]])
