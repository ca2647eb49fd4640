import __spark_entry__ as entry

from graphtrails.operators import checks


def test_missing_entries_show_on_the_other_side(spark, graph, monkeypatch):
    g = graph([(1, 2), (1, 3), (2, 4), (1, 3), (2, 3), (6, 8)])
    vp = spark.createDataFrame([(v, v % 2) for v in (1, 2, 3, 4, 6, 8)], "vid long, part int")
    monkeypatch.setattr(entry, "_graph", lambda spark, folder: g)
    monkeypatch.setattr(entry, "_parts", lambda g: vp)
    pa = entry._faulty_parts(spark, "")
    # darts 3 (3 to 1) and 10 (6 to 8) are missing; the second edge of 1 and 3 stays
    assert sorted(map(tuple, checks.local_edges_symmetric(pa).collect())) == [(0, 8, 0, 6), (1, 1, 1, 3), (1, 3, 1, 1)]
    assert checks.remote_edges_symmetric(pa).count() == 0
