"""Work that must not end up in one task because its description is short."""

from pyspark.sql import functions as F

from graphtrails.operators import tables
from graphtrails.sources import binary


def _tasks(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


def _ring(spark, n):
    return spark.range(n).selectExpr("id AS eid", "id AS u", f"(id + 1) % {n} AS v")


def test_files_and_ranges_are_read_by_several_tasks(spark, tmp_path):
    # adaptive execution brings the few bytes of a table of files or ranges into one task
    adj = tables.adjacency(_ring(spark, 400))
    binary.write_adjacency_binary(adj, str(tmp_path / "adj"), file_bytes=1600)
    for range_bytes in (1 << 20, 300):  # files whole, and every file by ranges
        rows = binary.read_adjacency_binary(spark, str(tmp_path / "adj"), range_bytes=range_bytes)
        assert _tasks(rows) >= 4
        assert {r.vid: sorted(r.nbrs) for r in rows.collect()} == {i: sorted([(i + 1) % 400, (i - 1) % 400]) for i in range(400)}


def test_each_file_of_the_sink_is_a_task_of_its_own(spark):
    g = _ring(spark, 300)
    parts = g.selectExpr("u AS vid", "cast(u % 5 AS int) AS part")
    rows = tables.split_local_remote(g, parts).selectExpr(
        "part % 3 AS _split", "part", "vid", "chunk", "local", "flatten(map_values(remote)) AS packed")
    size = 17 + 8 * (F.size("local") + F.size("packed"))
    dealt, files = binary._dealt(rows, ["_split"], ["vid", "chunk"], size, ["local", "packed"], 1000)
    named = dealt.select("_split", "_file", "_task").distinct().collect()
    assert files == len(named) == len({(r["_split"], r["_file"]) for r in named}) and {r["_task"] for r in named} == set(range(files))
    assert dealt.count() == 300


def test_a_partitioned_file_is_read_by_several_tasks(spark, tmp_path):
    g = _ring(spark, 400)
    pa = tables.split_local_remote(g, g.selectExpr("u AS vid", "cast(u % 2 AS int) AS part"))
    binary.write_partitioned_binary(pa, str(tmp_path / "pa"), splits=1)
    rows = binary.read_partitioned_binary(spark, str(tmp_path / "pa"), range_bytes=300)
    assert _tasks(rows) >= 4 and rows.count() == 400
    assert {(r.vid, r.part): sorted(r.remote[1 - r.part]) for r in rows.collect()} == {
        (i, i % 2): sorted([(i + 1) % 400, (i - 1) % 400]) for i in range(400)}
