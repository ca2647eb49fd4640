"""Graphs made from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


APEX = 1 << 40
APEX_EDGES = 1 << 50


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return _table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 1000 + F.row_number().over(w)).cast("long").alias("eid"),
        F.col("l_orderkey").cast("long").alias("l_orderkey"),
        F.col("l_partkey").cast("long").alias("l_partkey"),
        F.col("l_suppkey").cast("long").alias("l_suppkey"),
        F.lead("l_partkey").over(w).cast("long").alias("next_part"),
    )


def part_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive parts of an order: self-loops and parallel edges."""
    return (
        _lines(spark, folder)
        .filter(F.col("next_part").isNotNull())
        .select("eid", F.col("l_partkey").alias("u"), F.col("next_part").alias("v"))
    )


def cust_part(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and the parts they ordered: bipartite."""
    orders = _table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("long").alias("l_orderkey"), F.col("o_custkey").cast("long").alias("c")
    )
    return (
        _lines(spark, folder)
        .join(orders, "l_orderkey")
        .select("eid", (F.col("c") * 2).alias("u"), (F.col("l_partkey") * 2 + 1).alias("v"))
    )


def part_supp(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and their suppliers: bipartite with hubs."""
    return _lines(spark, folder).select(
        "eid", (F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v")
    )


def apex_edges(g: DataFrame) -> DataFrame:
    """An edge from every odd vertex to one extra vertex."""
    ends = g.select(F.inline(F.array(F.struct(F.col("u").alias("vid")), F.struct(F.col("v").alias("vid")))))
    odd = ends.groupBy("vid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") % 2 == 1)
    return odd.select(
        (F.lit(APEX_EDGES) + F.col("vid")).alias("eid"),
        F.lit(APEX).alias("u"),
        F.col("vid").alias("v"),
    )


def with_apex(g: DataFrame) -> DataFrame:
    """An even graph with known edges: every odd vertex joined to one extra vertex."""
    return g.unionByName(apex_edges(g))


def parts_by_residue(g: DataFrame, parts: int) -> DataFrame:
    """``vertex_part`` by the residue of the vertex id."""
    return (
        g.select(F.inline(F.array(F.struct(F.col("u").alias("vid")), F.struct(F.col("v").alias("vid")))))
        .distinct()
        .select("vid", F.pmod("vid", F.lit(parts)).cast("int").alias("part"))
    )


# The same graphs as SQL text, for the result checks.
LINES_SQL = """lines AS (
  SELECT CAST(l_orderkey * 1000 + row_number() OVER w AS BIGINT) AS eid,
         CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey,
         CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(lead(l_partkey) OVER w AS BIGINT) AS next_part
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""

EDGES_SQL = {
    "part_chain": "edges AS (SELECT eid, l_partkey AS u, next_part AS v FROM lines WHERE next_part IS NOT NULL)",
    "cust_part": """edges AS (SELECT eid, CAST(2 * o_custkey AS BIGINT) AS u, 2 * l_partkey + 1 AS v
  FROM lines JOIN orders ON o_orderkey = l_orderkey)""",
    "part_supp": "edges AS (SELECT eid, 2 * l_partkey AS u, 2 * l_suppkey + 1 AS v FROM lines)",
}

APEX_SQL = f"""edges AS (
  SELECT eid, u, v FROM plain
  UNION ALL
  SELECT {APEX_EDGES} + vid, CAST({APEX} AS BIGINT), vid
  FROM (SELECT u AS vid FROM plain UNION ALL SELECT v FROM plain) GROUP BY vid HAVING count(*) % 2 = 1)"""
