"""Joining objects that meet at common places, in rounds of random hooking.

``meetings(place..., obj)`` says which objects touch which places. In every round each object gets a
random priority; at each place the object with the lowest one is the root, and every other object
hooks once, to the best root over its places. Priorities fall along hooks, so hooks form a forest.
About half of the objects that still meet others vanish per round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphtrails.scratch import Scratch


def _priority(obj: Column | str, number: int) -> Column:
    # xxhash64 of one long is a bijection for each seed, so priorities never tie
    return F.xxhash64(obj, F.lit(number))


def hook_round(
    meetings: DataFrame, places: Sequence[str], number: int, scratch: Scratch
) -> tuple[DataFrame, int]:
    """``hooks(obj, parent, place...)`` of one round and their number."""
    drawn = meetings.withColumn("_p", _priority("obj", number))
    best = (
        drawn.groupBy(*places)
        .agg(F.min("_p").alias("_best"), F.min_by("obj", "_p").alias("_root"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )
    hooks = (
        drawn.join(best, list(places))
        .filter(F.col("obj") != F.col("_root"))
        .groupBy("obj")
        .agg(F.min_by(F.struct("_root", *places), "_best").alias("_h"))
        .select("obj", F.col("_h._root").alias("parent"), *[F.col(f"_h.{p}").alias(p) for p in places])
    )
    hooks, seen = scratch.save(hooks, "hooks", n=F.count(F.lit(1)))
    return hooks, seen["n"]


def climb(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """``(obj, root)`` for every hooked object, by pointer jumping."""
    up = hooks.select("obj", F.col("parent").alias("root"))
    while True:
        for _ in range(2):
            above = up.select(F.col("obj").alias("root"), F.col("root").alias("_root"))
            up = up.join(above, "root", "left").select(
                "obj", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")
            )
        saved, seen = scratch.save(up, "climb", moved=F.count(F.when(F.col("_moved"), 1)))
        up = saved.drop("_moved")
        if seen["moved"] == 0:
            return up


def relabel(rows: DataFrame, obj: str, roots: DataFrame) -> DataFrame:
    """Replace ``obj`` by its root where it has one."""
    new = roots.select(F.col("obj").alias(obj), F.col("root").alias("_root"))
    return rows.join(new, obj, "left").withColumn(obj, F.coalesce("_root", obj)).drop("_root")


def meeting_roots(meetings: DataFrame, places: Sequence[str], scratch: Scratch) -> DataFrame:
    """``(obj, root)``: one root for every set of objects connected over common places.

    Objects that never hook are their own root and have no row.
    """
    now = scratch.save(meetings.select(*places, "obj").distinct(), "meetings")
    total, number = None, 0
    while True:
        number += 1
        hooks, n = hook_round(now, places, number, scratch)
        if n == 0:
            break
        roots = climb(hooks, scratch)
        if total is None:
            total = roots
        else:
            moved = relabel(total, "root", roots)
            total = scratch.save(moved.unionByName(roots), "roots")
        merged = relabel(now, "obj", roots).distinct()
        several = merged.groupBy(*places).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        now = scratch.save(merged.join(several.drop("_n"), list(places), "left_semi"), "meetings")
    if total is None:
        return meetings.select("obj", F.col("obj").alias("root")).limit(0)
    return total


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(vid, component)``: every vertex with the smallest vertex of its connected component."""
    scratch = scratch or Scratch.of(edges.sparkSession)
    plain = edges.filter(F.col("u") != F.col("v")).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    ).distinct()
    roots = edge_roots(plain, scratch)
    vertices = edges.select(F.inline(F.array(F.struct(F.col("u").alias("vid")), F.struct(F.col("v").alias("vid"))))).distinct()
    named = vertices.join(roots.withColumnRenamed("obj", "vid"), "vid", "left").withColumn(
        "root", F.coalesce("root", "vid")
    )
    smallest = named.groupBy("root").agg(F.min("vid").alias("component"))
    return named.join(smallest, "root").select("vid", "component")


def edge_roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(obj, root)`` over distinct edges ``(u, v)``: each vertex hooks to its lowest neighbour."""
    total, number = None, 0
    now = scratch.save(edges, "links")
    while True:
        number += 1
        both = now.select(F.inline(F.array(
            F.struct(F.col("u").alias("obj"), F.col("v").alias("nbr")),
            F.struct(F.col("v").alias("obj"), F.col("u").alias("nbr")),
        )))
        lower = both.filter(_priority("nbr", number) < _priority("obj", number))
        hooks, seen = scratch.save(
            lower.groupBy("obj").agg(F.min_by("nbr", _priority("nbr", number)).alias("parent")),
            "hooks", n=F.count(F.lit(1)),
        )
        if seen["n"] == 0:
            break
        roots = climb(hooks, scratch)
        total = roots if total is None else scratch.save(relabel(total, "root", roots).unionByName(roots), "roots")
        moved = relabel(relabel(now, "u", roots), "v", roots).filter(F.col("u") != F.col("v"))
        now = scratch.save(
            moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links"
        )
    if total is None:
        return edges.select(F.col("u").alias("obj"), F.col("u").alias("root")).limit(0)
    return total
