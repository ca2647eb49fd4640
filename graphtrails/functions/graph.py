"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed layout of packed ids: 8 bits of partition, 1 flag bit, 55 bits of source vertex in a trail
# id; 8 bits of partition and 56 bits of vertex in a remote neighbour.
PART_SHIFT = 56
FLAG_BIT = 1 << 55
SOURCE_MASK = (1 << 55) - 1
VERTEX_MASK = (1 << 56) - 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_dart(eid: Column | str) -> Column:
    """The dart of an edge that leaves ``u``; the other one is its twin."""
    return F.shiftleft(_col(eid), 1)


def trail_id(part: Column | str, source: Column | str) -> Column:
    """Packed trail id of a partition and the vertex where the trail starts."""
    return (
        F.shiftleft(_col(part).cast("long"), PART_SHIFT)
        .bitwiseOR(F.lit(FLAG_BIT))
        .bitwiseOR(_col(source).bitwiseAND(F.lit(SOURCE_MASK)))
    )


def pack_remote(part: Column | str, vid: Column | str) -> Column:
    return F.shiftleft(_col(part).cast("long"), PART_SHIFT).bitwiseOR(
        _col(vid).bitwiseAND(F.lit(VERTEX_MASK))
    )


def join_longs(values: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)
