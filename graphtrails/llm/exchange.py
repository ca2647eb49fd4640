"""Which fingerprints occur in more than one place: a compact exchange between all documents.

Every document has fingerprints at numbered positions. A Python task packs those of an Arrow batch by
cells (a hash range of the fingerprints) into few bytes each, a cell compares what all batches sent to
it, and answers go back packed per batch. Fingerprints that a batch holds several times are sent once,
marked, and known as repeated there at once; so a passage in a third of all documents costs a cell one
entry per batch, and no task gets more than its share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphtrails.llm.words import bounded_batches, mix

_SENT = "cell int, uid long, docs binary, tags binary, counts binary, gaps binary, far binary, prints binary, marks binary"
_HITS = "uid long, docs binary, tags binary, counts binary, gaps binary, far binary"
_FOUND = "_k long, _t int, places binary"
#: Cells for every shuffle partition, so that partitions get even numbers of rows.
CELLS_PER_PARTITION = 3


@dataclass
class Prints:
    """Fingerprints of one batch: row of the document, position in it, value, and whether it is indexed.

    Rows must be sorted by document and position. ``spread`` chooses the cell: an own hash there adds to
    the bits of ``value``.
    """

    row: np.ndarray
    pos: np.ndarray
    value: np.ndarray
    indexed: np.ndarray | None = None
    spread: np.ndarray | None = None


def _pack_places(row: np.ndarray, pos: np.ndarray, keys: np.ndarray, tags: np.ndarray) -> dict[str, bytes]:
    """Sorted places as documents, counts and gaps of one byte; 255 says that the gap is in ``far``."""
    if not len(row):
        return {"docs": b"", "tags": b"", "counts": b"", "gaps": b"", "far": b""}
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    starts = np.flatnonzero(new)
    gaps = pos.astype(np.int64).copy()
    gaps[1:] -= np.where(new[1:], 0, pos[:-1])
    far = gaps >= 255
    return {
        "docs": keys[row[starts]].astype("<i8").tobytes(), "tags": tags[row[starts]].astype("<i4").tobytes(),
        "counts": np.diff(np.append(starts, len(row))).astype("<u4").tobytes(),
        "gaps": np.where(far, 255, gaps).astype(np.uint8).tobytes(), "far": gaps[far].astype("<u4").tobytes(),
    }


def _places(docs: bytes, counts: bytes, gaps: bytes, far: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document's number in the message and the position of every entry."""
    counts = np.frombuffer(counts, "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.frombuffer(gaps, np.uint8).astype(np.int64)
    wide = pos == 255
    pos[wide] = np.frombuffer(far, "<u4")
    pos = np.cumsum(pos)
    if len(pos):
        starts = np.cumsum(counts) - counts
        before = np.where(starts > 0, pos[starts - 1], 0)
        pos -= np.repeat(before, counts)
    return row, pos


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_SENT_ARROW = pa.schema([("cell", pa.int32()), ("uid", pa.int64())] + [
    (c, pa.binary()) for c in ("docs", "tags", "counts", "gaps", "far", "prints", "marks")])
_HITS_ARROW = pa.schema([("uid", pa.int64())] + [(c, pa.binary()) for c in ("docs", "tags", "counts", "gaps", "far")])
_FOUND_ARROW = pa.schema([("_k", pa.int64()), ("_t", pa.int32()), ("places", pa.binary())])


def batch_id(keys: np.ndarray, tags: np.ndarray, part: int, number: int) -> int:
    """A number for a batch: the sum of its rows' hashes, so rows that stand several times count, with its place."""
    rows = mix(mix(keys.view(np.uint64)) + tags.astype(np.int64).view(np.uint64))
    place = np.array([(part << 32) + number + 1], np.uint64)
    return int(mix(mix(place) + rows.sum(dtype=np.uint64)).view(np.int64)[0])


def _send(make: Callable[[pa.RecordBatch], Prints], cells: int, width: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            p = make(batch)
            if not len(p.row):
                continue
            keys, tags = batch.column("_k").to_numpy(), batch.column("_t").to_numpy()
            uid = batch_id(keys, tags, part, number)
            order = np.argsort(p.value, kind="stable")
            value = p.value[order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            starts = np.flatnonzero(new)
            several = np.diff(np.append(starts, len(value))) > 1
            index = np.ones(len(starts), bool) if p.indexed is None else np.maximum.reduceat(p.indexed[order], starts)
            at = order[starts]
            kept = np.zeros(len(p.row), bool)
            kept[at] = True
            marks = np.zeros(len(p.row), np.uint8)
            marks[at] = several + 2 * index
            known = np.zeros(len(p.row), bool)
            known[order] = np.repeat(several, np.diff(np.append(starts, len(value))))
            out = []
            if known.any():
                out.append({"cell": abs(uid) % cells, "uid": uid, "prints": None, "marks": None}
                           | _pack_places(p.row[known], p.pos[known], keys, tags))
            at = np.flatnonzero(kept)
            spread = p.value[at] if p.spread is None else p.spread[at]
            cell = ((spread >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)
            by = np.argsort(cell, kind="stable")
            bounds = np.searchsorted(cell[by], np.arange(cells + 1))
            for c in range(cells):
                own = at[by[bounds[c]:bounds[c + 1]]]
                if len(own):
                    prints = p.value[own].astype("<u8" if width == 8 else "<u4").tobytes()
                    bits = np.concatenate([np.packbits(marks[own] & 1), np.packbits(marks[own] >> 1)]).tobytes()
                    out.append({"cell": c, "uid": uid, "prints": prints, "marks": bits}
                               | _pack_places(p.row[own], p.pos[own], keys, tags))
                if len(out) >= 64:
                    yield _batch(out, _SENT_ARROW)
                    out = []
            if out:
                yield _batch(out, _SENT_ARROW)
    return send


def _compare(width: int):
    kind = "<u8" if width == 8 else "<u4"

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known = [r for r in rows if r["prints"] is None]
        sent = [r for r in rows if r["prints"] is not None]
        out = [{c: r[c] for c in _HITS_ARROW.names} for r in known]
        if sent:
            value = np.concatenate([np.frombuffer(r["prints"], kind) for r in sent])
            sizes = [len(r["prints"]) // width for r in sent]
            several, index = [], []
            for r, n in zip(sent, sizes):
                half = (n + 7) // 8
                marks = np.frombuffer(r["marks"], np.uint8)
                several.append(np.unpackbits(marks[:half], count=n))
                index.append(np.unpackbits(marks[half:], count=n))
            order = np.argsort(value, kind="stable")
            ranked = value[order]
            new = np.ones(len(ranked), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            starts = np.flatnonzero(new)
            counts = np.diff(np.append(starts, len(ranked)))
            total = np.add.reduceat(np.concatenate(several)[order], starts) + counts
            hit = (total > 1) & (np.maximum.reduceat(np.concatenate(index)[order], starts) > 0)
            hits = np.zeros(len(value), bool)
            hits[order] = np.repeat(hit, counts)
            at = 0
            for r, n in zip(sent, sizes):
                mine, at = hits[at:at + n], at + n
                if mine.any():
                    row, pos = _places(r["docs"], r["counts"], r["gaps"], r["far"])
                    keys, tags = np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["tags"], "<i4")
                    out.append({"uid": r["uid"]} | _pack_places(row[mine], pos[mine], keys, tags))
        return pa.Table.from_pylist(out, schema=_HITS_ARROW)
    return compare


def _gather(table: pa.Table) -> pa.Table:
    keys, tags, places = [], [], []
    for r in table.to_pylist():
        row, pos = _places(r["docs"], r["counts"], r["gaps"], r["far"])
        keys.append(np.frombuffer(r["docs"], "<i8")[row])
        tags.append(np.frombuffer(r["tags"], "<i4")[row])
        places.append(pos)
    key, tag, pos = np.concatenate(keys), np.concatenate(tags), np.concatenate(places)
    order = np.lexsort((pos, tag, key))
    key, tag, pos = key[order], tag[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
    starts = np.flatnonzero(new)
    parts = np.split(pos.astype("<u4"), starts[1:])
    return pa.table([pa.array(key[starts]), pa.array(tag[starts]), pa.array([np.unique(p).tobytes() for p in parts], pa.binary())],
                    schema=_FOUND_ARROW)


def repeated(docs: DataFrame, make: Callable[[pa.RecordBatch], Prints], width: int = 4) -> DataFrame:
    """``(_k, _t, places)``: positions (little-endian 32 bits) whose fingerprint also occurs elsewhere.

    ``docs`` has ``_k`` and ``_t``, and what ``make`` reads. ``width`` bytes of a fingerprint beside its
    cell are compared: 4 for a filter, 8 where the answer counts. If ``make`` marks indexed
    fingerprints, at least one of the equal ones must be indexed, except inside one batch. A document may
    have several rows if its batches' places are unlike; their places are disjoint parts of the whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cells = CELLS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.mapInArrow(_send(make, cells, width), _SENT)
    hits = sent.groupBy("cell").applyInArrow(_compare(width), _HITS)
    return hits.groupBy("uid").applyInArrow(_gather, _FOUND)
