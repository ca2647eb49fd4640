"""Packing of documents into token sequences by Karmarkar-Karp multiway differencing.

Every task packs its own documents, block by block; nothing is shuffled. A document's ids are cut into
whole sequences first; what is left is cut into even pieces. Then a block's pieces are partitioned into k
windows: each piece starts as a partial partition with one filled window, and the two partitions of the
largest imbalance are merged again and again, the fullest window of one with the emptiest of the other, until one
is left, whose windows are nearly equal. Where a window is over the capacity, k rises and the block is
packed anew. Only the last block of a task may be small.

Null and empty texts are the end id alone. Rows that repeat an id are packed like others. Further columns
are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from graphtrails.llm.tokens import encoded
from graphtrails.llm.words import bounded_batches

CAPACITY = 2048
END = 1
#: Tokens of a block (of one task at a time), and of a piece, at most.
BLOCK = 1 << 19
PIECE = 512
#: Tokens that the first number of windows leaves free in each, on average: windows are nearly equal, not equal.
ROOM = 16
_TASK_BITS = 33


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of every piece."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    # a partition is its windows' sums in ascending order and, for each, a node: a piece or a pair of nodes
    left, right = [], []
    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], nodes[-1] = sizes[i], i
        heap.append((-int(sizes[i]), int(i), sums, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, other = a + b[::-1], y[::-1]
        both = np.flatnonzero((x >= 0) & (other >= 0))
        nodes = np.where(x >= 0, x, other)
        nodes[both] = n + len(left) + np.arange(len(both))
        left += x[both].tolist()
        right += other[both].tolist()
        by = np.argsort(sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        order += 1
        heapq.heappush(heap, (int(sums[0] - sums[-1]), order, sums - sums[0], nodes))
    window = np.empty(n + len(left), np.int64)
    _, _, _, nodes = heap[0]
    filled = nodes >= 0
    window[nodes[filled]] = np.flatnonzero(filled)
    for j in range(len(left) - 1, -1, -1):
        window[left[j]] = window[right[j]] = window[n + j]
    return window[:n]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of pieces of at most ``capacity``, none over it; their number rises until that holds."""
    k = max(1, -(-int(sizes.sum()) // max(1, capacity - ROOM)))
    while True:
        window = difference(sizes, k)
        if np.bincount(window, sizes, k).max() <= capacity:
            return window
        k += max(1, k >> 8)


def _cut(lengths: np.ndarray, capacity: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of all pieces; those of a whole sequence are not cut further."""
    doc, start, size = [], [], []
    for d, n in enumerate(lengths.tolist()):
        whole = n // capacity
        rest = n - whole * capacity
        parts = -(-rest // piece)
        bounds = [whole * capacity + rest * j // parts for j in range(parts + 1)] if parts else []
        first = [j * capacity for j in range(whole)]
        start += first + bounds[:-1]
        size += [capacity] * whole + [b - a for a, b in zip(bounds, bounds[1:])]
        doc += [d] * (whole + parts)
    return np.array(doc, np.int64), np.array(start, np.int64), np.array(size, np.int64)


def _place(lengths: np.ndarray, capacity: int, piece: int) -> tuple[np.ndarray, ...]:
    """Document, start, length, sequence and offset of all pieces of a block, by sequence."""
    doc, start, size = _cut(lengths, capacity, piece)
    sequence = np.empty(len(doc), np.int64)
    full = size == capacity
    sequence[full] = np.arange(full.sum())
    if (~full).any():
        sequence[~full] = windows(size[~full], capacity) + full.sum()
    order = np.lexsort((start, doc, sequence))
    doc, start, size, sequence = doc[order], start[order], size[order], sequence[order]
    offset = np.cumsum(size) - size
    first = np.ones(len(doc), bool)
    first[1:] = sequence[1:] != sequence[:-1]
    offset -= np.maximum.accumulate(np.where(first, offset, 0))
    return doc, start, size, np.cumsum(first) - 1, offset


def _pack(tokenizer: str, end: int, capacity: int, block: int, piece: int, digest: bool):
    names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _TASK_BITS
        docs: list[tuple[int | None, bytes]] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal base
            lengths = np.array([len(ids) // 4 for _, ids in docs], np.int64)
            doc, start, size, sequence, offset = _place(lengths, capacity, piece)
            cut = [memoryview(docs[d][1])[4 * a:4 * (a + n)] for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist())]
            body = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if digest else pa.array(
                [np.frombuffer(x, "<u4").astype(np.int32) for x in cut], pa.list_(pa.int32()))
            out = [pa.array([docs[d][0] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(size), body,
                   pa.array(lengths[doc]), pa.array(sequence + base), pa.array(offset)]
            base += int(sequence[-1]) + 1
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded(tokenizer, end, batch)):
                docs.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= block:
                    yield close()
                    docs, tokens = [], 0
        if docs:
            yield close()
    return pack


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = END, capacity: int = CAPACITY,
         block: int = BLOCK, piece: int = PIECE, digest: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, one row per piece.

    With ``digest`` the checksum ``ids_crc32`` stands in place of ``ids``. Sequences are padded by who
    reads them; the task's number is in the high bits of ``sequence_id``.
    """
    bounded_batches(docs.sparkSession)
    body = "ids_crc32 long" if digest else "ids array<int>"
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    return text.withColumnRenamed("_text", "text").mapInArrow(
        _pack(tokenizer, end, capacity, block, piece, digest),
        f"doc_id long, start long, length long, {body}, doc_tokens long, sequence_id long, offset long")


def packing_report(docs: DataFrame) -> DataFrame:
    return pack(docs, digest=True)
