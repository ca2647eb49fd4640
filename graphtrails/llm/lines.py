"""Line dedup by sorted hashes and keep bitmaps.

Lines become (hash, document, position). These are range-partitioned by hash and document, so that a
line of a third of all documents spans many partitions, and sorted by hash, document and position. A
task streams over its part: the first occurrence of a hash in a document counts the document, and from
``min_docs`` documents on all lines of the hash go. Only the first and the last hash of a partition can
go on in another one; their counts, two rows per partition, are summed apart. What comes back per document
is a compressed bitmap of the lines that stay, not text.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Null and empty texts
are one empty line. Rows of one id and equal text are one document; of one id and different texts, several.
Further columns pass through untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from graphtrails.llm.words import bounded_batches, doc_key, keyed
from graphtrails.scratch import Scratch

MIN_DOCS = 10
MIN_CHARS = 1
_BLANKS = b" \t\n\x0b\x0c\r"


def _hashes(min_chars: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, high, low = [], [], [], []
            for d, text in enumerate(batch.column("text").to_pylist()):
                for i, line in enumerate(text.encode().split(b"\n")):
                    key = line.strip(_BLANKS).lower()  # bytes.lower changes A-Z only
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        h = xxhash.xxh3_128_intdigest(key)
                        row.append(d)
                        pos.append(i)
                        high.append(h >> 64)
                        low.append(h & 0xFFFFFFFFFFFFFFFF)
            row = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint64).view(np.int64)),
                batch.column("_k").take(pa.array(row)), batch.column("_t").take(pa.array(row)), pa.array(np.array(pos, np.int32)),
            ], names=["h", "l", "_k", "_t", "pos"])
    return hashes


_RUN = "h long, l long, _k long, _t int, pos int, docs int, edge boolean"


def _runs(min_docs: int):
    """Lines of frequent hashes; for the hash at either end of the partition, its lines or only its count."""
    names = ["h", "l", "_k", "_t", "pos"]

    def emit(cols: list[np.ndarray], docs: int, edge: bool) -> pa.RecordBatch:
        n = len(cols[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in cols] + [pa.array(np.full(n, docs, np.int32)), pa.array(np.full(n, edge))],
            names=names + ["docs", "edge"])

    def count(cols: list[np.ndarray]) -> int:
        k, t = cols[2], cols[3]
        return 1 + int(((k[1:] != k[:-1]) | (t[1:] != t[:-1])).sum())

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # lines of the hash that is open, while it has too few documents
        docs, last, first = 0, None, True  # documents of the open hash, its last document, whether it is the first

        def close(final: bool) -> Iterator[pa.RecordBatch]:
            edge = first or final
            if docs >= min_docs:
                if edge:  # tell the other partitions
                    yield emit([np.array([x], d) for x, d in zip((*last[:2], 0, 0, -1), (np.int64, np.int64, np.int64, np.int32, np.int32))], docs, True)
            elif edge:
                yield emit(held, docs, True)

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if not len(cols[0]):
                continue
            h, l, k, t, _ = cols
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (l[1:] != l[:-1])
            starts = np.append(np.flatnonzero(new), len(h))
            fresh = new.copy()
            fresh[1:] |= (k[1:] != k[:-1]) | (t[1:] != t[:-1])
            counts = np.add.reduceat(fresh.astype(np.int64), starts[:-1])
            begin = 0
            if last is not None and (h[0], l[0]) == last[:2]:
                own = [c[:starts[1]] for c in cols]
                more = count(own) - ((k[0], t[0]) == last[2:])
                if docs < min_docs <= docs + more:
                    yield emit(held, docs, False)
                if docs + more >= min_docs:
                    yield emit(own, docs, False)
                    held = None
                else:
                    held = [np.concatenate(x) for x in zip(held, own)]
                docs += more
                last = (h[0], l[0], k[starts[1] - 1], t[starts[1] - 1])
                begin = 1
            if begin < len(starts) - 1:
                if last is not None:
                    yield from close(False)
                    first = False
                final = len(starts) - 2
                inner = begin
                if last is None and begin < final:  # the first hash of the partition ends here
                    own = [c[starts[0]:starts[1]] for c in cols]
                    docs, last, held = int(counts[0]), (h[0], l[0], 0, 0), own
                    if docs >= min_docs:
                        yield emit(own, docs, False)
                    yield from close(False)
                    first, inner = False, 1
                often = np.zeros(len(starts) - 1, bool)
                often[inner:final] = counts[inner:final] >= min_docs
                if often.any():
                    mine = np.repeat(often, np.diff(starts))
                    yield emit([c[mine] for c in cols], min_docs, False)
                held = [c[starts[final]:] for c in cols]
                docs, last = int(counts[final]), (h[-1], l[-1], k[-1], t[-1])
                if docs >= min_docs:
                    yield emit(held, docs, False)
                    held = None
        if last is not None:
            yield from close(True)
    return runs


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """``(_k, _t, pos)``: the lines, numbered from 0, whose key stands in ``min_docs`` documents or more."""
    scratch = scratch or Scratch.of(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    lines = keyed(docs).mapInArrow(_hashes(min_chars), "h long, l long, _k long, _t int, pos int")
    placed = lines.repartitionByRange("h", "l", "_k", "_t").sortWithinPartitions("h", "l", "_k", "_t", "pos")
    runs = scratch.save(placed.mapInArrow(_runs(min_docs), _RUN), "lines")
    ends = runs.filter("edge")
    # one row per hash and partition end; the same document may be on both sides of a bound
    counts = ends.filter("pos = -1").select("h", "l", F.col("docs").alias("_d")).unionByName(
        ends.filter("pos >= 0").select("h", "l", "_k", "_t").distinct().groupBy("h", "l").agg(F.count(F.lit(1)).alias("_d")))
    often = counts.groupBy("h", "l").agg(F.sum("_d").alias("_d")).filter(F.col("_d") >= min_docs).select("h", "l")
    late = ends.filter("pos >= 0").join(often, ["h", "l"], "left_semi")
    return runs.filter("NOT edge").select("_k", "_t", "pos").unionByName(late.select("_k", "_t", "pos"))


def _bitmap(table: pa.Table) -> pa.Table:
    key, tag, pos = (table.column(c).to_numpy() for c in ("_k", "_t", "pos"))
    order = np.lexsort((pos, tag, key))
    key, tag, pos = key[order], tag[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
    starts = np.flatnonzero(new)
    maps = []
    for own in np.split(pos, starts[1:]):
        stay = np.ones((int(own[-1]) // 8 + 1) * 8, bool)
        stay[own] = False
        maps.append(zlib.compress(np.packbits(stay).tobytes(), 1))
    return pa.table([pa.array(key[starts]), pa.array(tag[starts]), pa.array(maps, pa.binary())], names=["_k", "_t", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """``(_k, _t, keep)``: per document that loses lines, a zlib-compressed bitmap, 1 for a line that stays.

    Lines after the bitmap's end stay.
    """
    gone = dropped_lines(docs, min_docs, min_chars, scratch)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone = gone.withColumn("_b", F.pmod(F.xxhash64("_k", "_t"), F.lit(buckets)))
    return gone.groupBy("_b").applyInArrow(_bitmap, "_k long, _t int, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, dropped, kept = [], [], []
        for text, keep in zip(batch.column("_text").to_pylist(), batch.column("keep").to_pylist()):
            lines = text.split("\n")
            n.append(len(lines))
            if keep is not None:
                stay = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:len(lines)]
                gone = set(np.flatnonzero(stay == 0).tolist())
                lines = [x for i, x in enumerate(lines) if i not in gone]
            dropped.append(n[-1] - len(lines))
            kept.append("\n".join(lines))
        names = [c for c in batch.schema.names if c not in ("_text", "keep")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
            names=names + ["n_lines", "n_dropped", "kept"])


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, ``n_lines``, ``n_dropped`` and ``kept``: the text without frequent lines."""
    bitmaps = keep_bitmaps(docs, min_docs, min_chars)
    text = F.coalesce("text", F.lit(""))
    all_docs = docs.select(*carry, doc_key().alias("_k"), F.hash(text).alias("_t"), text.alias("_text"))
    both = all_docs.join(bitmaps, ["_k", "_t"], "left").drop("_k", "_t")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    return both.mapInArrow(_apply, f"{out}, n_lines long, n_dropped long, kept string")


def line_digests(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every document."""
    return drop_lines(docs, min_docs, min_chars).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
