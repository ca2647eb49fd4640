"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of words, and these are the index. A block
is at most ``(window + 1) // 2`` words, so each window holds a whole block. Every rolling window of a
block's length probes the index; a hit says that the words there also stand elsewhere. Windows around
hits are then compared as a whole, which extends hits to maximal exact repeats: the words of a document
covered by windows that start anywhere else too. Only documents with hits move a second time.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``. Null and empty texts have no words, and nothing is
removed from them. A row that repeats another one is an occurrence elsewhere, so both lose what the
window covers. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from graphtrails.llm.exchange import Prints, repeated
from graphtrails.llm.words import bounded_batches, doc_key, find_words, keyed, slices
from graphtrails.scratch import Scratch

WINDOW = 35
_SECOND = 0xA0761D6478BD642F


def _blocks(size: int):
    """Every rolling window of a block's length; those at multiples of it are the reference blocks."""
    def make(batch: pa.RecordBatch) -> Prints:
        parts = []
        for at, texts in slices(batch.column("text")):
            words = find_words(texts)
            first, value = words.windows(size)
            parts.append((words.doc[first] + at, words.pos[first], value))
        row, pos, value = (np.concatenate(x) for x in zip(*parts))
        return Prints(row, pos, value, pos % size == 0)
    return make


def _near_hits(doc: np.ndarray, pos: np.ndarray, hits: list[np.ndarray], window: int, block: int) -> np.ndarray:
    """Which windows, by their document and first word, hold a whole block that was hit."""
    out = np.zeros(len(pos), bool)
    for d, own in enumerate(hits):
        lo, hi = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
        if hi > lo and len(own):
            starts = pos[lo:hi]
            out[lo:hi] = np.searchsorted(own, starts + window - block, "right") > np.searchsorted(own, starts)
    return out


def _positions(column: pa.Array) -> list[np.ndarray]:
    return [np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in places])).astype(np.int64) if places
            else np.empty(0, np.int64) for places in column.to_pylist()]


def _unpack(column: pa.Array) -> pa.Array:
    read = zstandard.ZstdDecompressor()
    return pa.array([read.decompress(x).decode() for x in column.to_pylist()], pa.string())


def _windows(window: int, block: int):
    """The windows that hold a hit, as fingerprints."""
    def make(batch: pa.RecordBatch) -> Prints:
        hits, parts = _positions(batch.column("places")), []
        for at, texts in slices(_unpack(batch.column("body"))):
            words = find_words(texts)
            first, value = words.windows(window)
            _, spread = words.windows(window, _SECOND)
            doc, pos = words.doc[first], words.pos[first]
            near = _near_hits(doc, pos, hits[at:at + len(texts)], window, block)
            parts.append((doc[near] + at, pos[near], value[near], spread[near]))
        row, pos, value, spread = (np.concatenate(x) for x in zip(*parts))
        return Prints(row, pos, value, None, spread)
    return make


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    write = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        body = [write.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_k"), batch.column("_t"), pa.array(body, pa.binary())], names=["_k", "_t", "body"])


def packed(docs: DataFrame) -> DataFrame:
    """``(_k, _t, body)``: keyed texts, compressed for a shuffle."""
    return keyed(docs).mapInArrow(_packed, "_k long, _t int, body binary")


def repeats(docs: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """``(_k, _t, body)`` of documents with hits, and ``(_k, _t, starts)``: their windows that also start elsewhere."""
    scratch = scratch or Scratch.of(docs.sparkSession)
    block = (window + 1) // 2
    hits = scratch.save(repeated(keyed(docs), _blocks(block)), "hits")
    hits = hits.groupBy("_k", "_t").agg(F.collect_list("places").alias("places"))
    bodies = scratch.save(packed(docs).join(hits, ["_k", "_t"]), "bodies")
    found = repeated(bodies, _windows(window, block), width=8)
    starts = found.groupBy("_k", "_t").agg(F.collect_list("places").alias("starts"))
    return bodies.drop("places"), scratch.save(starts, "repeats")


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            starts = _positions(batch.column("starts"))
            for at, texts in slices(_unpack(batch.column("body"))):
                words = find_words(texts)
                bounds = np.searchsorted(words.doc, np.arange(len(texts) + 1))
                raw = words.data.tobytes()
                for d in range(len(texts)):
                    lo, hi = bounds[d], bounds[d + 1]
                    gone = _cover(starts[at + d], hi - lo, window)
                    n_words.append(hi - lo)
                    n_removed.append(int(gone.sum()))
                    stay = np.flatnonzero(~gone) + lo
                    kept.append(b" ".join(raw[a:b] for a, b in zip(words.start[stay].tolist(), words.end[stay].tolist())).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), batch.column("_t"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["_k", "_t", "n_words", "n_removed", "kept"])
    return cut


def cut_repeats(docs: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """``(_k, _t, n_words, n_removed, kept)`` for the documents that lose words; ``kept`` joined by one space."""
    bodies, starts = repeats(docs, window, scratch)
    both = bodies.dropDuplicates(["_k", "_t"]).join(starts, ["_k", "_t"])
    return both.mapInArrow(_cut(window), "_k long, _t int, n_words long, n_removed long, kept string")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest = [], []
        for x in batch.column("text").to_pylist():
            words = x.encode().split()  # bytes split at [\x20\x09-\x0D] only
            n.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_k"), batch.column("_t"), pa.array(n, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "_k", "_t", "n_words", "whole"])


def substring_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document."""
    bounded_batches(docs.sparkSession)
    cut = cut_repeats(docs, window).select("_k", "_t", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("_kept"))
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("_k"), F.hash(text).alias("_t"), text.alias("text"))
    whole = whole.mapInArrow(_whole, "doc_id long, _k long, _t int, n_words long, whole string")
    return whole.join(cut, ["_k", "_t"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_kept", "whole").alias("kept_sha256"))
