"""Words, windows and keys of texts as numpy arrays, for the operators that run in Python tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of an Arrow batch sent to a Python worker, and of the part of it worked on at once.
BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
#: Stands for a null document id in keys.
NO_ID = -(1 << 63)

_ODD = np.uint64(0x9E3779B97F4A7C15)


def bounded_batches(spark: SparkSession) -> None:
    """Limit the Arrow batches of Python tasks by bytes, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keyed(docs: DataFrame) -> DataFrame:
    """``(_k, _t, text)``: a key that tells rows of one id with different texts apart; null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(doc_key().alias("_k"), F.hash(text).alias("_t"), text.alias("text"))


def bounded_sample(rows: DataFrame, *key: str, most: int) -> DataFrame:
    """Rows whose hash of ``key`` is below a bound that lets about ``most`` rows through, or all where there are fewer.

    The bound follows from a count, so nothing is sorted or gathered; it leaves four deviations of room below
    ``most``. ``key`` should tell rows apart.
    """
    n = rows.count()
    if n <= most:
        return rows
    share = max(1.0, most - 4 * most ** 0.5) / n
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < int(share * (1 << 40)))


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def without(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose key is not in ``keys(_k, _t)``; of equal keys one if ``once``."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    k, t = f"{mark}k", f"{mark}t"
    rows = docs.withColumn(k, doc_key()).withColumn(t, F.hash(F.coalesce("text", F.lit(""))))
    left = rows.join(keys.select(F.col("_k").alias(k), F.col("_t").alias(t)), [k, t], "left_anti")
    return (left.dropDuplicates([k, t]) if once else left).select(*docs.columns)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _ODD, np.uint64)]))
    return _powers


def byte_set(spec: str) -> np.ndarray:
    """A table of 256 truth values for a latin-1 string of bytes."""
    table = np.zeros(256, bool)
    table[list(spec.encode("latin-1"))] = True
    return table


#: [\x20\x09-\x0D]
BLANKS = byte_set(" \t\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of some texts in order: the text each is in, its place there, its bytes and its hash."""

    doc: np.ndarray
    pos: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    n_docs: int

    def windows(self, size: int, multiplier: int = 0xD1342543DE82EF95) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the first words of all windows inside one text, and the windows' hashes."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        acc, by = np.zeros(n, np.uint64), np.uint64(multiplier)
        for k in range(size):
            acc *= by
            acc += self.hash[k:n + k]
        inside = self.doc[:n] == self.doc[size - 1:]
        return np.flatnonzero(inside), mix(acc[inside])


def arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; null is empty."""
    texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``most`` bytes, or of one longer text, with the number of the first."""
    _, offsets = arrow_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def find_words(texts: pa.Array, blanks: np.ndarray = BLANKS, lower: bool = False) -> Words:
    """Maximal runs of bytes outside ``blanks``; texts never run into each other."""
    data, offsets = arrow_bytes(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~blanks[data]
    new = np.zeros(n + 1, bool)
    new[offsets[:-1]] = True
    new = new[:n]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | new[1:]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:]
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    if len(start):
        size = end - start
        within = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        within[start[0]:] -= np.repeat(start.astype(within.dtype), np.diff(start, append=n))
        outside = ~inside
        within[outside] = 0
        value = _BYTE[data]
        value *= _power(int(size.max()) + 1)[within]
        value[outside] = 0
        hashes = mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _ODD)
    else:
        hashes = np.empty(0, np.uint64)
    begins = np.searchsorted(doc, np.arange(len(texts)))
    pos = np.arange(len(doc)) - begins[doc] if len(doc) else np.empty(0, np.int64)
    return Words(doc, pos, start, end, hashes, data, len(texts))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text as ``(doc, hash)``, sorted; a shorter text is one shingle."""
    at, hashes = words.windows(size)
    doc = words.doc[at]
    count = np.bincount(words.doc, minlength=words.n_docs)
    for d in np.flatnonzero((count > 0) & (count < size)):
        own = words.hash[np.searchsorted(words.doc, d):np.searchsorted(words.doc, d, "right")]
        whole = np.full(1, len(own), np.uint64)
        for h in own:
            whole = mix(whole * _ODD + h)
        doc, hashes = np.append(doc, d), np.append(hashes, whole)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[keep], hashes[keep]
