"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever its remainder by the block size is the
block size minus one. Every chunk gives one of 64 characters; the chunks' characters are the signature. A
fingerprint is ``block size:signature:signature at twice the block size``. The block size is the largest power of two
times ``LEAST_BLOCK`` that still gives ``CHUNKS / 2`` chunks. Fingerprints are compared by the edit distance
(insertions and deletions) of signatures at equal block sizes, 1 meaning equal. Signatures without a common run of
``COMMON`` characters have nothing in common; so do incompatible block sizes.

Null is the empty text, whose fingerprint has empty signatures; two empty texts are alike (1.0), an empty
and another one are not. Rows that repeat an id stand next to each other, in order of their text's hash;
a null id comes first. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphtrails.llm.words import bounded_batches, doc_key, mix

REACH = 7
CHUNKS = 64
LEAST_BLOCK = 3
COMMON = 5
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Bytes worked on at once, so that a very long text needs little memory.
_SPAN = 1 << 20


def _rolling(data: np.ndarray) -> np.ndarray:
    """At every byte from the seventh on, a hash of it and the six before it."""
    n = len(data) - REACH + 1
    wide = data.astype(np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(REACH):
        out *= np.uint32(0x01000193)
        out += wide[k:k + n]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def _triggers(data: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes after which a chunk ends at this block size, and their rolling hashes plus one.

    An end at a block size is one at half of it too. The text is preceded by zeros.
    """
    ends, values = [], []
    padded = np.concatenate([np.zeros(REACH - 1, np.uint8), data])
    for at in range(0, len(data), _SPAN):
        rolled = _rolling(padded[at:at + _SPAN + REACH - 1]).astype(np.uint64) + np.uint64(1)
        own = np.flatnonzero(rolled % np.uint64(block) == 0)
        ends.append(own + at)
        values.append(rolled[own])
    return np.concatenate(ends), np.concatenate(values)


def _signature(data: np.ndarray, ends: np.ndarray) -> str:
    """A character per chunk, from a hash of its bytes and their places in it."""
    n = len(data)
    last = ends if len(ends) and ends[-1] == n - 1 else np.append(ends, n - 1)
    begins = np.append(0, last[:-1] + 1)
    sums = np.zeros(len(last), np.uint64)
    for at in range(0, n, _SPAN):
        to = min(n, at + _SPAN)
        lo, hi = np.searchsorted(last, at), np.searchsorted(last, to - 1) + 1
        starts = np.maximum(begins[lo:hi], at)
        place = np.arange(at, to) - np.repeat(begins[lo:hi], np.diff(np.append(starts, to)))
        value = mix((place.astype(np.uint64) << np.uint64(8)) + data[at:to] + np.uint64(1))
        sums[lo:hi] += np.add.reduceat(value, starts - at)
    return _LETTERS[(mix(sums) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    block = LEAST_BLOCK
    while block * CHUNKS < len(data):
        block *= 2
    known = 0
    while True:
        if known == 0 or block < known:
            known = max(LEAST_BLOCK, block // 4)
            places, values = _triggers(data, known)
        ends = places[values % np.uint64(block) == 0]
        if block == LEAST_BLOCK or len(ends) + 1 >= CHUNKS // 2:
            break
        block //= 2
    wider = places[values % np.uint64(2 * block) == 0]
    return f"{block}:{_signature(data, ends)}:{_signature(data, wider)}"


def _parts(fingerprint: str) -> tuple[int, str, str]:
    block, one, two = fingerprint.split(":")
    return int(block), one, two


def _common_run(a: str, b: str) -> bool:
    if min(len(a), len(b)) < COMMON:
        return a == b
    runs = {a[i:i + COMMON] for i in range(len(a) - COMMON + 1)}
    return any(b[i:i + COMMON] in runs for i in range(len(b) - COMMON + 1))


def _longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        found = state & masks.get(c, 0)
        state = ((state + found) | (state - found)) & full
    return len(a) - state.bit_count()


def likeness(one: str, other: str) -> float:
    """0 to 1: how alike two fingerprints are, at the best of their common block sizes."""
    if one == other:
        return 1.0
    (x, *a), (y, *b) = _parts(one), _parts(other)
    best = 0.0
    for i, s in enumerate(a):
        for j, t in enumerate(b):
            if x << i == y << j and s and t and _common_run(s, t):
                best = max(best, 2 * _longest_common(s, t) / (len(s) + len(t)))
    return best


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is compared with the next one of its bucket. Guests only serve as a next one."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before = None  # the row that waits for its next one

    def row(a: tuple, b: tuple) -> tuple:
        changed = edited(a[2], b[2])
        raw = changed.encode()
        mark = fingerprint(raw)
        return (a[1], len(a[2]), hashlib.sha256(raw).hexdigest(), a[3], mark, likeness(a[3], mark), likeness(a[3], b[3]))

    for batch in batches:
        out = []
        for bucket, doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "guest"))):
            now = (bucket, doc_id, text, fingerprint(text.encode()))
            if before is not None and before[0] == bucket:
                out.append(row(before, now))
            before = None if guest else now
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every document.

    Documents are dealt out by ranges of ``doc_id``. The first of each range also goes to the range before
    it (that of all to the last range) as a guest, so every document meets the next one in its own task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        doc_key().alias("_k"), F.xxhash64(text).alias("_h"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # bounds of about equal numbers of documents; rows of one id stay together
    bounds = rows.agg(F.percentile_approx("_k", [i / parts for i in range(1, parts)], 100 * parts).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    bucket = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("_k"))) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    ends = rows.groupBy("bucket").agg(F.min(F.struct("_k", "_h")).alias("first")).select("bucket", "first.*")
    ends = sorted(tuple(r) for r in ends.collect())  # one row per range
    before = [(k, h, b) for (_, k, h), (b, _, _) in zip(ends, ends[-1:] + ends[:-1])]
    guests = F.broadcast(spark.createDataFrame(before, "_k long, _h long, _before int"))
    here = rows.join(guests, ["_k", "_h"], "left").select("*", F.explode(F.when(
        F.col("_before").isNull(), F.array(F.struct("bucket", F.lit(False).alias("guest")))
    ).otherwise(F.array(
        F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("guest"))
    ))).alias("_at"))
    here = here.select(F.col("_at.bucket").alias("bucket"), F.col("_at.guest").alias("guest"), "_k", "_h", "doc_id", "text")
    placed = here.repartition("bucket").sortWithinPartitions("bucket", "guest", "_k", "_h")
    return placed.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                       "edited_fingerprint string, near_edited double, near_next double")
