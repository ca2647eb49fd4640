"""Periodic runs: stretches of words that repeat with a fixed period, found by block convolution.

At each dyadic scale ``B`` a text is cut into blocks of ``B`` words. A run of period ``q`` in ``[B, 2B)`` that is
at least three periods long holds a whole block together with its copy ``q`` words on (at scale 8, where all
periods below 16 are looked for, because a run has 24 words at least). So each block is compared with all
stretches that begin ``B`` to ``2B - 1`` words after it: the sums of squared differences of all these
alignments come from one cyclic convolution, as an exact number-theoretic transform modulo ``PRIME``. A sum
of zero is an occurrence. Its distance seeds an extension, word by word, to both sides; a stretch that is long
enough is a run. Distances are taken in ascending order, and what lies in a known run whose period divides
the distance is passed over, so a run is found under its smallest period and once.

A block of more than ``MOST_BLOCK`` words is looked for by its first ``MOST_BLOCK`` words, in several windows, which
finds the same runs. Words are compared as 64-bit hashes; a residue that agrees by chance is turned down by the extension.

Texts are judged whole, each by itself, in Arrow batches; nothing is shuffled. Null and empty texts have no words and no runs, and
collapse to the empty text. Repeated rows and ids are judged row by row. A null ``doc_id`` stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphtrails.llm.words import bounded_batches, find_words, mix, slices

#: 3 * 2^18 + 1, with the primitive root 10; sums of 512 products of residues stay exact in a double.
PRIME, ROOT = 786433, 10
LEAST_RUN, LEAST_PERIODS = 24, 3
LEAST_BLOCK, MOST_BLOCK = 8, 4096
#: Numbers of one convolution step.
_STEP = 1 << 19
_DIRECT = 128


def _mod(x: np.ndarray) -> np.ndarray:
    """Whole numbers below 2^53 modulo PRIME, to within one PRIME of the range."""
    x -= PRIME * np.floor(x * (1.0 / PRIME))
    return x


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent modulo PRIME."""
    out, square = np.ones(exponents.shape, np.int64), base % PRIME
    left = exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out.astype(float)


class Transform:
    """The number-theoretic transform of ``n`` numbers, as products with small matrices."""

    def __init__(self, n: int):
        self.n = n
        self.rows = n if n <= _DIRECT else 1 << (n.bit_length() // 2)
        self.columns = n // self.rows
        w = pow(ROOT, (PRIME - 1) // n, PRIME)
        i, j = np.arange(self.rows), np.arange(self.columns)
        self.forward, self.back = [], []
        for base, into in ((w, self.forward), (pow(w, -1, PRIME), self.back)):
            into.append(_powers(pow(base, self.columns, PRIME), np.outer(i, i) % self.rows))
            into.append(_powers(base, np.outer(j, i)))
            into.append(_powers(pow(base, self.rows, PRIME), np.outer(j, j) % self.columns))
        self.share = pow(n, -1, PRIME)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Of each row of ``x``; the result is in an order that only ``inverse`` and products know."""
        m = len(x)
        first, twist, last = self.forward
        if self.columns == 1:
            return _mod(x @ first)
        y = np.ascontiguousarray(x.reshape(m, self.rows, self.columns).transpose(0, 2, 1)).reshape(-1, self.rows)
        y = _mod(_mod(y @ first).reshape(m, self.columns, self.rows) * twist)
        y = np.ascontiguousarray(y.transpose(0, 2, 1)).reshape(-1, self.columns)
        return _mod(y @ last).reshape(m, self.n)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        m = len(x)
        first, twist, last = self.back
        if self.columns == 1:
            return _mod(_mod(x @ first) * self.share)
        y = _mod(x.reshape(-1, self.columns) @ last).reshape(m, self.rows, self.columns)
        y = _mod(np.ascontiguousarray(y.transpose(0, 2, 1)) * twist).reshape(-1, self.rows)
        y = _mod(_mod(y @ first) * self.share).reshape(m, self.columns, self.rows)
        return np.ascontiguousarray(y.transpose(0, 2, 1)).reshape(m, self.n)


_transforms: dict[int, Transform] = {}


def _transform(n: int) -> Transform:
    if n not in _transforms:
        _transforms[n] = Transform(n)
    return _transforms[n]


def _take(values: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """``size`` values from each start; zeros after the end."""
    at = start[:, None] + np.arange(size)
    return np.where(at < len(values), values[np.minimum(at, len(values) - 1)], 0.0)


def occurrences(values: np.ndarray, squares: np.ndarray, start: np.ndarray, stop: np.ndarray, far: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``size`` stretches from ``far`` words on equal the block of ``size`` words at ``start``, inside ``stop``.

    ``values`` are residues and ``squares`` the running sums of their squares. Returns the row and the distance of each.
    """
    ntt = _transform(2 * size)
    rows, distances = [], []
    step = max(1, _STEP // (2 * size))
    for at in range(0, len(start), step):
        s, f, e = start[at:at + step], far[at:at + step], stop[at:at + step]
        block = np.zeros((len(s), 2 * size))
        block[:, :size] = _take(values, s, size)[:, ::-1]
        window = _take(values, s + f, 2 * size)
        product = ntt.inverse(_mod(ntt(block) * ntt(window)))[:, size - 1:2 * size - 1]
        d = f[:, None] + np.arange(size)
        to = np.minimum(s[:, None] + d, len(values) - size)
        own = squares[s + size] - squares[s]
        other = squares[to + size] - squares[to]
        total = own[:, None].astype(float) + other - 2.0 * product
        zero = total - PRIME * np.rint(total * (1.0 / PRIME)) == 0
        row, k = np.nonzero(zero & (d > 0) & (s[:, None] + d + size <= e[:, None]))
        rows.append(at + row)
        distances.append(d[row, k])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *distances])


def _seeds(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, place, distance)`` of all blocks' occurrences at all scales; ``first`` and ``count`` delimit the texts."""
    values = (mix(hashes) % np.uint64(PRIME)).astype(float)
    squares = np.concatenate([[0], np.cumsum((values * values).astype(np.int64) % PRIME)])
    found = []
    size = LEAST_BLOCK
    while LEAST_PERIODS * size <= longest or size == LEAST_BLOCK:
        texts = np.flatnonzero(count >= max(LEAST_RUN, LEAST_PERIODS * size))
        if len(texts) == 0:
            break
        block = min(size, MOST_BLOCK)
        low = 0 if size == LEAST_BLOCK else size
        for far in range(low, 2 * size, block):
            blocks = np.maximum(0, (count[texts] - far - block) // size + 1)
            text = np.repeat(texts, blocks)
            number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            start = first[text] + number * size
            row, d = occurrences(values, squares, start, first[text] + count[text], np.full(len(text), far), block)
            found.append((text[row], start[row] - first[text[row]], d))
        size *= 2
    return tuple(np.concatenate([np.empty(0, np.int64), *[f[i] for f in found]]) for i in range(3))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        unequal = np.flatnonzero(a[at:min(n, at + step)] != b[at:min(n, at + step)])
        if len(unequal):
            return at + int(unequal[0])
        at, step = at + step, 2 * step
    return n


def runs_of(words: np.ndarray, place: np.ndarray, distance: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of one text, by start, then period, from seeds of all scales."""
    order = np.lexsort((place, distance))
    place, distance = place[order], distance[order]
    found = []
    while len(place):
        x, d = int(place[0]), int(distance[0])
        right = x + _agree(words[x:], words[x + d:])
        left = x - _agree(words[:x][::-1], words[:x + d][::-1])
        start, end = left, right + d
        if right - left + d >= max(LEAST_RUN, LEAST_PERIODS * d):
            found.append((start, end - start, d))
            # what a multiple of the period repeats inside the run has the run's period itself
            inside = (distance % d == 0) & (place >= start) & (place + distance <= end)
        else:
            inside = (distance == d) & (place >= left) & (place < max(right, x + 1))
        place, distance = place[~inside], distance[~inside]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Truth for each word that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, kept: np.ndarray) -> bytes:
    """The kept words joined by one blank."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], kept.astype(np.int8), [0]])))
    pieces = (b" ".join(data[start[i]:end[j - 1]].tobytes().split()) for i, j in zip(edge[0::2], edge[1::2], strict=True))
    return b" ".join(pieces)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapse(edit: Callable[[pa.RecordBatch], pa.Array] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = edit(batch) if edit else batch.column("text")
        for at, part in slices(texts):
            words = find_words(part)
            n = len(part)
            first = np.searchsorted(words.doc, np.arange(n))
            count = np.searchsorted(words.doc, np.arange(n), "right") - first
            text, place, distance = _seeds(words.hash, first, count, int(count.max(initial=0)))
            order = np.argsort(text, kind="stable")
            text, place, distance = text[order], place[order], distance[order]
            to = np.searchsorted(text, np.arange(n + 1))
            runs, out = [], []
            for i in range(n):
                mine = slice(first[i], first[i] + count[i])
                own = runs_of(words.hash[mine], place[to[i]:to[i + 1]], distance[to[i]:to[i + 1]]) if to[i + 1] > to[i] else []
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                out.append(_joined(words.data, words.start[mine], words.end[mine], _kept(int(count[i]), own)).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(at, n), pa.array(count.astype(np.int64)), pa.array(runs, pa.list_(_RUN)), pa.array(out, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])


def _planted(batch: pa.RecordBatch) -> pa.Array:
    """Texts whose id's hash ends in 0 with their end replaced by a repeated stretch, by the rule of the registered query."""
    texts = batch.column("text").to_pylist()
    for i, h in enumerate(batch.column("h").to_pylist()):
        words = texts[i].encode().split() if h is not None and h % 10 == 0 and texts[i] else []
        if words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            texts[i] = b" ".join(words[:a] + [words[a + j % p] for j in range(n - a)]).decode()
    return pa.array(texts, pa.string())


def collapsed_runs(docs: DataFrame, edit: Callable[[pa.RecordBatch], pa.Array] | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``docs(doc_id, text)``.

    ``runs`` has the start, length and period of each run in words, by start, then period. ``collapsed`` is the text with one period of
    each run kept, its words joined by one blank. ``edit`` gives the texts to judge instead of those of a batch with
    ``id``, ``text`` and ``h``, the id's hash.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    return rows.mapInArrow(
        lambda batches: _collapse(edit, batches),
        f"doc_id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


# Compares fractions by cross products; runs come by start, then period, so the first of equals stays.
_BEST = """
aggregate(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (best, r) ->
  CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)"""


def run_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words)`` of texts with planted runs."""
    best = F.expr(_BEST)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return (
        collapsed_runs(docs, _planted)
        .select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(lines, 256).alias("runs_sha256"),
                F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
        .select("doc_id", "n_runs", "_b.start", "_b.length", "_b.period",
                F.expr("(1000 * _b.length) div _b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
    )


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """All runs of a list of words by trying every period; for checks of small texts."""
    n, found = len(words), []
    for q in range(1, n // LEAST_PERIODS + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(LEAST_RUN, LEAST_PERIODS * q):
                if not any(q % p == 0 and s <= i and i + length <= s + m for s, m, p in found):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exponent, the smallest start and then period of several."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
