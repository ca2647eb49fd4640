"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become numeric features in Arrow batches, once for all documents. Labelled rows outside the held-out
fifth, ``MOST_ROWS`` of them at most (by a hash of the id), are brought to the driver as
features only. There shallow trees are boosted in turn over the features: each round fits a tree of up to
four leaves on one feature's bins, and adds it to that feature's lookup table; then trees with one cut on
either feature do the same for the best pairs. A score is the sum of the looked-up values of a row's bins.

``labels``, ``lang``, ``source`` and ``doc_id`` are no inputs of a score. Null and empty texts have features
too (zeros) and get a score. Several labels of one document count as their mean, 1 from one half on; null
labels are left out. Without labels of both kinds every score is the share of 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphtrails.llm.words import BLANKS, arrow_bytes, bounded_batches, bounded_sample, find_words, slices
from graphtrails.scratch import Scratch

#: Labelled rows that the model is fitted on, at most.
MOST_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

FEATURES = [
    "log_bytes", "log_words", "letters", "upper", "digits", "other_ascii", "wide", "blanks", "word_length", "long_words",
    "distinct_words", "top_word", "repeated_pairs", "repeated_fives", "symbol_words", "upper_words", "lines_per_word",
    "distinct_lines", "line_length", "ended_lines", "bars", "stops",
]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WIDE = np.arange(256) >= 128
_LINE = np.ones(256, bool)
_LINE[10] = False


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: values, distinct values, and how often the commonest occurs."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, doc[starts], np.diff(np.append(starts, len(doc))))
    return np.bincount(doc, minlength=n), np.bincount(doc[starts], minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n = len(texts)
    w = find_words(texts)
    data = w.data
    sizes = np.diff(arrow_bytes(texts)[1])
    of = np.repeat(np.arange(n), sizes)
    total = lambda mask: np.bincount(of[mask], minlength=n).astype(float)
    letters, upper, digits, wide, blank = (total(t[data]) for t in (_LETTER, _UPPER, _DIGIT, _WIDE, BLANKS))
    bars, stops = total(data == 124), total((data == 46) | (data == 33) | (data == 63))
    words = np.bincount(w.doc, minlength=n).astype(float)
    length = w.end - w.start
    last = data[w.end - 1] if len(w.end) else np.empty(0, np.uint8)
    symbol = ~(_LETTER | _DIGIT | _WIDE)[last] & ~np.isin(last, np.frombuffer(b".,;:!?)'\"", np.uint8))
    first = data[w.start] if len(w.start) else np.empty(0, np.uint8)
    second = data[np.minimum(w.start + 1, max(len(data) - 1, 0))] if len(w.start) else first
    _, distinct, top = _repeats(w.doc, w.hash, n)
    pairs, fives = w.windows(2), w.windows(5)
    n2, d2, _ = _repeats(w.doc[pairs[0]], pairs[1], n)
    n5, d5, _ = _repeats(w.doc[fives[0]], fives[1], n)
    lines = find_words(texts, ~_LINE)
    n_lines, d_lines, _ = _repeats(lines.doc, lines.hash, n)
    ends = data[lines.end - 1] if len(lines.end) else np.empty(0, np.uint8)
    ended = np.bincount(lines.doc[np.isin(ends, np.frombuffer(b".!?:\"", np.uint8))], minlength=n)
    by_word = lambda mask: _share(np.bincount(w.doc[mask], minlength=n), words)
    return np.column_stack([
        np.log1p(sizes), np.log1p(words), _share(letters, sizes), _share(upper, letters), _share(digits, sizes),
        _share(sizes - letters - digits - wide - blank, sizes), _share(wide, sizes), _share(blank, sizes),
        _share(np.bincount(w.doc, length, minlength=n), words), by_word(length > 15),
        _share(distinct, words), _share(top, words), 1 - _share(d2, n2) * (n2 > 0) - (n2 == 0), 1 - _share(d5, n5) * (n5 > 0) - (n5 == 0),
        by_word(symbol), by_word(_UPPER[first] & _UPPER[second] & (length > 1)), _share(n_lines, words),
        _share(d_lines, n_lines), _share(sizes, n_lines), _share(ended, n_lines), _share(bars, words), _share(stops, words),
    ]).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [features(texts) for _, texts in slices(batch.column("_text"))]
        x = np.concatenate(parts) if parts else np.empty((0, len(FEATURES)), np.float32)
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
        others = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in others] + [pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=others + ["x"])


def _columns(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)


def measured(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry`` and ``x``, the features of each text."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(_measure, f"{_columns(rows, '_text')}, x array<float>")


@dataclass
class AdditiveModel:
    """Bin edges and a lookup table per feature, and tables of coarser bins for pairs of features."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                out += table[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]).astype(x.dtype))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, leaves: int = 4) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins: the best cuts, one after the other."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for at, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            gl, hl, nl = (np.cumsum(a[lo:hi])[:-1] for a in (g, h, n))
            gs, hs, ns = g[lo:hi].sum(), h[lo:hi].sum(), n[lo:hi].sum()
            gain = _gain(gl, hl) + _gain(gs - gl, hs - hl) - _gain(gs, hs)
            gain[(nl < least) | (ns - nl < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], at, lo + k + 1)
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on either feature of a pair: its gain and leaf values."""
    cg, ch = (np.cumsum(np.cumsum(a, 0), 1) for a in (g, h))
    best, value = 0.0, np.zeros_like(g)
    a, b = np.meshgrid(np.arange(g.shape[0] - 1), np.arange(g.shape[1] - 1), indexing="ij")
    if not a.size:
        return best, value
    quarter = lambda c: (c[a, b], c[a, -1] - c[a, b], c[-1, b] - c[a, b], c[-1, -1] - c[a, -1] - c[-1, b] + c[a, b])
    gain = sum(_gain(x, y) for x, y in zip(quarter(cg), quarter(ch))) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    best = float(gain[i, j])
    for rows, cols in ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)),
                       (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        value[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return best, value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, n_pairs: int = 10,
        pair_rounds: int = 40, pair_bins: int = 12) -> AdditiveModel:
    """Cyclic boosting on log loss; row order doesn't matter beyond rounding."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = AdditiveModel(bias=float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    least = max(2, min(20, len(y) // 50))
    model.edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    raw = np.full(len(y), model.bias)

    def slopes(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size), np.bincount(index, minlength=size)

    for _ in range(rounds):
        for index, table in zip(binned, model.tables):
            step = rate * _tree(*slopes(index, len(table)), least)
            table += step
            raw += step[index]
    model.pair_edges = [_edges(x[:, j], pair_bins) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    width = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = coarse[i] * width[j] + coarse[j]
        g, h, _ = slopes(index, width[i] * width[j])
        return g.reshape(width[i], width[j]), h.reshape(width[i], width[j]), index

    found = [(_quarters(*grid(i, j)[:2])[0], i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])]
    model.pairs = [(i, j) for _, i, j in sorted(found, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h, index = grid(i, j)
            step = rate * _quarters(g, h)[1]
            table += step
            raw += step.ravel()[index]
    return model


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def training_marks(labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``(doc_id, y)`` of about ``most`` labelled documents at most outside the held-out fold, by a hash of their id."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    return bounded_sample(marks, "doc_id", most=most)


def train(rows: DataFrame, marks: DataFrame, most: int = MOST_ROWS) -> AdditiveModel:
    """Fit on ``rows(doc_id, x)`` that have a mark, ``most`` at most."""
    got = rows.select("doc_id", "x").join(F.broadcast(marks), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.stack(got["x"].to_numpy()).astype(np.float32) if len(got) else np.empty((0, len(FEATURES)), np.float32)
    return fit(x, got["y"].to_numpy().astype(float))


def _scorer(model: AdditiveModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            s = model.score(flat.reshape(-1, len(FEATURES))) if len(flat) else np.empty(0)
            others = [c for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(s.astype(float))], names=others + ["score"])
    return score


def scored(rows: DataFrame, model: AdditiveModel) -> DataFrame:
    """``rows`` with ``score`` in place of ``x``."""
    return rows.mapInArrow(_scorer(model), f"{_columns(rows, 'x')}, score double")


def judged(docs: DataFrame, model: AdditiveModel, *carry: str) -> DataFrame:
    """The columns ``carry`` and ``score`` of each text, measured and scored by one worker a task: a second one would stay
    beside it, and hold what later steps remember, too."""
    bounded_batches(docs.sparkSession)
    rows, score = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_text")), _scorer(model)
    return rows.mapInArrow(lambda batches: score(_measure(batches)), f"{_columns(rows, '_text')}, score double")


def good_documents(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    marks = Scratch.of(docs.sparkSession).save(training_marks(labels, most), "marks")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi")
    model = train(measured(known, "doc_id"), marks, most)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return judged(rows, model, "row").filter(F.col("score") >= THRESHOLD).select("row.*")


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = Scratch.of(docs.sparkSession).save(measured(docs.select(doc_id, "text"), "doc_id"), "features")
    model = train(rows, training_marks(labels, most), most)
    return scored(rows, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
