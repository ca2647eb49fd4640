"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

A text is cut into strings: words, and runs of single characters, so that spelt-out words hold together. Two strings are alike by
the subsequences of three symbols that they share, within a stretch of ``SPAN`` + 1 symbols, each weighing less the more it is spread
(``DECAY`` per step). Symbols are lower-case letters, digits, the bytes of other letters, and a mark before the string; other signs and the
blanks of a spelt-out word are passed over. So gaps don't matter, and inserted characters lower a likeness, but don't end it.

Landmarks are strings from labelled texts. The kernel against them, whitened, is the input of a linear machine with squared hinge
loss. As a subsequence counts only by what landmarks make of it, the fitted machine folds into one table of weights by
subsequence, and a string's score is a sum of looked-up weights.

Labels stand on texts: the strings of texts with label 0 are examples of 0; strings that texts with label 1 hold far more often
are examples of 1. A second fit adds the strings of toxic texts that the first one points to, and the ordinary strings it is
wrong about; and copies of the strongest examples with a letter put in. A logistic curve over a text's highest score and the sum of its scores above 0, as a whole and per string, gives the probability.

Only labelled texts outside the held-out fold are learned from, about ``MOST_ROWS`` at most, by a hash of their id; ``lang``, ``source`` and
``doc_id`` are no inputs. All texts are scored whole, in Arrow batches, without a shuffle. Null and empty texts have no strings and get the
lowest score. Several labels of one document count as their mean, 1 from one half on; null labels are left out. Without labels of both
kinds, or without strings to learn from, every score is the share of 1 (0 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphtrails.llm.quality import held_out
from graphtrails.llm.words import BLANKS, arrow_bytes, bounded_batches, bounded_sample, mix, slices
from graphtrails.scratch import Scratch

#: Labelled texts that are learned from, at most; strings that come to the driver as examples, of each kind; landmarks.
MOST_ROWS, MOST_STRINGS, LANDMARKS = 20_000, 2_000, 256
THRESHOLD = 0.5
SPAN, DECAY = 6, 0.7
#: A longer string is judged by its best stretch of so many places; stretches overlap by half.
STRETCH = 24
_SYMBOLS = 64
_MARK = 1
#: Both offsets of a subsequence's later symbols from its first.
_OFFSETS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
_LOWEST = -4.0
#: Example strings whose subsequences are held as a matrix at once.
_PART = 256


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(range(65, 91))] = table[list(range(97, 123))] = np.arange(2, 28)
    table[list(range(48, 58))] = np.arange(28, 38)
    table[128:] = 38 + np.arange(128) % 26
    table[list(b" \t\n\x0b\x0c\r")] = _MARK
    return table


_SYMBOL = _symbol_table()


def _lengths_norm() -> np.ndarray:
    """The root of what a string of so many distinct symbols, mark included, has in common with itself."""
    norm = np.ones(STRETCH + 2)
    for n in range(3, STRETCH + 2):
        norm[n] = sum(max(0, n - b) * DECAY ** (2 * b) for _, b in _OFFSETS) ** 0.5
    return norm


_NORM = _lengths_norm()


@dataclass
class Strings:
    """Strings of some texts as symbols; each begins with its mark."""

    symbol: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def find_strings(texts: pa.Array) -> Strings:
    data, offsets = arrow_bytes(texts)
    n = len(texts)
    room = np.full(len(data) + n, 32, np.uint8)  # a blank before every text
    room[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets)) + 1] = data
    begins = offsets[:-1] + np.arange(n)
    inside = ~BLANKS[room]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(begins, start, "right") - 1
    # single characters one after the other, of several bytes or not, are one string
    lead = np.cumsum(np.concatenate([[0], (room & 0xC0) != 0x80]))
    single = lead[end] - lead[start] == 1
    joins = np.zeros(len(start), bool)
    joins[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    first = ~joins
    symbol = _SYMBOL[room]
    gaps = np.flatnonzero(joins)
    if len(gaps):  # blanks inside of a spelt-out word are none
        blank = np.zeros(len(room) + 1, np.int64)
        np.add.at(blank, end[gaps - 1], 1)
        np.add.at(blank, start[gaps], -1)
        symbol[np.cumsum(blank[:-1]) > 0] = 0
    last = np.concatenate([first[1:], [True]]) if len(first) else first
    at = np.concatenate([[0], np.cumsum(symbol > 0)])
    return Strings(symbol[symbol > 0], at[start[first] - 1], at[end[last]], doc[first])


def _stretches(s: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(string, start, end)``: strings as they are, long ones in overlapping stretches."""
    half = STRETCH // 2
    size = s.end - s.start
    pieces = np.where(size <= STRETCH, 1, -(-(size - STRETCH) // half) + 1)
    of = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = s.start[of] + number * half
    return of, start, np.minimum(start + STRETCH, s.end[of])


def _rest(s: Strings) -> np.ndarray:
    """For every place, how many places of its string follow it; none outside of strings."""
    rest = np.full(len(s.symbol), -1, np.int64)
    size = s.end - s.start
    of = np.repeat(np.arange(len(size)), size)
    within = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    rest[s.start[of] + within] = size[of] - 1 - within
    return rest


def _subsequences(s: Strings) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """``(place, subsequence, weight)`` of all that lie in one string, spread by spread."""
    rest = _rest(s)
    code = np.concatenate([s.symbol, np.zeros(SPAN, np.int32)])
    n = len(s.symbol)
    for b in range(2, SPAN + 1):
        place = np.flatnonzero((rest >= b) & (s.symbol > 0) & (code[b:n + b] > 0))
        outer = code[place] * (_SYMBOLS * _SYMBOLS) + code[place + b]
        for a in range(1, b):
            yield place, outer + code[place + a] * _SYMBOLS, DECAY ** b


def _norms(s: Strings, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    held = np.concatenate([[0], np.cumsum(s.symbol > 0)])
    return _NORM[np.minimum(held[end] - held[start], STRETCH + 1)]


def string_scores(s: Strings, weights: np.ndarray) -> np.ndarray:
    """The sum of weights of each string, over its norm; of its best stretch if it is long."""
    total = np.zeros(len(s.symbol))
    for place, sub, decay in _subsequences(s):
        total[place] += decay * weights[sub]
    run = np.concatenate([[0.0], np.cumsum(total)])
    of, start, end = _stretches(s)
    score = (run[end] - run[start]) / _norms(s, start, end)
    new = np.flatnonzero(np.diff(of, prepend=-1))
    return np.maximum.reduceat(score, new) if len(score) else np.empty(0)


def _profiles(strings: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights of subsequences by string, over its norm, as a matrix over the subsequences ``known``, or over all of theirs."""
    s = find_strings(pa.array(strings, pa.string()))
    of, start, end = _stretches(s)
    keep = np.unique(s.doc[of], return_index=True)[1]  # the first stretch stands for an example
    holder = np.full(len(s.symbol), -1, np.int64)
    for row, at in enumerate(keep):
        holder[start[at]:end[at]] = s.doc[of[at]]
    parts = [(holder[place], sub, np.full(len(sub), decay)) for place, sub, decay in _subsequences(s)]
    row, sub, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    known = np.unique(sub[row >= 0]) if known is None else known
    if len(known) == 0:
        return np.zeros((len(strings), 0)), known
    at = np.minimum(np.searchsorted(known, sub), len(known) - 1)
    fits = (row >= 0) & (known[at] == sub)
    out = np.zeros((len(strings), len(known)), np.float32)
    np.add.at(out, (row[fits], at[fits]), value[fits])
    norm = np.ones(len(strings))
    norm[s.doc[of[keep]]] = _norms(s, start[keep], end[keep])
    return out / norm[:, None].astype(np.float32), known


@dataclass
class Machine:
    """A folded machine: weights by subsequence, and the curve from what texts' strings score to a probability."""

    weights: np.ndarray
    bias: float
    curve: np.ndarray | None = None
    constant: float | None = None

    def probability(self, seen: np.ndarray) -> np.ndarray:
        """Of texts by ``text_features``."""
        if self.constant is not None:
            return np.full(len(seen), self.constant)
        curve = np.array([4.0, 0.0, 0.0, 0.0]) if self.curve is None else self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(seen @ curve[:-1] + curve[-1], -30, 30)))


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Newton steps on the primal; the last number is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(ridge), (xa * wa[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def fit(toxic: dict[str, int], plain: dict[str, int], landmarks: int = LANDMARKS, penalty: float = 0.3) -> Machine:
    """Fit on example strings and the number of texts each stands for, the strongest first.

    Landmarks are the first of both kinds, twice as many toxic ones.
    """
    most = min(len(toxic), 2 * landmarks // 3)
    marks = list(toxic)[:most] + list(plain)[:landmarks - most]
    profile, known = _profiles(marks)
    values, vectors = np.linalg.eigh((profile @ profile.T).astype(float))
    use = values > 1e-4 * max(values.max(), 1e-9)
    white = vectors[:, use] / np.sqrt(values[use])
    basis = profile.T.astype(float) @ white
    every = [*toxic, *plain]
    x = np.concatenate([_profiles(every[at:at + _PART], known)[0] @ basis for at in range(0, len(every), _PART)])
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(plain))])
    weight = np.sqrt(np.maximum([*toxic.values(), *plain.values()], 1))
    for kind in (1, -1):  # both kinds weigh the same
        weight[y == kind] *= len(y) / 2 / weight[y == kind].sum()
    w = _squared_hinge(x, y, weight, penalty)
    weights = np.zeros(_SYMBOLS ** 3)
    weights[known] = basis @ w[:-1]
    return Machine(weights, float(w[-1]))


def _curve(seen: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve that falls with no feature; the last number is the shift. Newton steps."""
    x = np.column_stack([seen, np.ones(len(seen))])
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w))
            step = np.where(use, np.linalg.solve(np.where(np.outer(use, use), h, np.eye(len(w))), np.where(use, x.T @ (y - p) - 1e-2 * w, 0)), 0)
            w = w + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        falling = (w < 0) & (np.arange(len(w)) < len(w) - 1)
        if not falling.any():
            return w
        use &= ~falling


def text_features(s: Strings, machine: Machine, n: int) -> np.ndarray:
    """Of each of ``n`` texts: its highest score, and the logarithms of the sum of its strings' scores above 0 and of that sum per string."""
    seen = np.zeros((n, 3))
    seen[:, 0] = _LOWEST
    if len(s.start):
        score = string_scores(s, machine.weights) + machine.bias
        np.maximum.at(seen[:, 0], s.doc, score)
        held = np.bincount(s.doc, minlength=n)
        above = np.bincount(s.doc, weights=np.maximum(score, 0), minlength=n)
        seen[:, 1], seen[:, 2] = np.log1p(above), np.log1p(100 * above / np.maximum(held, 1))
    return seen


def _judged(machine: Machine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in slices(batch.column("text")):
            seen = text_features(find_strings(part), machine, len(part))
            others = [batch.column(c).slice(at, len(part)) for c in batch.schema.names if c != "text"]
            yield pa.record_batch(
                [*others, pa.array(seen[:, 0]), pa.array(machine.probability(seen))],
                names=[c for c in batch.schema.names if c != "text"] + ["highest", "probability"])


def _features(machine: Machine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in slices(batch.column("text")):
            seen = text_features(find_strings(part), machine, len(part))
            yield pa.record_batch([batch.column("y").slice(at, len(part)), *map(pa.array, seen.T)], names=["y", "a", "b", "c"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different strings of every text, of up to ``STRETCH`` places, lower-cased and without signs."""
    for batch in batches:
        for at, part in slices(batch.column("text")):
            texts = []
            for text in part.to_pylist():
                words = "".join(c if c.isalnum() or c.isspace() else "" for c in (text or "").lower()).split()
                texts.append(sorted({w for w in words if 2 < len(w) <= STRETCH}))
            yield pa.record_batch([batch.column("y").slice(at, len(part)), pa.array(texts, pa.list_(pa.string()))], names=["y", "strings"])


def training_marks(labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``(doc_id, y)`` of about ``most`` labelled documents at most outside the held-out fold, by a hash of their id."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    return bounded_sample(marks, "doc_id", most=most)


def _scored(rows: DataFrame, machine: Machine) -> DataFrame:
    """``rows(..., text)`` with ``highest`` and ``probability`` in place of ``text``."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lambda batches: _judged(machine, batches), f"{columns}, highest double, probability double")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, strings: int = MOST_STRINGS, landmarks: int = LANDMARKS) -> Machine:
    """Fit on labelled ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    scratch = Scratch.of(spark)
    bounded_batches(spark)
    marks, seen = scratch.save(training_marks(labels, most), "marks", n=F.count(F.lit(1)), ones=F.coalesce(F.sum("y"), F.lit(0)))
    constant = Machine(np.zeros(_SYMBOLS ** 3), 0.0, constant=seen["ones"] / max(seen["n"], 1))
    if not 0 < seen["ones"] < seen["n"]:
        return constant
    known = scratch.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id").select("y", "text"), "labelled")
    counts, total = scratch.save(
        known.mapInArrow(_distinct, "y int, strings array<string>").select("y", F.explode("strings").alias("text"))
        .groupBy("text").agg(F.sum("y").alias("ones"), F.count_if(F.col("y") == 0).alias("zeros")), "strings", n=F.count(F.lit(1)))
    ones, zeros = seen["ones"] + 1, seen["n"] - seen["ones"] + 1
    odds = F.log((F.col("ones") + 0.5) / ones / ((F.col("zeros") + 0.5) / zeros))
    # how unlikely so many toxic texts are by chance, against the number of strings that have a chance
    share = seen["ones"] / seen["n"]
    chance = F.col("ones") * -np.log(share) + F.col("zeros") * (3 * -np.log(1 - share) - 6)
    tail = F.xxhash64("text")
    strongest = (F.col("ones") * odds).desc()
    told = counts.filter((odds > 1.5) & (chance > np.log(max(total["n"], 2))))
    toxic = _examples(told, "ones", strings, strongest, tail) or _examples(counts.filter(odds > 0), "ones", 20, strongest, tail)
    ordinary = counts.filter("zeros > 0").filter(odds < 1.0)
    plain = _examples(ordinary, "zeros", strings // 4, F.col("zeros").desc(), tail) | _examples(ordinary, "zeros", strings, tail)
    if not toxic or not plain:
        return constant
    machine = fit(toxic, plain, landmarks)
    lengthened = _lengthened(toxic, landmarks // 4)
    for _ in range(2):
        judged = scratch.save(_scored(counts.withColumn("_text", F.col("text")), machine).withColumnRenamed("_text", "text"), "judged")
        more = _examples(judged.filter("highest > 0 AND zeros = 0"), "ones", strings, F.col("ones").desc(), tail)
        hard = _examples(judged.filter("highest > -0.7 AND zeros > 0").filter(odds < 1.0), "zeros", 2 * strings, F.col("highest").desc(), tail)
        toxic = {t: n for t, n in (toxic | lengthened | more).items() if t not in hard} or toxic
        plain = dict(list(hard.items())[:landmarks // 3]) | plain | hard
        machine = fit(toxic, plain, landmarks)
    texts = known.select("y", "text").mapInArrow(lambda batches: _features(machine, batches), "y int, a double, b double, c double").toPandas()
    machine.curve = _curve(texts[["a", "b", "c"]].to_numpy(), texts["y"].to_numpy().astype(float))
    return machine


def _lengthened(toxic: dict[str, int], most: int) -> dict[str, int]:
    """The strongest strings with one letter put in before the middle or after it."""
    letters = "etaoinshrdlu"
    return {
        t[:at] + letters[(i + at) % len(letters)] + t[at:]: n
        for i, (t, n) in enumerate(list(toxic.items())[:most]) for at in (len(t) // 2, len(t) // 2 + 1) if len(t) > 4}


def _examples(rows: DataFrame, texts: str, most: int, *order) -> dict[str, int]:
    """Up to ``most`` strings and the number of texts that hold them."""
    return {r.text: r.n for r in rows.orderBy(*order).limit(most).select("text", F.col(texts).alias("n")).collect()}


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    machine = train(docs, labels, most)
    rows = _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), machine)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("probability").alias("score"),
                       (F.col("probability") >= THRESHOLD).cast("int").alias("predicted"))
