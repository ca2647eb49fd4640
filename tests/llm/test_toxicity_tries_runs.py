import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphtrails.llm import periodic, toxicity, tries
from graphtrails.llm.words import find_words


def _random_words(rng, most):
    words = []
    while len(words) < most:
        unit = [rng.randrange(rng.choice([2, 60])) for _ in range(rng.randrange(1, 30))]
        words += [rng.randrange(500) for _ in range(rng.randrange(20))] + unit * rng.randrange(1, 6) + unit[:rng.randrange(len(unit))]
    return words[:most]


@pytest.mark.parametrize("n", [16, 128, 256, 1024, 8192])
def test_transform_is_exact(n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, periodic.PRIME, (2, 2, n)).astype(float)
    ntt = periodic.Transform(n)
    assert np.array_equal(np.mod(ntt.inverse(ntt(x)), periodic.PRIME), x)
    product = np.mod(ntt.inverse(periodic._mod(ntt(x) * ntt(y))), periodic.PRIME)
    for k in (0, 1, n - 1):
        assert int(product[1, k]) == sum(int(x[1, i]) * int(y[1, (k - i) % n]) for i in range(n)) % periodic.PRIME


@pytest.mark.parametrize("block", [16, 4096])
def test_runs_equal_every_period(monkeypatch, block):
    monkeypatch.setattr(periodic, "MOST_BLOCK", block)
    rng = random.Random(block)
    for _ in range(150):
        words = _random_words(rng, rng.randrange(1, 700))
        hashes = find_words(pa.array([" ".join(map(str, words))])).hash
        _, place, distance = periodic._seeds(hashes, np.array([0]), np.array([len(words)]), len(words))
        assert periodic.runs_of(hashes, place, distance) == periodic.plain_runs(words)


def _plain_report(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = periodic.plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = periodic.best_run(runs) or (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), n)


def test_run_report(spark, docs, texts, none):
    rng = random.Random(1)
    more = [(1000 + i, " ".join(map(str, _random_words(rng, rng.randrange(1, 400))))) for i in range(60)]
    more += [(2000, "é " * 40), (2001, ("a\tb\x0bc \n" * 9) + " x"), (2002, "z " * 23), (2003, "z " * 24)]
    got = periodic.run_report(spark.createDataFrame(more, "doc_id long, text string").repartition(3).unionByName(docs.select("doc_id", "text"))).collect()
    small = [(i, t) for i, t in texts if t is None or len(t) < 20_000]
    want = [_plain_report(i, t) for i, t in more + small]
    ids = {i for i, _ in more + small}
    assert sorted([tuple(r) for r in got if r.doc_id in ids], key=str) == sorted(want, key=str)
    assert any(r.n_runs > 1 for r in got) and sum(r.doc_id is None for r in got) == 1
    assert periodic.run_report(none).count() == 0


def _plain_trie(rows, rebuild):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in by.items()}
    built = own
    if rebuild:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    name = {s: (min(m), len(s)) for s, m in members.items()}
    out = []
    for s, m in members.items():
        below = [x for x in members if x[:len(s)] == s]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(s))
        out.append((*name[s], name[s[:-1]][0] if s else None, len(m), sum(len(x) == len(s) + 1 for x in below), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for c in [*range(60), 100, 119, 1000, 1019]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello there you", "a b  c\td"])) for t in range(rng.randrange(1, 7))]
    rows += [(200 + i, 0, "user", "the same start") for i in range(40)] + [(200 + i, 1, "user", f"own {i}") for i in range(0, 40, 3)]
    rows += [(300, None, None, None), (300, None, "user", ""), (300, 1, "user", "x y"), (300, 1, "user", "x y"), (300, 1, "user", "a"), (None, 0, "user", "lost")]
    rows += [(320, t, "user", "word " * (t % 3)) for t in range(30)] + [(321, t, "user", "word " * (t % 3)) for t in range(30)]
    return rows


@pytest.mark.parametrize("rebuild, block, ids", [(True, 4096, 20_000), (False, 7, 3)])
def test_trie(spark, monkeypatch, talks, rebuild, block, ids):
    monkeypatch.setattr(tries, "BLOCK", block)
    monkeypatch.setattr(tries, "PIECE_IDS", ids)
    rows = spark.createDataFrame([(*r, 1, 2) for r in talks], "conv_id long, turn long, role string, text string, c int, v int").repartition(3)
    got = (tries.rebuilt_trie if rebuild else tries.conversation_trie)(rows)
    assert sorted([tuple(r) for r in got.collect()], key=str) == _plain_trie(talks, rebuild)


def test_empty_trie(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tries.rebuilt_trie(none).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert tries.rebuilt_trie(lost).count() == 0


def _plain_score(text, weights):
    """The best string's score by trying all triples of its symbols; for strings of up to STRETCH symbols."""
    symbols = [1] + [int(toxicity._SYMBOL[b]) for b in text.encode() if toxicity._SYMBOL[b] > 1]
    total = sum(
        toxicity.DECAY ** (k - i) * weights[(symbols[i] * 64 + symbols[j]) * 64 + symbols[k]]
        for i in range(len(symbols)) for j in range(i + 1, len(symbols)) for k in range(j + 1, min(len(symbols), i + toxicity.SPAN + 1)))
    return total / toxicity._NORM[len(symbols)]


def test_string_scores_sum_all_subsequences():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=64 ** 3)
    words = ["idiot", "a", "être", "b.c-d", "loooooooooooooooooong", "x1y2"]
    s = toxicity.find_strings(pa.array(["  ".join(words[:3]), None, "", " ".join(words[3:])]))
    want = [_plain_score(w, weights) for w in words]
    assert np.allclose(toxicity.string_scores(s, weights), want) and s.doc.tolist() == [0, 0, 0, 3, 3, 3]
    spelt = toxicity.find_strings(pa.array(["so i d i o t end", "idiot", "i.d i.o t", "x" * 100]))
    scores = toxicity.string_scores(spelt, weights)
    assert len(scores) == 8 and np.isclose(scores[1], scores[3])


def test_whitened_kernel_is_the_kernel():
    """On the landmarks the folded table gives the machine's own values."""
    toxic, plain = {"idiot": 3, "stupid": 2, "worthless": 1}, {"word": 4, "other": 2, "garden": 1}
    machine = toxicity.fit(toxic, plain, landmarks=6, penalty=1e-6)
    s = toxicity.find_strings(pa.array([*toxic, *plain, "id1iot", "i-d-i-o-t"]))
    score = toxicity.string_scores(s, machine.weights) + machine.bias
    assert np.allclose(score[:6], [1, 1, 1, -1, -1, -1], atol=0.05)
    assert score[6] > 0 and np.isclose(score[7], score[0])


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(9)
    ordinary = ["".join(rng.choice("abdegklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(ordinary) for _ in range(rng.randrange(5, 60))]
        y = int(i % 6 == 0)
        if y:
            words[rng.randrange(len(words))] = rng.choice(["quizfluff", "quizfluffen", "vexwrathy"])
        rows.append((i, " ".join(words)))
        marks.append((i, y))
    extra = [(5000, "you q.u.i.z.f.l.u.f.f you"), (5001, "you v e x w r a t h y"), (5002, "you quizxfluff"), (5003, None), (5004, ""), (None, "quizfluff"), (5000, "plain")]
    docs = spark.createDataFrame([(*r, 1.0, 0) for r in rows + extra], "doc_id long, text string, score double, y int").repartition(4)
    labels = spark.createDataFrame([*marks, (None, 1), (5002, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    truth = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert max(r.score for r in by[5000]) >= 0.5 and by[5001][0].predicted == 1 and by[5002][0].predicted == 1
    assert by[5003][0].score == by[5004][0].score == min(r.score for r in got)


def test_toxicity_without_labels_of_both_kinds(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, ones).collect()} == {1.0}
    assert toxicity.toxicity_scores(docs.limit(0), ones).count() == 0
