"""Operators on documents against plain Python, over texts with nulls, ties, repeats and clashing columns."""

import glob
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from graphtrails.llm import decontam, exchange, fingerprints, jaccard, lines, packing, quality, queries, substrings, tokens, words

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- op2 -----------------------------------------------------------------------------------------


def plain_contamination(texts, items, size=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    windows = defaultdict(set)
    for item_id, text in items:
        w = find(text)
        n = min(len(w), size)
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s:s + n])].add(item_id)
    out = Counter()
    for doc_id, text in texts:
        w, hit, ids = find(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    ids |= windows[tuple(w[s:s + n])]
                    hit |= set(range(s, s + n))
        out[(doc_id, len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


def test_contamination(docs, texts, items):
    want = plain_contamination(texts, [tuple(r) for r in items.collect()])
    got = rows_of(decontam.contamination_report(docs, items))
    assert got == want
    assert any(r[5] for r in got) and sum(r[2] > 0 for r in got) >= 3


def test_contamination_in_both_ansi_modes(spark, docs, items):
    before = spark.conf.get("spark.sql.ansi.enabled")
    got = []
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            got.append(sorted(map(str, decontam.contamination_report(docs, items).collect())))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got[0] == got[1] and not any("n_words=-1" in r for r in got[0])


def test_contamination_without_rows(docs, none, items):
    assert decontam.contamination_report(none, items).count() == 0
    assert not any(r["n_hit"] for r in decontam.contamination_report(docs, items.limit(0)).collect())


def test_clean_documents_keep_columns_and_rows(docs, items):
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in decontam.contamination_report(docs, items).collect() if r["contaminated"]}
    assert bad and rows_of(kept) == Counter({r: n for r, n in rows_of(docs).items() if r[0] not in bad})


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "red x x green x blue"), (2, "blue " + "x " * 50 + "red green"), (3, "green red")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Red green blue")], "item_id long, text string")
    index = decontam.Index(docs, items)
    assert {r["_k"] for r in index.near_matches(6).collect()} == {1}
    assert {r["_k"] for r in index.near_matches(60).collect()} == {1, 2}


# --- op3 -----------------------------------------------------------------------------------------


def plain_lines(texts, least=10):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            seen[key(line)].add((i, t))
    gone = {k for k, d in seen.items() if k and len(d) >= least}
    out = Counter()
    for i, t in texts:
        every = (t or "").split("\n")
        kept = [x for x in every if key(x) not in gone]
        out[(i, len(every), len(every) - len(kept), sha("\n".join(kept)))] += 1
    return out


@pytest.mark.parametrize("least", [2, 10, 12, 13])
def test_lines(docs, texts, least):
    assert rows_of(lines.line_digests(docs, least)) == plain_lines(texts, least)


def test_lines_of_one_hash_over_many_partitions(spark):
    texts = [(i, "common\n" + "\n".join(f"l{i % 40}" for _ in range(3)) + f"\nown {i}") for i in range(500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert rows_of(lines.line_digests(docs)) == plain_lines(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lines_without_rows(none):
    assert lines.line_digests(none).count() == 0


# --- op4 -----------------------------------------------------------------------------------------


def plain_repeats(texts, size=35):
    split = [BLANKS.findall(t or "") for _, t in texts]
    seen = Counter(tuple(w[s:s + size]) for w in split for s in range(len(w) - size + 1))
    out = Counter()
    for (i, _), w in zip(texts, split):
        gone = {p for s in range(len(w) - size + 1) if seen[tuple(w[s:s + size])] > 1 for p in range(s, s + size)}
        out[(i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))] += 1
    return out


@pytest.mark.parametrize("size", [35, 8])
def test_substrings(docs, texts, size):
    got = rows_of(substrings.substring_digests(docs, size))
    assert got == plain_repeats(texts, size)
    assert sum(r[2] for r in got) > 0


def test_substrings_without_rows(none):
    assert substrings.substring_digests(none).count() == 0


def test_batches_of_doubled_rows_differ():
    rng = np.random.default_rng(3)
    ids = set()
    for number in range(50):
        keys, tags = rng.integers(-1 << 60, 1 << 60, 100), rng.integers(-1 << 31, 1 << 31, 100).astype(np.int32)
        ids.add(exchange.batch_id(np.tile(keys, 2), np.tile(tags, 2), 0, 0))  # not told apart by place
    assert len(ids) == 50
    same = np.full(100, -5), np.zeros(100, np.int32)
    assert len({exchange.batch_id(*same, part, number) for part in range(20) for number in range(20)}) == 400


def test_places_survive_packing():
    row = np.array([0, 0, 2, 2, 2, 5])
    pos = np.array([3, 900, 0, 254, 70_000, 255])
    keys, tags = np.arange(6) * 10, np.arange(6, dtype=np.int32)
    p = exchange._pack_places(row, pos, keys, tags)
    r, q = exchange._places(p["docs"], p["counts"], p["gaps"], p["far"])
    assert np.frombuffer(p["docs"], "<i8")[r].tolist() == keys[row].tolist() and q.tolist() == pos.tolist()


def test_words_of_many_texts():
    texts = ["a bb", None, "", "c", " \x0b", "dé f\x1cg", "x" * 5000 + " y"]
    w = words.find_words(pa.array(texts))
    raw = w.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in BLANKS.findall(t or "")]
    again = words.find_words(pa.array(["bb", "y"]))
    assert again.hash[0] == w.hash[1] and again.hash[1] == w.hash[-1]


# --- op5 -----------------------------------------------------------------------------------------


def test_fingerprints(docs, texts):
    got = {}
    for r in fingerprints.fingerprint_report(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(texts)
    ids = [i for i, _ in texts]
    for (i, t) in texts:
        later = [j for j in ids if i is None or j is not None and j > i]
        after = min((j for j in later if j is not None), default=None)
        if ids.count(i) > 1 or ids.count(after) > 1:
            continue
        t, n = t or "", next(u for j, u in texts if j == after) or ""
        e = fingerprints.edited(t, n)
        assert e == t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        marks = [fingerprints.fingerprint(x.encode()) for x in (t, e, n)]
        assert tuple(got[i][0]) == (i, len(t), sha(e), marks[0], marks[1], fingerprints.likeness(marks[0], marks[1]), fingerprints.likeness(marks[0], marks[2]))


def test_likeness():
    mark = lambda t: fingerprints.fingerprint(t.encode())
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefghij "), 20_000))
    other = "".join(rng.choice(list("abcdefghij "), 20_000))
    assert fingerprints.likeness(mark(text), mark(text)) == 1 and fingerprints.likeness(mark(text), mark(other)) < 0.2
    assert fingerprints.likeness(mark(text), mark("new start " + text)) > 0.9
    assert fingerprints.likeness(mark(text), mark(text[:10_000] + other[:10_000])) > 0.4
    assert fingerprints.likeness(mark(""), mark("")) == 1 and fingerprints.likeness(mark(""), mark(text)) == 0
    old = fingerprints._SPAN
    try:
        want = mark(text)
        fingerprints._SPAN = 1000
        assert mark(text) == want
    finally:
        fingerprints._SPAN = old


def test_fingerprints_of_few(spark, none):
    assert fingerprints.fingerprint_report(none).count() == 0
    one = spark.createDataFrame([(3, "abcd")], "doc_id long, text string")
    assert [r["edited_sha256"] for r in fingerprints.fingerprint_report(one).collect()] == [sha("abab")]


# --- op8, op10 -----------------------------------------------------------------------------------

ODD = [
    "a\n b", "  two  spaces ", "tab\tin it", "a\r\nb", "İ... İ!", "don't... 'tis", "x\x85y \xa0z", "<|endoftext|> here", "é... ́!",
    "\x01 \x02 a", "0 zero 10 ! 0!", "line\nline\n\nline", "漢字... 漢字!", "½! ²... 1. 22,", "", " ", "\n",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(texts, name):
    encoder = tokens.Encoder(tokens.tokenizer_path(name))
    every = ODD + [t or "" for _, t in texts]
    for _ in range(2):
        assert encoder.encode(every) == [encoder.whole(t) for t in every]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("memory", [60, 400])
def test_encoder_forgets_words(texts, name, memory, monkeypatch):
    """A full memory keeps words met again, and the runs start anew; ids stay those of the library."""
    monkeypatch.setattr(tokens, "MEMORY", memory)
    monkeypatch.setattr(tokens, "PIECES", memory // 2)
    encoder = tokens.Encoder(tokens.tokenizer_path(name))
    rng = random.Random(memory)
    signs = "abcXYZ 0123 '\n\t.,;-_!?éßÉÇığİĞŁłœ²½ªº\xa0\xad漢αΣ😀\x1c\x85\rȺ"
    every = ODD + [t or "" for _, t in texts] + ["".join(rng.choices(signs, k=rng.randint(0, 50))) for _ in range(600)]
    for at in range(0, len(every), 20):
        some = every[at:at + 20]
        assert encoder.encode(some) == [encoder.whole(t) for t in some]


def test_places_of_keys():
    """Keys that share a slot have places of their own; a table that grows keeps its numbers."""
    places = tokens._Places()
    keys = np.concatenate([np.arange(1, 3000, dtype=np.uint64) << np.uint64(40), np.arange(100_000, dtype=np.uint64) * np.uint64(7) + np.uint64(1)])
    for part in np.array_split(keys, 7):
        assert (places.find(part) == -1).all()
        places.add(part)
    assert places.find(keys).tolist() == list(range(len(keys)))


ADDED = [
    "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y<|endoftext|>", " <|startoftext|> A\n<|endoftext|>\n", "<|ENDOFTEXT|> <| endoftext|>",
    "plain words", "<|endoftext|><|endoftext|> end", "it's <|endoftext", None, "漢字<|endoftext|>漢字",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_a_fresh_tokenizer(spark, texts, name):
    fresh = Tokenizer.from_file(tokens.tokenizer_path(name))
    plain = lambda t: fresh.encode(t or "", add_special_tokens=False).ids
    every = ADDED + ODD + [t for _, t in texts]
    encoder = tokens.Encoder(tokens.tokenizer_path(name))
    for some in (every, ["<|endoftext|> first", "then words"], every[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_array(pa.array(some, pa.string()))] == [plain(t) for t in some]
    assert encoder.encode(["a <|endoftext|> b"]) == [np.array(plain("a <|endoftext|> b"), "<u4").tobytes()]
    df = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want, start = [], 0
    for i, t in enumerate(ADDED):
        ids = plain(t) + [0]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in tokens.token_digests(df, name).collect()) == want
    got = defaultdict(list)
    for r in sorted(packing.pack(df, name).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] += r["ids"]
    assert dict(got) == {i: plain(t) + [1] for i, t in enumerate(ADDED)}


def test_token_files(spark, docs, texts):
    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    got = tokens.token_digests(docs).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.append(0, np.cumsum([r["n_tokens"] for r in got]))[:-1].tolist()
    want = Counter((i, len(e) // 4, zlib.crc32(e)) for i, t in texts for e in [encoder.whole(t or "") + bytes(4)])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_token_file_layout(spark, docs, tmp_path, monkeypatch):
    """Row groups of the size set, page indexes, dictionary or delta pages; lengths are read without the ids."""
    monkeypatch.setattr(tokens, "ROW_GROUP_BYTES", 40_000)
    monkeypatch.setattr(tokens, "PAGE_BYTES", 4_000)
    folder = str(tmp_path / "ids")
    many = docs.selectExpr("explode(sequence(0, 11)) AS c", "*").selectExpr("doc_id + 1000 * c AS doc_id", "text")
    tokens.write_tokens(many, "byte_bpe_50k.json", folder)
    groups, last = 0, None
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        file = pq.ParquetFile(path)
        groups += file.num_row_groups
        for g in range(file.num_row_groups):
            columns = {c.path_in_schema: c for c in (file.metadata.row_group(g).column(i) for i in range(4))}
            assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
            assert all(c.compression == "ZSTD" for c in columns.values())
            for c in columns.values():
                assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(c.encodings)
        for doc_id in file.read(["doc_id"]).column(0).to_pylist():
            assert doc_id is None or last is None or last <= doc_id
            last = doc_id if doc_id is not None else last
    assert groups > len(glob.glob(f"{folder}/*.parquet"))
    plan = tokens.read_tokens(spark, folder).select("doc_id", "n_tokens").where("doc_id >= 1000")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan and "GreaterThanOrEqual(doc_id,1000)" in plan


def test_token_files_without_rows(none):
    assert tokens.token_digests(none).count() == 0


def check_packing(pieces, texts, capacity):
    encoder = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts:
        if [j for j, _ in texts].count(i) > 1:
            continue
        own = sorted(by_doc[i], key=lambda r: r["start"])
        ids = [x for r in own for x in r["ids"]]
        assert np.array(ids, "<u4").tobytes() == encoder.whole(t or "") + (1).to_bytes(4, "little")
        assert [r["start"] for r in own] == np.append(0, np.cumsum([r["length"] for r in own]))[:-1].tolist()
        assert all(r["doc_tokens"] == len(ids) and r["length"] == len(r["ids"]) for r in own)
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == np.append(0, np.cumsum([n for _, n in own]))[:-1].tolist()
        assert sum(n for _, n in own) <= capacity
    return len(by_sequence)


def test_packing(docs, texts):
    pieces = packing.pack(docs.coalesce(1), capacity=256, piece=64).collect()
    total = sum(r["length"] for r in pieces)
    assert check_packing(pieces, texts, 256) <= 1.02 * total / 256 + 2
    # the registered query: checksums of the pieces of each document's ids, and every id in one piece
    encoder, own = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json")), defaultdict(list)
    for r in packing.packing_report(docs).collect():
        own[r["doc_id"]].append(r)
    once = [(i, t) for i, t in texts if [j for j, _ in texts].count(i) == 1]
    for i, t in once:
        ids, at = encoder.whole(t or "") + (1).to_bytes(4, "little"), 0
        for r in sorted(own[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at:4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4


def test_packing_without_rows(none):
    assert packing.packing_report(none).count() == 0


def test_differencing_is_even():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 512, 1500)
    window = packing.difference(sizes, 180)
    sums = np.bincount(window, sizes, 180)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 8
    assert sorted(packing.difference(np.array([8, 7, 6, 5, 4]), 2).tolist()) and np.bincount(packing.difference(np.array([4, 3]), 4), [4, 3], 4).max() == 4
    assert np.bincount(packing.windows(np.array([900] * 5), 1000), [900] * 5).max() == 900


# --- op9 -----------------------------------------------------------------------------------------


def plain_classes(texts, size=4, percent=85):
    sets = []
    for _, t in texts:
        w = BLANKS.findall(ascii_lower(t or ""))
        sets.append({tuple(w[s:s + size]) for s in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = Counter()
    for a, (i, _) in enumerate(texts):
        reach = [texts[b][0] for b in range(len(texts)) if find(b) == find(a)]
        out[(i, len(sets[a]), None if None in reach else min(reach))] += 1
    return out


@pytest.mark.parametrize("size,percent", [(4, 85), (1, 60), (2, 95)])
def test_classes(docs, texts, size, percent):
    got = rows_of(jaccard.jaccard_classes(docs, size, percent))
    assert got == plain_classes(texts, size, percent)
    assert len({r[2] for r in got}) < len(texts)


@pytest.mark.parametrize("group,asked,tokens", [(3, 4, 2_000_000), (400, 2_000, 150)])
def test_classes_over_group_bounds(spark, monkeypatch, group, asked, tokens):
    """Chains and stars of near copies, in groups of three members, or of two by their tokens."""
    rng = np.random.default_rng(2)
    texts, base = [], [f"w{i}" for i in range(60)]
    for i in range(160):
        own = list(base)
        for p in rng.choice(60, rng.integers(1, 5), replace=False):
            own[p] = f"v{rng.integers(0, 30)}"
        texts.append((i, " ".join(own)))
        if i % 40 == 39:
            base = [f"w{i}_{j}" if j % 3 else x for j, x in enumerate(base)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "ASKED_GROUP", asked)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", tokens)
    assert rows_of(jaccard.jaccard_classes(docs, 2, 80)) == plain_classes(texts, 2, 80)


def test_texts_without_a_partner_stay_where_they_are(spark):
    """The mask lets all candidates through and few others, and the join drops these."""
    docs = spark.range(3_000).selectExpr("id AS doc_id", "concat('a b c d e f ', id) AS text")
    rows = words.keyed(docs).select("_k", "_t", "text", F.xxhash64("_k", "_t").alias("_h"))
    one = words.keyed(docs).filter("_k % 150 = 7").selectExpr("_k AS v", "4L AS n", "_k", "_t")
    for keys, n, most in ((one, 20, 20 + 3_000 // 8), (one.limit(0), 0, 0)):
        made = rows.mapInArrow(jaccard._placed(jaccard._mask(keys, n), 4, 85), jaccard._PLACED).count()
        assert n <= made <= most
        got = jaccard._chosen(docs, keys, n, 4, 85).collect()
        assert sorted(r["v"] for r in got) == [7 + 150 * i for i in range(n)]
        assert all(zstandard.decompress(r["body"]).decode() == f"a b c d e f {r['v']}" and r["low"] is not None for r in got)


def test_only_groups_that_reach_the_bound_are_opened():
    """Of 100 elements a linked partner shares a known number of lowest hashes; one fewer in the union is too few."""
    least = int(jaccard._shared(np.array([100]), 85)[0])
    pool = np.arange(1, jaccard._pool(100, 85) + 1).astype(np.uint64) * np.uint64(2 ** 59)
    pool.sort()
    asks = pd.DataFrame({"g": [7], "v": [1], "n": [100], "pool": [pool.tobytes()]})
    for common, opens in ((least, 1), (least - 1, 0), (0, 0)):
        union = np.sort(np.concatenate([pool[:common], np.arange(50, dtype=np.uint64) * np.uint64(3) + np.uint64(1)]))
        got = jaccard._bounded(85)((7, 0), pd.DataFrame({"g": [7], "pool": [union.tobytes()]}), asks)
        assert len(got) == opens and list(got.columns) == ["g", "v", "n"]


def test_classes_without_rows(none):
    assert jaccard.jaccard_classes(none).count() == 0


def test_pipeline_stage_follows_the_numbers_of_op9(spark, docs, texts):
    """Also over copies with four spread edits, which are links by 5 words and 80 percent only."""
    words = [f"p{i}" for i in range(200)]
    edited = [f"q{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(words)]
    more = [(900, " ".join(words)), (901, " ".join(edited)), (902, " ".join(words[:-1] + ["r"]))]
    rows = [x for x in texts if [i for i, _ in texts].count(x[0]) == 1 and x[0] is not None] + more
    kept = corpus_pipeline.keep_one_of_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r[0] for r in plain_classes(rows, 4, 85) if r[0] == r[2]}
    assert {900, 901} <= ids and 902 not in ids
    assert 901 not in {r[0] for r in plain_classes(rows, 5, 80) if r[0] == r[2]}


def test_one_of_each(docs, texts):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    classes = plain_classes(texts)
    assert set(ids) == {r[0] for r in classes if r[0] == r[2] and r[0] is not None}
    assert ids.count(5) == 0 and ids.count(200) == 1


# --- op1 -----------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert len(held) > 500 and np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.98


def test_quality_of_odd_rows(spark, docs, none, texts):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, None), (9, None, 1), (None, 1, 0), (13, 1, 0), (13, 0, 0), (14, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.good_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns and rows_of(kept) == rows_of(docs)


def test_quality_takes_one_worker_a_task(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (2, 0), (9, 1), (12, 0)], "doc_id long, quality int")
    kept = quality.good_documents(docs, labels)
    assert str(kept._jdf.queryExecution().executedPlan()).count("MapInArrow ") == 1
    x = quality.measured(docs, "doc_id", "text")
    model = quality.fit(np.stack([r["x"] for r in x.collect()]).astype(np.float32), np.arange(docs.count()) % 2.0)
    rows = lambda df: Counter((r["doc_id"], r["text"], r["score"]) for r in df.collect())
    assert rows(quality.judged(docs, model, "doc_id", "text")) == rows(quality.scored(x, model))


# --- the queries with SQL ------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.queries()[name](spark, folder)
    cursor = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.select(*names)) == Counter(cursor.fetchall())


def test_postings_hash_and_split_each_text_once(spark):
    """Beside the generator the hash of a whole text was worked out for each word, and a filter split texts again."""
    docs = spark.createDataFrame([(1, "a b C"), (2, None), (3, "--")], "doc_id long, text string")
    made = decontam.postings(docs, spark.sql("SELECT xxhash64('c') AS term"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate ")
    assert "hash(coalesce(text" not in above.replace("xxhash64", "") and below.count("hash(coalesce(text") == 1
    assert "Filter" not in below.split("Union")[0] and sorted((r._k, r.pos) for r in made.collect()) == [(1, 2), (1, 3), (2, 0), (3, 0)]


def test_a_known_word_takes_few_bytes_in_the_table():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 70_000).astype(np.uint64) << np.uint64(8))  # low bits are equal: many share a slot
    keys = np.concatenate([keys, np.unique(rng.integers(1, 1 << 62, 70_000).astype(np.uint64))])
    keys = rng.permutation(np.unique(keys))
    table = tokens._Places()
    assert (table.find(keys[:9]) == -1).all()
    for at in range(0, len(keys), 30_000):
        table.add(keys[at:at + 30_000])
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys ^ np.uint64(1 << 63 | 1)) == -1).all()
    held = sum(x.nbytes for x in vars(table).values())
    assert held <= 24 * len(keys)
