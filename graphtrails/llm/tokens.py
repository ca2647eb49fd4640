"""Token ids of public tokenizers, and their Parquet files.

``Encoder`` gives the ids that the tokenizers library gives for a whole text. Where the tokenizer's own
splitting rules can't join two neighbouring pieces (a letter or sign, one space, a letter or sign), the
pieces are encoded apart and remembered, as most of a corpus is the same words again. A tokenizer with
other rules gets whole texts, and so does a text that holds the string of an added token (``<|endoftext|>``): it is
that token's id, as the library gives by default.

``write_tokens`` writes ``(doc_id, n_tokens, ids list<int>)`` in ascending order of ``doc_id`` over all files:
version 2 pages (delta and dictionary encoding), zstd, row groups of a set size, and page indexes, so
readers can take a range of documents, or the lengths without the ids.

Null and empty texts have only the end id. Equal ids of documents stay apart, in order of their text's hash;
a null id comes first. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphtrails.llm.words import Words, arrow_bytes, bounded_batches, byte_set, find_words, slices
from graphtrails.operators.ranks import prefix_sum
from graphtrails.scratch import Scratch

END = 0
#: Words that an encoder remembers, at most (about 60 bytes each); beyond that it keeps those it met again.
MEMORY = 2_000_000
#: Letter, digit and sign runs that it remembers, at most (about 150 bytes each); it starts anew beyond that.
PIECES = 300_000
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10

#: White space at an end or next to other white space; a single one between other characters is safe to cut at.
_UNEVEN = re.compile(r"\s\s|^\s|\s$")
_SPACES = byte_set(" \n")
_BLANKS = byte_set(" \t\n\r")
_WHITE = byte_set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
#: First bytes of characters that may be white space beyond ASCII.
_MAYBE_WHITE = byte_set("\xc2\xe1\xe2\xe3")
_NO_SPACE = np.uint64(0x5851F42D4C957F2D)
#: Words of these characters are split here: their classes and lower case are the same in every Unicode version.
_PLAIN = re.compile("[\\n\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
#: The two splitting rules that are known, as the library's byte level and the tokenizer's file state them (fixed values).
_BYTE_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_rule(rule: str) -> re.Pattern:
    """The rule for plain words, one a line: classes written out; a line end is a match of its own."""
    kind = lambda k: "".join(re.escape(c) for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == k)
    letters, digits = kind("L"), kind("N")
    written = rule.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{digits}]")
    for name, chars in (("L", letters), ("N", digits)):
        written = written.replace(rf"[\p{{{name}}}]", f"[{chars}]").replace(rf"\p{{{name}}}", f"[{chars}]")
    return re.compile(written + r"|\n")


def tokenizer_path(name: str) -> str:
    """An absolute path as it is; else the file of that name in the installed collection."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The character by which byte-level tokenizers show each byte: itself if it prints, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


#: From a byte's character in latin-1 to the one it is shown by; line ends stay.
_LETTERS = str.maketrans({b: x for b, x in enumerate(_byte_letters()) if b != 10})


class _Places:
    """Numbers of 64-bit keys in the order in which they were added: a hash table in arrays, at most half full.

    A slot holds the number only, the key is looked up by it: 8 to 16 bytes a key beside the key itself.
    """

    def __init__(self):
        self.keys = np.empty(0, np.uint64)
        self.slot = np.full(1 << 16, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        last = np.uint64(len(self.slot) - 1)
        spot = (keys & last).view(np.int64)
        at = self.slot[spot]
        if not len(self.keys):
            return at
        wrong = np.flatnonzero((self.keys[at] != keys) & (at >= 0))
        spot = spot[wrong]
        while len(wrong):
            spot = (spot + 1) & int(last)
            at[wrong] = self.slot[spot]
            more = (self.keys[at[wrong]] != keys[wrong]) & (at[wrong] >= 0)
            wrong, spot = wrong[more], spot[more]
        return at

    def add(self, keys: np.ndarray) -> None:
        """Add keys that differ and aren't there yet."""
        first = len(self.keys)
        self.keys = np.concatenate([self.keys, keys])
        if 2 * len(self.keys) > len(self.slot):
            self.slot = np.full(1 << int(2 * len(self.keys)).bit_length(), -1, np.int32)
            first = 0
        number = np.arange(first, len(self.keys))
        mask = len(self.slot) - 1
        spot = (self.keys[number] & np.uint64(mask)).view(np.int64)
        while len(number):
            free = self.slot[spot] < 0
            self.slot[spot[free]] = number[free]  # of several for one slot, the last stays
            left = self.slot[spot] != number
            number, spot = number[left], (spot[left] + 1) & mask


class _Pool:
    """Lists of ids, one after the other."""

    def __init__(self, first: np.ndarray):
        self.ids, self.size = first, len(first)
        self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int32)

    def add(self, ids: np.ndarray, count: np.ndarray) -> None:
        if self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.size], np.empty(self.size + len(ids), "<u4")])
        self.ids[self.size:self.size + len(ids)] = ids
        self.begin = np.concatenate([self.begin, self.size + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count.astype(np.int32)])
        self.size += len(ids)

    def take(self, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.ids[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]


def _lines(w: Words, which: np.ndarray, lead: str) -> str:
    """Some words, one a line, each after ``lead`` (a space or nothing)."""
    size = w.end[which] - w.start[which] + len(lead) + 1
    ends = np.cumsum(size)
    text = w.data[np.minimum(np.repeat(w.start[which] - len(lead) - ends + size, size) + np.arange(ends[-1]), len(w.data) - 1)]
    text[ends - 1] = 10
    if lead:
        text[ends - size] = 32
    return text[:-1].tobytes().decode()


class Encoder:
    """Texts to ids as little-endian 32-bit bytes. One per Python worker and file.

    What is remembered is arrays: hashes of words (with their lengths), and for each the place and the number of its ids in a
    pool. Only new words become strings. These are split by the tokenizer's own rule, and the library encodes
    each run that it didn't have yet by the model alone.
    Words beyond Latin letters are encoded whole by the library.
    """

    _open: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            rules = json.load(f)
        pre, norm = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
        norms = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        splits = pre.get("pretokenizers") or [{}]
        added = [x for x in rules.get("added_tokens") or [] if x["content"]]
        self.added = [x["content"] for x in added]
        self.rules, self.split = "", None
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.rules, self.separator, self.sign, self.split = "byte", "\n", "\n", _plain_rule(_BYTE_RULE)
        elif norms == ["NFC", "Replace", "Lowercase"] and splits[0].get("behavior") == "Removed" and splits[0].get("invert"):
            self.rules, self.separator, self.sign = "word", " 0 ", "0"
            if [splits[0].get("pattern"), *splits[1:]] == [{"Regex": _WORD_RULE}, {
                    "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]:
                self.split = _plain_rule(_WORD_RULE)
        if norm is not None and any(x.get("normalized") for x in added):  # found in texts in other spellings too
            self.rules = ""
        mark = self._ids(self.separator) if self.rules else []
        if len(mark) != 1:
            self.rules = ""
        else:
            self.mark = mark[0]
        # runs go to the model itself, in its letters: a whole encoding has much that isn't used here
        self.model = self.tokenizer.model
        self._forget()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _forget(self) -> None:
        self.known, self.again = _Places(), np.empty(0, bool)
        # the first id of the pool is the separator: a line end
        self.pool = _Pool(np.array([self.mark] if self.rules else [], "<u4"))
        self._forget_pieces()

    def _forget_pieces(self) -> None:
        self.pieces = {"\n": -1}
        self.piece_pool = _Pool(np.empty(0, "<u4"))

    def _keep_used(self) -> None:
        """Forget the words that were met in one slice of texts only, or all where that leaves more than half."""
        keep, keys, pool = np.flatnonzero(self.again), self.known.keys, self.pool
        self.known, self.again, self.pool = _Places(), np.empty(0, bool), _Pool(pool.ids[:1].copy())
        if 2 * len(keep) <= MEMORY:
            self.known.add(keys[keep])
            self.again = np.zeros(len(keep), bool)
            begin, count = pool.begin[keep], pool.count[keep]
            self.pool.add(pool.take(begin, count.astype(np.int64)), count)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _joined(self, words: list[str], lead: str) -> list[np.ndarray]:
        """Ids of words, each after ``lead``, encoded as one text; words with the separator's sign one by one."""
        plain = [i for i, w in enumerate(words) if self.sign not in w]
        out: list[np.ndarray | None] = [None] * len(words)
        for at in range(0, len(plain), 4000):
            some = plain[at:at + 4000]
            ids = np.array(self._ids(lead + (self.separator + lead).join([words[i] for i in some])), "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(some) - 1:
                for i, a, b in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                    out[i] = ids[a:b]
        return [np.array(self._ids(lead + w), "<u4") if x is None else x for w, x in zip(words, out)]

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Ids of runs that aren't known yet."""
        model = self.model
        for at in range(0, len(pieces), 4000):
            some = pieces[at:at + 4000]
            shown = "\n".join(some).encode().decode("latin-1").translate(_LETTERS).split("\n")
            ids = [[token.id for token in model.tokenize(x)] for x in shown]
            self.piece_pool.add(np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)))
            first = len(self.pieces) - 1
            self.pieces.update(zip(some, range(first, first + len(some))))

    def _split(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``n`` plain words, one a line, and how many each has."""
        pieces = self.split.findall(text.lower() if self.rules == "word" else text)
        own = set(pieces)
        own.discard("\n")
        new = [x for x in own if x not in self.pieces]
        if len(self.pieces) + len(new) > PIECES:
            self._forget_pieces()
            new = list(own)
        self._learn_pieces(new)
        at = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        ends = at < 0
        word = np.cumsum(ends)[~ends]
        at = at[~ends]
        count = self.piece_pool.count[at].astype(np.int64)
        return self.piece_pool.take(self.piece_pool.begin[at], count), np.bincount(word, count, n).astype(np.int64)

    def _learn(self, keys: np.ndarray, w: Words, seen: np.ndarray, spaced: np.ndarray) -> None:
        """Remember the words ``seen`` by their ``keys``, in this order; ``spaced`` says which follow a space."""
        lead = " " if self.rules == "byte" else ""
        ids, counts, order = [], [], []
        for flag, before in ((True, lead), (False, "")):
            own = np.flatnonzero(spaced == flag)
            if not len(own):
                continue
            text = _lines(w, seen[own], before)
            words = None
            if self.split is None or not _PLAIN.fullmatch(text):
                words = text.split("\n")
                odd = np.array([self.split is None or not _PLAIN.fullmatch(x) for x in words])
                lists = self._joined([words[i][len(before):] for i in np.flatnonzero(odd).tolist()], before)
                ids += lists
                counts.append(np.array([len(x) for x in lists], np.int64)), order.append(own[odd])
                text, own = "\n".join([words[i] for i in np.flatnonzero(~odd).tolist()]), own[~odd]
            if len(own):
                some, count = self._split(text, len(own))
                ids.append(some), counts.append(count), order.append(own)
        first = len(self.known.keys)
        self.known.add(keys)
        self.again = np.concatenate([self.again, np.zeros(len(keys), bool)])
        # lists stand in the pool as they were made; their places go to the words' numbers
        self.pool.add(np.concatenate(ids), np.concatenate(counts))
        made = first + np.argsort(np.concatenate(order))
        self.pool.begin[first:], self.pool.count[first:] = self.pool.begin[made], self.pool.count[made]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.rules:
            return [self.whole(t) for t in texts]
        return self.encode_array(pa.array(texts, pa.string()))

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """As ``encode``, of an Arrow array; null is empty."""
        if not self.rules:
            return [self.whole(t or "") for t in texts.to_pylist()]
        whole = set(self._uneven(texts)) if self.rules == "byte" else set()
        for content in self.added:
            whole.update(pc.indices_nonzero(pc.fill_null(pc.match_substring(texts, content), False)).to_pylist())
        apart = {d: self.whole(texts[d].as_py()) for d in whole}
        if apart:
            keep = np.ones(len(texts), bool)
            keep[list(apart)] = False
            texts = pc.if_else(pa.array(keep), texts, pa.scalar("", texts.type))
        w = find_words(texts, _SPACES if self.rules == "byte" else _BLANKS)
        out = self._gather(w, len(texts))
        for d, ids in apart.items():
            out[d] = ids
        return out

    def _uneven(self, texts: pa.Array) -> list[int]:
        """Texts with white space at an end or next to other white space: these are not cut."""
        data, offsets = arrow_bytes(texts)
        if not len(data):
            return []
        white = _WHITE[data]
        near = white.copy()
        near[1:] &= white[:-1]  # the second of two
        size = np.diff(offsets)
        some = size > 0
        near[offsets[:-1][some]] = white[offsets[:-1][some]]
        near[offsets[1:][some] - 1] |= white[offsets[1:][some] - 1]
        doc = lambda mask: np.unique(np.searchsorted(offsets, np.flatnonzero(mask), "right") - 1)
        sure = doc(near).tolist()
        rest = set(doc(_MAYBE_WHITE[data]).tolist()).difference(sure)
        return sure + [d for d in rest if _UNEVEN.search(texts[d].as_py())]

    def _gather(self, w: Words, n: int) -> list[bytes]:
        keys = w.hash
        line = np.zeros(len(keys), bool)
        spaced = np.ones(len(keys), bool)
        if self.rules == "byte":
            before = w.data[np.maximum(w.start - 1, 0)] if len(keys) else np.empty(0, np.uint8)
            first = w.pos == 0
            line = ~first & (before == 10)
            spaced = ~first & ~line
            keys = np.where(spaced, keys, keys ^ _NO_SPACE)
        at = self.known.find(keys)
        self.again[at[at >= 0]] = True
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, first_seen, each = np.unique(keys[new], return_index=True, return_inverse=True)
            if len(self.known.keys) + len(fresh) > MEMORY:
                self._keep_used()
                at = self.known.find(keys)
                new = np.flatnonzero(at < 0)
                fresh, first_seen, each = np.unique(keys[new], return_index=True, return_inverse=True)
            seen = new[first_seen]
            at[new] = len(self.known.keys) + each
            if len(seen):
                self._learn(fresh, w, seen, spaced[seen])
        # entries of the pool in order, a line end before the words that follow one
        spot = np.arange(len(keys)) + np.cumsum(line)
        total = len(keys) + int(line.sum())
        begin, count, doc = np.zeros(total, np.int64), np.ones(total, np.int64), np.zeros(total, np.int64)
        if len(keys):
            begin[spot], count[spot], doc[spot] = self.pool.begin[at], self.pool.count[at], w.doc
            ends = spot[line] - 1
            doc[ends] = w.doc[line]
        each = np.bincount(doc, count, n).astype(np.int64) if total else np.zeros(n, np.int64)
        ids = self.pool.take(begin, count).tobytes() if total else b""
        bounds = (4 * np.append(0, np.cumsum(each))).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def encoded(name: str, end: int, batch: pa.RecordBatch) -> Iterator[bytes]:
    """Ids of each text of a batch and the end id, in order."""
    encoder, stop = Encoder.of(tokenizer_path(name)), np.array([end], "<u4").tobytes()
    for _, texts in slices(batch.column("text")):
        for ids in encoder.encode_array(texts):
            yield ids + stop


def _lists(name: str, end: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(encoded(name, end, batch))
            sizes = np.array([len(x) // 4 for x in ids], np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(sizes), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "tag", "n_tokens", "ids"])
    return lists


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> None:
    """Write the ids of all documents below ``folder``, which must be new.

    Only the texts move, by ranges of ``doc_id``; ids are made where they are written.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    placed = rows.repartitionByRange("doc_id", "tag").sortWithinPartitions("doc_id", "tag")
    made = placed.mapInArrow(_lists(tokenizer, end), "doc_id long, tag long, n_tokens int, ids array<int>")
    made.write.options(**{
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true",
        "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES),
    }).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, offsets = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["doc_id", "tag", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from files written and read back."""
    spark, scratch = docs.sparkSession, Scratch.of(docs.sparkSession)
    folder = f"{scratch.root}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, folder, end)
    read = read_tokens(spark, folder).select("doc_id", "tag", "ids")
    # written, as ranges are sampled first and the ids would be read for that too
    sums = scratch.save(read.mapInArrow(_sums, "doc_id long, tag long, n_tokens long, ids_crc32 long"), "sums")
    placed = prefix_sum(sums, [F.col("doc_id"), F.col("tag")], "n_tokens", "start", scratch)
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")
