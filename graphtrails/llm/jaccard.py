"""Jaccard join of word shingles with a token-group matrix.

1. A document's set is its distinct shingles. Sets that are equal become one (a class of copies).
2. A pair over the threshold shares most of the lowest hashes of both sets. A compact exchange counts for
   every document how many of its lowest hashes any other document has too; documents with too few can't
   be in a pair and leave here. The count is exact, so nothing is lost.
3. What is left is sorted twice over range partitions, by its lowest and by its highest hash, and cut into
   groups of similar documents as it streams by; texts move compressed and become sets inside. In a group, one
   posting list per token gives each member's overlaps with all others. Found links are joined into classes.
4. Only links between different classes are open now. Documents are grouped by the commonest token they have
   in common with another class. By its own rarest tokens a document asks for groups in which a larger class
   has one of them (classes are ordered by size, so the members of a very large class never ask).
5. The token-group matrix stores for each group the union of all tokens that its members' lowest hashes give.
   A pair that links shares a known number of these, so an asking document that has fewer in common with the
   union has no partner there. Only groups that reach this bound are opened: texts move to these alone, and
   the query is compared with every member.

Two documents link when ``100 * intersection >= percent * union``. Words are runs of bytes other than
``[\\x20\\x09-\\x0D]``, A-Z in lower case; a text of fewer words than a shingle is one shingle, one without
words has the empty set and no links. Equal sets always link. Rows that repeat a ``doc_id`` with another
text have a row each. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from graphtrails.llm.exchange import Prints, repeated
from graphtrails.llm.words import NO_ID, bounded_batches, doc_key, find_words, keyed, mix, shingle_sets, slices, without
from graphtrails.operators.hooks import components
from graphtrails.scratch import Scratch

SHINGLE = 4
PERCENT = 85
#: Members of a group that is compared inside, at most.
GROUP = 400
#: Members of a group of the matrix, and documents that ask for it in one task, at most.
ASKED_GROUP = 2_000
#: Tokens of all sets of a group, or of what asks for it in one task; a longer set has a group of its own.
GROUP_TOKENS = 2_000_000


def _need(n, percent: int):
    """The least intersection of a linked pair in which one set has ``n`` elements."""
    return (percent * n + 99) // 100


def _pool(n, percent: int):
    """How many of the lowest hashes of a set are looked at."""
    return np.minimum(n, 2 * (n - _need(n, percent)) + 1)


def _shared(n, percent: int):
    """How many of these any linked pair has in common at least."""
    least = _need(n, percent)  # the smallest partner
    return _pool(least, percent) - (least - _need(least, percent))


def _sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row and number of texts of a slice; row, hash, and where each row begins; sorted."""
    for at, part in slices(texts):
        row, value = shingle_sets(find_words(part, lower=True), shingle)
        yield at, len(part), row, value, np.searchsorted(row, np.arange(len(part) + 1))


def _lowest(shingle: int, percent: int):
    def make(batch: pa.RecordBatch) -> Prints:
        rows, ranks, values = [], [], []
        for at, n, row, value, bounds in _sets(batch.column("text"), shingle):
            rank = np.arange(len(row)) - bounds[row]
            low = rank < _pool(np.diff(bounds), percent)[row]
            rows.append(row[low] + at)
            ranks.append(rank[low])
            values.append(value[low])
        # the order of a set is that of its hashes; their places in the exchange need other bits
        return Prints(np.concatenate(rows), np.concatenate(ranks), mix(np.concatenate(values)))
    return make


def _sizes(shingle: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, n, row, value, bounds in _sets(batch.column("text"), shingle):
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mix(value), mix(value * np.uint64(0xD6E8FEB86659FD93)))]
                out[0].append(np.diff(bounds))
                for o, s in zip(out[1:], sums):
                    o.append((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_k"), batch.column("_t"), *(pa.array(np.concatenate(o)) for o in out)],
                names=["doc_id", "_k", "_t", "n", "a", "b"])
    return sizes


def set_sizes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, _k, _t, n, a, b)``: size and 128-bit hash of every document's set."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("_k"), F.hash(text).alias("_t"), text.alias("text"))
    return rows.mapInArrow(_sizes(shingle), "doc_id long, _k long, _t int, n long, a long, b long")


def _sets_of(bodies: list[bytes], shingle: int) -> list[np.ndarray]:
    """The sets of packed texts, each sorted."""
    read, out = zstandard.ZstdDecompressor(), []
    texts = pa.array([read.decompress(x).decode() for x in bodies], pa.string())
    for _, n, _, value, bounds in _sets(texts, shingle):
        out += [value[bounds[d]:bounds[d + 1]] for d in range(n)]
    return out


#: Bits of the mask for each key, and bits of it at most: it is sent to every task (8 MB), and beyond that lets more through.
MASK_BITS, MOST_BITS = 16, 1 << 26
_PLACED = "_k long, _t int, low long, high long, body binary, pool binary"


def _mask(keys: DataFrame, n: int) -> np.ndarray:
    """64-bit words in which the bits of the hashes of ``keys(_k, _t)`` are set; ``n`` is their number."""
    size = min(MOST_BITS, 1 << max(6, (MASK_BITS * n).bit_length()))
    bit = keys.select(F.pmod(F.xxhash64("_k", "_t"), F.lit(size)).alias("_b"))
    words = bit.groupBy(F.expr("_b div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(_b % 64 AS int)))").alias("word")).toPandas()
    mask = np.zeros(size // 64, np.int64)
    mask[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return mask


def _placed(mask: np.ndarray, shingle: int, percent: int):
    """Ends, pools and packed texts of the rows that ``mask`` lets through."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bit = batch.column("_h").to_numpy() & (64 * len(mask) - 1)
            batch = batch.filter(pa.array((mask[bit >> 6] >> (bit & 63)) & 1 == 1))
            sets = [value[bounds[d]:bounds[d + 1]] for _, n, _, value, bounds in _sets(batch.column("text"), shingle) for d in range(n)]
            ends = [pa.array([int(s[i:][:1].view(np.int64)[0]) if len(s) else None for s in sets], pa.int64()) for i in (0, -1)]
            pools = pa.array([s[:_pool(len(s), percent)].tobytes() for s in sets], pa.binary())
            body = pa.array([write.compress(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), batch.column("_t"), *ends, body, pools], names=["_k", "_t", "low", "high", "body", "pool"])
    return placed


def _chosen(docs: DataFrame, one: DataFrame, n: int, shingle: int, percent: int) -> DataFrame:
    """``(v, n, low, high, body, pool)`` of the documents ``one(v, n, _k, _t)``, of which there are ``n``.

    Most other documents stay where they are read: a mask of hashes tells them apart there. The join drops the rest.
    """
    rows = keyed(docs).select("_k", "_t", "text", F.xxhash64("_k", "_t").alias("_h"))
    made = rows.mapInArrow(_placed(_mask(one, n), shingle, percent), _PLACED)
    return made.join(one.select("v", "n", "_k", "_t"), ["_k", "_t"]).select("v", "n", "low", "high", "body", "pool")


class _Postings:
    """Token lists of some sets turned into one list of members per token."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.members = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, self.starts = np.unique(tokens[order], return_index=True)
        self.starts = np.append(self.starts, len(tokens))

    def found(self, query: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        return at[self.tokens[at] == query]

    def linked(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Members whose set links with the query's; none unless the union of all could reach the bound."""
        at = self.found(query)
        if len(at) < _need(len(query), percent):
            return np.empty(0, np.int64)
        lo, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.members[places], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(query) - both))


def _links(bodies: dict[int, bytes], shingle: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the members of a group into their classes there."""
    if len(bodies) < 2:
        return []
    sets, v = _sets_of(list(bodies.values()), shingle), list(bodies)
    root, postings = np.arange(len(v)), _Postings(sets)
    for i, own in enumerate(sets):
        roots = np.unique(root[postings.linked(own, percent)])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    return [(v[i], v[root[i]]) for i in np.flatnonzero(root != np.arange(len(v)))]


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _inside(key: str, shingle: int, percent: int, most: int, tokens: int):
    """Cuts rows sorted by ``key`` into groups: those of one key, and a new group where one is full."""
    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, now, size = {}, None, 0
        for batch in batches:
            out = []
            for k, v, n, body in zip(*(batch.column(c).to_pylist() for c in (key, "v", "n", "body"))):
                if k != now or len(bodies) >= most or size + n > tokens:
                    out += _links(bodies, shingle, percent)
                    bodies, now, size = {}, k, 0
                if v not in bodies:
                    bodies[v] = body
                    size += n
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=_EDGES)
        out = _links(bodies, shingle, percent)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], schema=_EDGES)
    return inside


def _parts(most: int, tokens: int):
    """Into how many groups rows ``(v, n)`` go, by their number and the sum of their sets' sizes."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("n") / tokens)).cast("long")


def _union(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
    pools = [np.frombuffer(x, np.uint64) for x in members["pool"]]
    return pd.DataFrame({"g": [key[0]], "pool": [np.unique(np.concatenate(pools)).tobytes()]})


def _bounded(percent: int):
    def bounded(key: tuple, union: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(union) or not len(asking):
            return asking.loc[asking.index[:0], ["g", "v", "n"]]
        whole = np.frombuffer(union["pool"].iloc[0], np.uint64)
        common = []
        for x in asking["pool"]:
            tokens = np.frombuffer(x, np.uint64)
            at = np.minimum(np.searchsorted(whole, tokens), len(whole) - 1)
            common.append(np.count_nonzero(whole[at] == tokens))
        reach = np.array(common) >= _shared(asking["n"].to_numpy(), percent)
        return asking.loc[reach, ["g", "v", "n"]]
    return bounded


def _across(shingle: int, percent: int):
    def across(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["v", "asking"])
        members, asking = rows[~rows["asking"]], rows[rows["asking"]]
        out = []
        if len(members) and len(asking):
            postings = _Postings(_sets_of(members["body"].tolist(), shingle))
            v, component = members["v"].to_numpy(), members["component"].to_numpy()
            for query, own, q in zip(_sets_of(asking["body"].tolist(), shingle), asking["component"], asking["v"]):
                hits = postings.linked(query, percent)
                hits = hits[component[hits] != own]
                _, first = np.unique(component[hits], return_index=True)
                out += [(q, v[h]) for h in hits[first]]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")
    return across


def _pool_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(x, np.int64) for x in batch.column("pool").to_pylist()]
        row = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        tokens = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("v").take(row), batch.column("component").take(row), tokens], names=["v", "component", "token"])


def linked_sets(sets: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """``(vid, component)`` of all sets ``(v, n, low, high, body, pool)`` that link with another one."""
    edges = None
    for seed, key in enumerate(("low", "high")):
        rows = sets.select(key, "v", "n", "body").withColumn("_o", F.xxhash64("v", F.lit(seed)))
        rows = rows.repartitionByRange(key, "_o").sortWithinPartitions(key, "_o")
        found = rows.mapInArrow(_inside(key, shingle, percent, GROUP, GROUP_TOKENS), "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
    edges = scratch.save(edges, "inside")
    first = scratch.save(components(edges, scratch), "classes")
    sizes = first.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    labels = first.join(sizes, "component").select(F.col("vid").alias("v"), "component", "weight")
    # equal sizes of different classes are told apart by the class
    named = sets.select("v", "n", "pool").join(labels, "v", "left").withColumn("component", F.coalesce("component", "v"))
    named = scratch.save(named.withColumn("weight", F.coalesce("weight", F.lit(1))), "named")

    pools = named.select("v", "component", "pool").mapInArrow(_pool_rows, "v long, component long, token long")
    crossing = pools.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    crossing = crossing.filter("_lo <> _hi").select("token", "df")
    mine = Window.partitionBy("v")
    # how many tokens of the pool decide: with one more than a linked pair may lack, one is common
    lead = named.select("v", "n", "component", "weight", (_shared_column(F.col("n"), percent) - 1).alias("_spare")).distinct()
    decisive = (
        pools.select("v", "token").join(crossing, "token")
        .withColumn("_i", F.row_number().over(mine.orderBy("df", "token")))
        .withColumn("_c", F.count(F.lit(1)).over(mine))
        .withColumn("top", F.max(F.struct("df", "token")).over(mine)["token"])
        .join(lead, "v")
        .filter("_i <= _c - _spare")
        .select("token", "v", "top", "n", "component", "weight")
    )
    decisive = scratch.save(decisive, "decisive")
    split = decisive.select("v", "top", "n").distinct()
    counts = split.groupBy("top").agg(_parts(ASKED_GROUP, GROUP_TOKENS).alias("_n"))
    groups = split.join(counts, "top").select("v", F.xxhash64("top", F.pmod(F.xxhash64("v", F.lit(2)), "_n")).alias("g"))
    groups = scratch.save(groups, "groups")
    rank = F.struct("weight", "component")
    matrix = decisive.join(groups, "v").groupBy("token", "g").agg(F.max(rank).alias("most"))
    asks = decisive.select("token", "v", "n", rank.alias("rank")).join(matrix, "token").filter("rank < most").select("v", "n", "g").distinct()
    asks = scratch.save(asks, "asks")

    def dealt(asks):
        """Askers with their part of the tasks of a group, and every part of every group."""
        counts = asks.groupBy("g").agg(_parts(ASKED_GROUP, GROUP_TOKENS).alias("parts"))
        own = asks.join(counts, "g").select("g", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v", "n")
        return own, counts.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    asking, every = dealt(asks)
    asked = groups.join(asks.select("g").distinct(), "g", "left_semi").join(named.select("v", "pool"), "v")
    unions = asked.groupBy("g").applyInPandas(_union, "g long, pool binary").join(every, "g")
    asking = asking.join(named.select("v", "pool"), "v")
    opened = unions.groupBy("g", "part").cogroup(asking.groupBy("g", "part")).applyInPandas(_bounded(percent), "g long, v long, n long")
    opened, seen = scratch.save(opened, "opened", n=F.count(F.lit(1)))
    if not seen["n"]:
        return first

    asking, every = dealt(opened.distinct())
    rows = asking.select("g", "part", "v", F.lit(True).alias("asking")).unionByName(
        groups.join(every, "g").select("g", "part", "v", F.lit(False).alias("asking")))
    rows = rows.join(named.select("v", "component").distinct(), "v").join(sets.select("v", "body"), "v")
    more = rows.groupBy("g", "part").applyInPandas(_across(shingle, percent), "u long, v long")
    more, seen = scratch.save(more, "across", n=F.count(F.lit(1)))
    return components(edges.unionByName(more), scratch) if seen["n"] else first


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, _k, _t, n_shingles, component_id, first)``: the smallest ``doc_id`` that links reach from each document.

    ``first`` marks the document (or equal rows) that stands for its class.
    """
    scratch = scratch or Scratch.of(docs.sparkSession)
    sizes = scratch.save(set_sizes(docs, shingle), "sizes")
    seen = repeated(keyed(docs), _lowest(shingle, percent))
    seen = seen.groupBy("_k", "_t").agg(F.sum(F.length("places") / 4).alias("_seen"))
    open_docs = sizes.filter("n > 0").join(seen, ["_k", "_t"]).filter(F.col("_seen") >= _shared_column(F.col("n"), percent))
    one = open_docs.groupBy("n", "a", "b").agg(F.min(F.struct("_k", "_t")).alias("_one"))
    one, seen = scratch.save(
        one.select("n", "a", "b", F.xxhash64("n", "a", "b").alias("v"), "_one._k", "_one._t"), "one", n=F.count(F.lit(1)))
    sets = scratch.save(_chosen(docs, one, seen["n"], shingle, percent), "sets")
    linked = linked_sets(sets, shingle, percent, scratch)
    # all documents of a class, by set; the first row of each
    by_set = sizes.groupBy("n", "a", "b").agg(F.min(F.struct("_k", "_t")).alias("_first"), F.count(F.lit(1)).alias("_copies")).filter("n > 0")
    several = by_set.join(one.select("n", "a", "b", "v"), ["n", "a", "b"]).join(linked.withColumnRenamed("vid", "v"), "v")
    smallest = several.groupBy("component").agg(F.min("_first").alias("_least"))
    names = several.join(smallest, "component").select("n", "a", "b", "_least")
    names = scratch.save(names.unionByName(
        by_set.filter("_copies > 1").select("n", "a", "b", F.col("_first").alias("_least"))
    ).groupBy("n", "a", "b").agg(F.min("_least").alias("_least")), "names")
    first = F.coalesce("_least", F.struct("_k", "_t"))
    return sizes.join(names, ["n", "a", "b"], "left").select(
        "doc_id", "_k", "_t", F.col("n").alias("n_shingles"),
        F.nullif(first["_k"], F.lit(NO_ID)).alias("component_id"),
        ((first["_k"] == F.col("_k")) & (first["_t"] == F.col("_t"))).alias("first"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The first document of every class, by ``doc_id``, with all its columns; of equal rows one."""
    scratch = Scratch.of(docs.sparkSession)
    others = scratch.save(classes(docs, shingle, percent, scratch).filter("NOT first").select("_k", "_t").distinct(), "others")
    return without(docs, others, once=True)


def _shared_column(n, percent: int):
    """``_shared`` as a column."""
    need = lambda x: F.floor((percent * x + 99) / 100).cast("long")
    least = need(n)
    return F.least(least, 2 * (least - need(least)) + 1) - (least - need(least))


def jaccard_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    return classes(docs, shingle, percent).select("doc_id", "n_shingles", "component_id")
