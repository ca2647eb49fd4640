"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index stores a posting (term, document, position) for every word of the documents that is a test
term, that is, a word of some benchmark item. Exact phrases are found from the rarest terms on:

1. Every window of a benchmark item takes its two rarest terms (by postings). A window with a term that
   has none can't occur and is left out.
2. The postings of the rarest term, moved by its offset, give places where the window may start; those of
   the second one, moved by its own, must give the same place.
3. Places on which both agree are few; there the postings of all of the window's terms are intersected.

``near_matches`` gives proximity matches: documents in which all terms of an item stand within a span.

Terms are 64-bit hashes of words. Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became lower case. Null and empty texts have no
words. An item with fewer words than a window, but with one, is one window; items without words never
occur. Items and documents that repeat an id with another text are told apart by the text; a repeated item
counts once. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphtrails.llm.words import NO_ID, doc_key, without
from graphtrails.scratch import Scratch

WINDOW = 13
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, in their own case. Separators at the ends go first, as splitting would leave empty words there."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SEPARATORS))
    return F.when(bare == "", F.lit(None)).otherwise(F.split(bare, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def lower(text: Column) -> Column:
    """A-Z in lower case. What is ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, n, q, word)``: the words of every item at positions from 0."""
    text = F.coalesce("text", F.lit(""))
    rows = items.select("item_id", F.xxhash64("item_id", text).alias("item"), words(lower(text)).alias("w")).distinct()
    return rows.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("q", "word"))


#: Stands after a document's last word; no word, as it is a separator.
_END = "\n"


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, _k, _t, pos)`` of all words of the documents whose hash is among ``terms(term)``.

    Every row of ``docs`` also has a posting of the term of ``_END``, at the number of its words.
    """
    text = F.coalesce("text", F.lit(""))
    ended = F.array_append(F.coalesce(words(text), F.array().cast("array<string>")), F.lit(_END))
    # two steps: beside the generator, a text's hash would be worked out again for each of its words; and outer, as else
    # a filter for arrays that aren't empty (none is) would split every text once more
    split = docs.select(doc_key().alias("_k"), F.hash(text).alias("_t"), ended.alias("_words"))
    every = split.select("_k", "_t", F.posexplode_outer("_words").alias("pos", "_w"))
    wanted = terms.unionByName(docs.sparkSession.range(1).select(F.xxhash64(F.lit(_END)).alias("term")))
    return every.select(F.xxhash64(lower(F.col("_w"))).alias("term"), "_k", "_t", "pos").join(wanted, "term")


class Index:
    """The stored postings of the test terms and how often each occurs."""

    def __init__(self, docs: DataFrame, items: DataFrame, scratch: Scratch | None = None):
        self.scratch = scratch or Scratch.of(docs.sparkSession)
        named = item_terms(items)
        self.items = self.scratch.save(
            named.select("item", "item_id", "n", "q", F.xxhash64("word").alias("term")), "items")
        self.terms = self.scratch.save(self.items.select("term").distinct(), "terms")
        stored = self.scratch.save(postings(docs, self.terms), "postings")
        end = F.xxhash64(F.lit(_END))
        self.postings = stored.filter(F.col("term") != end)
        #: ``(_k, _t, n_words)`` of every row of ``docs``.
        self.sizes = stored.filter(F.col("term") == end).select("_k", "_t", F.col("pos").cast("long").alias("n_words"))
        self.counts = self.scratch.save(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "counts")

    def windows(self, size: int) -> DataFrame:
        """``(window, item, item_id, s, k, term, df)``: windows all of whose terms occur, rarest term first (k = 1)."""
        ranked = self.items.join(self.counts, "term")
        length = F.least(F.col("n"), F.lit(size))
        first = F.greatest(F.lit(0), F.col("q") - length + 1)
        last = F.least(F.col("q"), F.col("n") - length)
        rows = ranked.withColumn("s", F.explode(F.sequence(first, last))).select(
            "item", "item_id", "s", (F.col("q") - F.col("s")).alias("o"), "term", "df", length.alias("length"))
        mine = Window.partitionBy("item", "s")
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(mine)).filter("_n = length")
        return rows.withColumn("k", F.row_number().over(mine.orderBy("df", "term", "o"))).drop("_n")

    def phrase_matches(self, size: int = WINDOW) -> DataFrame:
        """``(_k, _t, item, item_id, s, length, start)``: every exact occurrence of a window in a document."""
        windows = self.scratch.save(self.windows(size), "windows")
        # one anchor may serve many windows of an item: places are kept by diagonal, document minus item
        pairs = windows.groupBy("item", "s", "length").agg(
            F.min(F.when(F.col("k") == 1, F.struct("term", (F.col("s") + F.col("o")).alias("q")))).alias("a"),
            F.min(F.when(F.col("k") == 2, F.struct("term", (F.col("s") + F.col("o")).alias("q")))).alias("b"),
        ).withColumn("b", F.coalesce("b", "a"))
        pairs = self.scratch.save(pairs.select(
            "item", "s", "length", F.col("a.term").alias("ta"), F.col("a.q").alias("qa"), F.col("b.term").alias("tb"), F.col("b.q").alias("qb")), "pairs")
        sides = pairs.select("item", "qa", "qb", F.inline(F.array(
            F.struct(F.lit(0).alias("side"), F.col("ta").alias("term"), F.col("qa").alias("q")),
            F.struct(F.lit(1).alias("side"), F.col("tb").alias("term"), F.col("qb").alias("q"))))).distinct()
        moved = self.postings.join(sides, "term").select(
            "_k", "_t", "item", "qa", "qb", (F.col("pos") - F.col("q")).alias("diagonal"), "side")
        agreed = moved.groupBy("_k", "_t", "item", "qa", "qb", "diagonal").agg(
            F.max("side").alias("_hi"), F.min("side").alias("_lo")).filter("_hi > _lo").drop("_hi", "_lo")
        places = agreed.join(pairs.select("item", "qa", "qb", "s", "length"), ["item", "qa", "qb"]).select(
            "_k", "_t", "item", "diagonal", "s", "length").filter("diagonal + s >= 0")
        places = self.scratch.save(places, "places")
        # the terms that are left to compare, each place of a document once
        wanted = places.select("_k", "_t", "item", "diagonal", F.explode(F.sequence("s", F.expr("s + length - 1"))).alias("q")).distinct()
        wanted = wanted.join(self.items.select("item", "q", "term"), ["item", "q"])
        there = wanted.withColumn("pos", (F.col("diagonal") + F.col("q")).cast("int")).join(
            self.postings, ["_k", "_t", "term", "pos"], "left_semi")
        spans = there.groupBy("_k", "_t", "item", "diagonal").agg(F.sort_array(F.collect_set("q")).alias("_q"))
        full = places.join(spans, ["_k", "_t", "item", "diagonal"]).filter(
            F.size(F.array_intersect("_q", F.sequence("s", F.expr("s + length - 1")))) == F.col("length"))
        names = self.items.select("item", "item_id").distinct()
        return full.join(names, "item").select(
            "_k", "_t", "item", "item_id", "s", "length", (F.col("diagonal") + F.col("s")).cast("int").alias("start"))

    def near_matches(self, span: int = 100) -> DataFrame:
        """``(_k, _t, item, item_id, end)``: places where all terms of an item stand within ``span`` words.

        Starts from each item's rarest term: only documents with it are looked at.
        """
        terms = self.items.select("item", "item_id", "term").distinct().join(self.counts, "term", "left")
        mine = Window.partitionBy("item", "item_id")
        terms = terms.withColumn("_n", F.count(F.lit(1)).over(mine)).withColumn("_least", F.min(F.coalesce("df", F.lit(0))).over(mine))
        terms = self.scratch.save(terms.filter("_least > 0").withColumn("_i", F.row_number().over(mine.orderBy("df", "term"))), "near")
        rare = self.postings.join(terms.filter("_i = 1").select("term", "item"), "term").select("_k", "_t", "item").distinct()
        spots = self.postings.join(terms.select("term", "item", "item_id", "_n"), "term").join(rare, ["_k", "_t", "item"], "left_semi")
        within = Window.partitionBy("_k", "_t", "item", "item_id").orderBy("pos").rangeBetween(-(span - 1), 0)
        return spots.withColumn("_seen", F.size(F.collect_set("term").over(within))).filter("_seen = _n").select(
            "_k", "_t", "item", "item_id", F.col("pos").alias("end"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, _k, _t, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``."""
    index = Index(docs, items, scratch)
    matches = index.scratch.save(index.phrase_matches(size), "matches")
    keys = ["_k", "_t"]
    # hit words as the total length of merged spans: starts in order, each counted from the furthest end before
    order = Window.partitionBy(*keys).orderBy("start", "_end")
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = matches.select(*keys, "start", (F.col("start") + F.col("length")).alias("_end")).groupBy(*keys, "start").agg(F.max("_end").alias("_end"))
    hit = spans.withColumn("_from", F.greatest("start", F.coalesce(before, F.lit(0)))).groupBy(*keys).agg(
        F.sum(F.greatest(F.col("_end") - F.col("_from"), F.lit(0))).alias("n_hit"))
    found = matches.select(*keys, F.col("item_id").cast("string").alias("_i")).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("_i")), ",").alias("_items"))
    counted = index.sizes.withColumn("doc_id", F.nullif("_k", F.lit(NO_ID)))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(hit.join(found, keys), keys, "left").select(
        "doc_id", *keys, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("_items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def contamination_report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    return contamination(docs, items, size).drop("_k", "_t")


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    scratch = Scratch.of(docs.sparkSession)
    bad = scratch.save(contamination(docs, items, size, scratch).filter("contaminated").select("_k", "_t").distinct(), "contaminated")
    return without(docs, bad)
