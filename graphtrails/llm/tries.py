"""The prefix trie of conversations, with sums over subtrees, by the Euler-tour technique.

A node is a distinct sequence of first turns. Every node gives an enter and an exit arc; each arc names the
next: into the first child, or out of a leaf, on to the next sibling, or out to the parent. The arcs form
one list, which ``rank_chains`` ranks distributedly; running sums along it, taken at a node's two arcs, differ by what
its subtree holds: leaves, and the words that sharing saves. No step depends on how deep the trie is.

A sequence of turns is known by two 64-bit exclusive-ors of hashes of (turn, place), so the names of all prefixes come from
running sums too. A conversation's turns are numbered and summed over range partitions, never gathered, and a node
with very many children, members or ends is counted before it is shuffled; the ids that end at a node are written as text
by ranges and hashed as a stream.

Turns are ordered by ``turn`` (null first), ties by role, then by the hash of the text. Null role or text is empty. Rows without ``conv_id``
belong to no conversation and are left out; repeated rows are turns of their own. Without conversations there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphtrails.operators.chains import OPEN, rank_chains, start_of
from graphtrails.operators.ranks import dense_rank
from graphtrails.scratch import Scratch

#: A shared start comes from the conversation at the next lower multiple of this.
GROUP, MOST_SHARED = 20, 4
#: Ids that one piece of text names at most.
PIECE_IDS = 20_000
#: Turns of one conversation whose hashes are joined in one window.
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def shared_turns(conv: Column | str) -> Column:
    """How many turns a conversation takes from the first one of its group, by the rule of the registered query."""
    return F.pmod(F.crc32(F.col(conv).cast("string") if isinstance(conv, str) else conv.cast("string")), F.lit(MOST_SHARED))


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``turns(c, pos, ta, tb, words)`` with two hashes of role and text, and ``convs(c, n)``."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "c", "turn", "role", F.sha2("text", 256).alias("sha"), F.xxhash64("role", "text").alias("ta"),
        F.xxhash64(F.lit(1), "text", "role").alias("tb"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    ranked = scratch.save(dense_rank(rows, order, "at", scratch, start=0).drop("turn", "role", "sha"), "turns")
    convs = scratch.save(ranked.groupBy("c").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "convs")
    turns = ranked.join(convs.select("c", "first"), "c").select("c", (F.col("at") - F.col("first")).alias("pos"), "ta", "tb", "words")
    return turns, convs.select("c", "n")


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of their group's first one; see ``shared_turns``.

    ``(turns, convs)`` as given, rebuilt. A group's first turns meet at most twice ``GROUP`` conversations.
    """
    base = convs.withColumn("h", shared_turns("c")).withColumn("b", F.expr(f"c - c % {GROUP}"))
    known = convs.select(F.col("c").alias("b"), F.col("n").alias("_nb"))
    base = base.join(known, "b", "left").select(
        "c", "b", "h", F.least("h", F.coalesce("_nb", F.lit(0))).cast("long").alias("lead"),
        F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    own = turns.join(base.select("c", "h", "lead"), "c").filter("pos >= h").selectExpr("c", "pos - h + lead AS pos", "ta", "tb", "words")
    first = turns.filter(F.col("pos") < MOST_SHARED - 1).withColumnRenamed("c", "b")
    lent = base.select("c", "b", "lead").join(first, "b").filter("pos < lead").select("c", "pos", "ta", "tb", "words")
    return own.unionByName(lent), base.select("c", (F.col("lead") + F.col("own")).alias("n"))


def prefixes(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(c, depth, fa, fb, pa, pb, words, ends)``: the names of every prefix and of the one before it; ``ends`` where it is the whole.

    Hashes are joined inside blocks of ``BLOCK`` turns first, then over a conversation's blocks.
    """
    block = Window.partitionBy("c", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hashed = turns.select(
        "c", "pos", "words", F.expr(f"pos div {BLOCK}").alias("block"),
        F.xxhash64("ta", "tb", "pos").alias("xa"), F.xxhash64("pos", "tb", F.lit(7), "ta").alias("xb"))
    inside = scratch.save(hashed.withColumn("_a", F.bit_xor("xa").over(block)).withColumn("_b", F.bit_xor("xb").over(block)), "inside")
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    whole = inside.filter(f"pos % {BLOCK} = {BLOCK} - 1").select("c", "block", "_a", "_b")  # a full block's last turn
    whole = scratch.save(whole.select(
        "c", (F.col("block") + 1).alias("block"), F.bit_xor("_a").over(earlier).alias("_ba"), F.bit_xor("_b").over(earlier).alias("_bb")), "blocks")
    named = inside.join(whole, ["c", "block"], "left").join(convs, "c").withColumn(
        "fa", F.expr("_a ^ coalesce(_ba, 0L)")).withColumn("fb", F.expr("_b ^ coalesce(_bb, 0L)"))
    return named.selectExpr("c", "pos + 1 AS depth", "fa", "fb", "fa ^ xa AS pa", "fb ^ xb AS pb", "words", "pos + 1 = n AS ends")


def _running(rows: DataFrame, total: int, values: list[str], scratch: Scratch) -> DataFrame:
    """Add ``_x`` for each value ``x``: its sum over all rows with a lower ``at``.

    ``at`` has all whole numbers below ``total``, so parts of equal length follow from it.
    """
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total))
    held = rows.withColumn("_p", F.expr(f"(at * {parts}L) div {max(total, 1)}L").cast("int"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    bases = scratch.save(held.groupBy("_p").agg(*[F.sum(v).alias(v) for v in values]).select(
        "_p", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values]), "bases")
    inside = Window.partitionBy("_p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumns({f"_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(F.broadcast(bases), "_p").withColumns(
        {f"_{v}": F.col(f"_{v}") + F.col(f"_base_{v}") for v in values})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, in order, as text."""
    node, ids = None, []

    def piece():
        return pa.record_batch([[node[0]], [node[1]], [ids[0]], [",".join(map(str, ids))]], names=["fa", "fb", "first", "ids"])

    for batch in batches:
        for fa, fb, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if ids and (node != (fa, fb) or len(ids) == PIECE_IDS):
                yield piece()
                ids = []
            node = (fa, fb)
            ids.append(c)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, joined by commas."""
    node, digest = None, None
    for batch in batches:
        done = []
        for fa, fb, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if node != (fa, fb):
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (fa, fb), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _digest_rows(done)
    if node is not None:
        yield _digest_rows([(*node, digest.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["fa", "fb", "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``(fa, fb, sha)`` over ``ends(fa, fb, c)``: the hash of a node's ids, ascending, joined by commas.

    A node's ids may fill any number of range partitions; their texts, one for ``PIECE_IDS`` ids, meet in one stream.
    """
    key = ["fa", "fb", "c"]
    pieces = ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(
        _pieces, "fa long, fb long, first long, ids string")
    key = ["fa", "fb", "first"]
    return pieces.repartition("fa", "fb").sortWithinPartitions(*key).mapInArrow(_digests, "fa long, fb long, sha string")


_ARCS = """
SELECT inline(array(
  named_struct('k', 2 * v, 'last', CASE WHEN up IS NULL THEN -1 WHEN v = up_first THEN 2 * up ELSE 2 * v - 1 END,
               'next', IF(n_children > 0, 2 * first, 2 * v + 1)),
  named_struct('k', 2 * v + 1, 'last', IF(n_children > 0, 2 * (first + n_children - 1) + 1, 2 * v),
               'next', CASE WHEN up IS NULL THEN -1 WHEN v < up_first + up_children - 1 THEN 2 * v + 2 ELSE 2 * up + 1 END)))
FROM {nodes}"""


def trie_nodes(turns: DataFrame, convs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """All nodes of the trie of ``turns(c, pos, ta, tb, words)`` of ``convs(c, n)``, places from 0 without gaps.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``; a node is named by its smallest
    member and its depth.
    """
    scratch = scratch or Scratch.of(convs.sparkSession)
    convs = scratch.save(convs, "convs")
    each = scratch.save(prefixes(turns, convs, scratch), "prefixes")
    nodes = each.groupBy("fa", "fb").agg(
        F.min("c").alias("conv_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").selectExpr(
        "0L AS fa", "0L AS fb", "conv_id", "0L AS depth", "n_convs", "0L AS words", "cast(null AS long) AS pa", "cast(null AS long) AS pb")
    # children of one parent get numbers in a row; the root, without a parent, comes first
    order = [F.col("pa").asc_nulls_first(), F.col("pb").asc_nulls_first(), F.col("conv_id")]
    nodes, seen = scratch.save(dense_rank(nodes.unionByName(root), order, "v", scratch, start=0), "nodes", n=F.count(F.lit(1)))
    kids = nodes.filter("pa IS NOT NULL").groupBy(F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(
        F.min("v").alias("first"), F.count(F.lit(1)).alias("n_children"))
    last = each.filter("ends").select("fa", "fb", "c").unionByName(convs.filter("n = 0").selectExpr("0L AS fa", "0L AS fb", "c"))
    held = nodes.join(kids, ["fa", "fb"], "left").join(end_digests(last), ["fa", "fb"], "left")
    held = scratch.save(held.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "held")
    above = held.filter("n_children > 0").selectExpr(
        "fa AS pa", "fb AS pb", "v AS up", "conv_id AS parent_conv_id", "first AS up_first", "n_children AS up_children")
    held = scratch.save(held.join(above, ["pa", "pb"], "left"), "tree")

    arcs = scratch.spark.sql(_ARCS, nodes=held)
    link = lambda c, side: F.when(F.col(c) < 0, OPEN).otherwise(2 * F.col(c) + side).cast("long")
    gap = lambda c: F.when(F.col(c) < 0, 1).otherwise(2).cast("long")
    elements = arcs.select(
        "k", link("last", 1).alias("pa"), gap("last").alias("ga"), link("next", 0).alias("pb"), gap("next").alias("gb"),
        F.lit(1).cast("long").alias("own"))
    places, _ = rank_chains(elements, scratch, 2 * seen["n"])
    ends = places.select(F.shiftright("k", 1).alias("v"), (F.col("k") % 2).alias("out"), start_of(F.lit(1)).alias("at")).groupBy("v").agg(
        F.max(F.expr("IF(out = 0, at, null)")).alias("enter"), F.max(F.expr("IF(out = 1, at, null)")).alias("leave"))
    # a node's columns travel with its enter arc; the exit arc only carries the place
    facts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    along = scratch.save(held.join(ends, "v").selectExpr(
        "v", *facts, "coalesce(sha, sha2('', 256)) AS ends_sha256", "enter", "leave",
        "IF(n_children = 0, 1L, 0L) AS leaves", "(n_convs - 1) * words AS saved"), "along")
    facts = [*facts, "ends_sha256"]
    points = along.withColumnRenamed("enter", "at").drop("leave").withColumn("out", F.lit(0)).unionByName(
        along.selectExpr("v", "leave AS at", "1 AS out", "0L AS leaves", "0L AS saved"), allowMissingColumns=True)
    sums = _running(points, 2 * seen["n"], ["leaves", "saved"], scratch)
    return sums.groupBy("v").agg(
        *[F.max(c).alias(c) for c in facts],
        *[F.sum(F.expr(f"IF(out = 1, _{v}, -_{v})")).alias(n) for v, n in (("leaves", "n_leaves"), ("saved", "saved_tokens"))]
    ).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand."""
    scratch = Scratch.of(conversations.sparkSession)
    turns, convs = numbered_turns(conversations, scratch)
    return trie_nodes(turns, convs, scratch)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt by ``shared_turns``."""
    scratch = Scratch.of(conversations.sparkSession)
    turns, convs = numbered_turns(conversations, scratch)
    return trie_nodes(*rebuilt_turns(turns, convs), scratch)
