"""URL filter with rules and an empirical-Bayes reputation of hosts.

Labelled outcomes of pages (good or not) are counted per host, per registered domain and per suffix. The
share of good pages has a beta prior at every level: the suffix is shrunk to all pages, the domain to its suffix,
the host to its domain, each with the strength of ``STRENGTH`` pages, a fixed number at all levels: only the means are
estimated. A url passes where the upper bound of the host's posterior, mean plus ``BOUND`` standard deviations, reaches
``LEAST``. A host without labels has the mean of its domain, suffix or all pages, so it is blocked where that is below
about 0.45. Rules go first: the longest one that fits decides.

A page is labelled when its main text, with or without its first block (a title), is that of a labelled
document, white space aside. It is good when its quality is 1 and
it is not toxic. Of several labels of one text the mean counts.

Null urls, and those without ``://``, have an empty host and path, fit no rule, and get the reputation of all pages.
Rows that repeat a ``page_id`` stay. The registered domain is the last two labels of a host, the suffix its last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphtrails.llm.pages import page_texts
from graphtrails.scratch import Scratch

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
STRENGTH = 10.0
BOUND = 2.0
LEAST = 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_urls(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    found = F.expr("coalesce(instr(url, '://'), 0)")
    rest = F.when(found > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rows = pages.withColumn("_rest", F.substring_index(F.substring_index(rest, "?", 1), "#", 1))
    path = F.when(F.instr(F.col("_rest"), "/") > 0, F.expr("substring(_rest, instr(_rest, '/'))")).otherwise(F.lit(""))
    return rows.withColumn("host", F.translate(F.substring_index("_rest", "/", 1), _UPPER, _LOWER)).withColumn("path", path).drop("_rest")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one. Equal lengths: the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(range(len(rules)), key=lambda i: (len(rules[i][1] + rules[i][2]), -i))
    for i in order:  # later ones go before
        what, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _digest(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    return F.xxhash64(bare, F.length(bare))


def page_outcomes(texts: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(page_id, host, good)``: pages whose text is a labelled document's, with the share of good labels.

    The text may begin with a title that the document lacks. Only hashes of texts move.
    """
    marks = labels.filter("quality IS NOT NULL").select(
        "doc_id", (F.col("quality") * (1 - F.coalesce("toxic", F.lit(0)))).cast("double").alias("good"))
    known = docs.select("doc_id", _digest(F.col("text")).alias("_d")).join(marks, "doc_id").groupBy("_d").agg(F.avg("good").alias("good"))
    body = F.expr("substring(text, instr(text, '\n') + 1)")  # the text itself where it has one block only
    marked = texts.select("page_id", "host", F.explode(F.array_distinct(F.array(_digest(F.col("text")), _digest(body)))).alias("_d"))
    return marked.join(known, "_d").groupBy("page_id", "host").agg(F.avg("good").alias("good"))


def _levels(host: Column) -> tuple[Column, Column]:
    parts = F.split(host, "\\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."), F.element_at(parts, -1)


def reputations(outcomes: DataFrame, hosts: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """``(host, good, n, mean, deviation)`` of every host of ``hosts``: the posterior after all shrinking."""
    domain, suffix = _levels(F.col("host"))
    # counts per host first; the levels above sum these, so a hot host is one row
    counted = outcomes.groupBy("host").agg(F.sum("good").alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    every = hosts.select("host").distinct().join(counted, "host", "left").na.fill(0.0, ["good", "n"])
    every = every.withColumn("domain", domain).withColumn("suffix", suffix)
    up = every.groupBy("domain", "suffix").agg(F.sum("good").alias("d_good"), F.sum("n").alias("d_n"))
    top = up.groupBy("suffix").agg(F.sum("d_good").alias("s_good"), F.sum("d_n").alias("s_n"))
    whole = counted.agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("g"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    prior = (whole["g"] + 1.0) / (whole["n"] + 2.0)
    mean = lambda good, n, above: (F.col(good) + strength * above) / (F.col(n) + strength)
    joined = every.join(up, ["domain", "suffix"]).join(top, "suffix")
    joined = joined.withColumn("s_mean", mean("s_good", "s_n", F.lit(prior)))
    joined = joined.withColumn("d_mean", mean("d_good", "d_n", F.col("s_mean")))
    joined = joined.withColumn("mean", mean("good", "n", F.col("d_mean")))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1.0))
    return joined.select("host", "good", "n", "mean", deviation.alias("deviation"))


def url_verdicts(pages: DataFrame, docs: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, mean, bound)`` of every page."""
    scratch = Scratch.of(pages.sparkSession)
    urls = split_urls(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    texts = split_urls(page_texts(pages)).select("page_id", "host", "text")
    outcomes = scratch.save(page_outcomes(texts, docs, labels), "outcomes")
    known = scratch.save(reputations(outcomes, urls), "reputations")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    upper = F.col("mean") + BOUND * F.col("deviation")
    return urls.join(known.select("host", "mean", "deviation"), "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(upper >= LEAST, "allow").otherwise("block")).alias("verdict"), "mean", upper.alias("bound"))
