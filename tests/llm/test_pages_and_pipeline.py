"""Page operators against plain Python, and the pipeline stage by stage."""

import html
import math
import re
import time
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from graphtrails.llm import hosts, jaccard, lines, decontam, pages, queries

FOLDER = "/root/testdata/sf0.01"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- op6 -----------------------------------------------------------------------------------------


def article(page):
    """Text of the test pages, whose content is marked."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
    clean = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def test_page_texts(spark):
    source = queries.table(spark, FOLDER, "pages")
    want = Counter((r.page_id, r.url, article(r.html), len(article(r.html))) for r in source.collect())
    assert rows_of(pages.page_texts(source)) == want


WEIGHTS = {"#p": 4.0, "#": 1.0, "#b": 4.0, "#h1": 4.0, "#a": -2.0, "#li": -2.0, "p": -0.01, "b": -0.01, "h1": -0.01, "article": -0.01, "div": -1.0, "a": -1.0, "li": -1.0}


@pytest.mark.parametrize("page,want", [
    ("", ""), ("<p>a", "a"), ("<nav><p>menu of it<article><p>the text</article>", "the text"),
    ("<article><h1>T &amp; t</h1><p>one<p>two <b>three</b>\n four<br>five<div class='comments'><p>no</p></div><p>end.</article><footer>f", "T & t\none\ntwo three four five\nend."),
    ("<script>if (a < b) '</p>'</script><style>p{}</style><p>kept</p><!-- <p>not</p> --><p>too &lt;b&gt;&nbsp;x</p>", "kept\ntoo <b> x"),
    ("<p title='a>b' data-x=\"<p>\">quoted</p>", "quoted"), ("<p>open <b>never closed", "open never closed"), ("a < b and c", "a < b and c"),
    ("<form><p>field</p></form><div id=sidebar><p>s</p></div><div role='navigation'>n</div>", ""), ("<script>never ends", ""), ("<p hidden>h</p><p>v</p>", "v"),
])
def test_main_text(page, want):
    assert pages.main_text(page, WEIGHTS) == want


@pytest.mark.parametrize("page,want", [
    ('<div style="overflow:hidden"><p>a</p></div>', "a"), ('<p title="the hidden cost">a</p>', "a"), ("<p data-hidden>a</p><p data-class=ad>b</p>", "a\nb"),
    ('<p title="x" HIDDEN>a</p><p aria-hidden=true>b</p><p title="> hidden" Class=\'x AD\'>c</p>', ""),
    ('<div class="content with-sidebar"><p>a</p></div>', "a"), ('<div class="has-sidebar" id=no-comments><p>a</p></div>', "a"),
    ('<div class="entry-header"><h1>a</h1></div><div class="x sidebar"><p>b</p></div><ol class="comment-list"><p>c</p></ol>', "a"),
    ("<p>a</p><svg/><math /><p>b</p>", "a\nb"), ("<p>a</p><iframe src='x'/><p>b</p><iframe/><p>c</p>", "a\nb\nc"),
    ("<p>a</p><svg width='1'/><p>b</p><svg><p>c</p></svg>", "a\nb"), ("<p>a</p><iframe src=x/><p>b</p></iframe><p>c</p>", "a\nc"),
    ("<article><p>a</p></article><div class=comments><article><p>b</p></article><p>c</p></div><p>d</p>", "a\nd"),
    ("<aside><article><p>a</p></article></aside><div class=ad><div><article><p>b</p></article></div></div><article><p>c</p></article>", "c"),
    ("<div class=overlay><ul class='x comments'><article><p>a</p></article></ul><article><p>b</p></article></div>", "b"),
    ("<body><div class=ad>x<article><p>a</p></article></body>", "a"), ("<aside><main><p>a</p></main></aside>", "a"),
])
def test_main_text_of_attributes_and_articles(page, want):
    assert pages.main_text(page, WEIGHTS) == want


def test_main_text_of_hostile_pages_in_time():
    began = time.monotonic()
    for page in ("<svg/><iframe/>" * 50_000, "<aside><article>" * 2_000, "<p " + "a = '" * 20_000 + ">", "<div " + " " * 50_000 + "x", "<p a" + " " * 20_000 + ">x"):
        pages.main_text(page, WEIGHTS)
    assert time.monotonic() - began < 20


def test_main_text_of_hostile_pages():
    for page in ("<" * 20_000, "<p " + "a'" * 20_000, "<!--" * 5_000, "<b>" * 3_000 + "x", "&#x110000;&#0;&bogus; x", "<p a=\"" + "b" * 50_000):
        pages.main_text(page, WEIGHTS)


def test_best_region():
    assert pages.best_region([]) == (0, 0) == pages.best_region([-1.0, 0.0])
    assert pages.best_region([1, -5, 3, -1, 4, -9, 5]) == (2, 5)


def test_page_texts_of_odd_rows(spark):
    rows = [(1, None, None, 1), (None, "u", "", 2), (2, "u", "<p>x</p>", 3), (2, "u", "<p>x</p>", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert rows_of(pages.page_texts(df)) == Counter([(1, None, "", 0), (None, "u", "", 0), (2, "u", "x", 1), (2, "u", "x", 1)])
    assert pages.page_texts(df.limit(0)).count() == 0


# --- op7 -----------------------------------------------------------------------------------------


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def plain_verdicts(rows, outcomes):
    """``rows(page_id, url)`` and ``outcomes(host, good)`` to the query's rows."""
    n, good = defaultdict(Counter), defaultdict(Counter)
    levels = lambda h: (h, ".".join(h.split(".")[-2:]), h.split(".")[-1])
    for host, g in outcomes:
        for level, name in enumerate(levels(host)):
            n[level][name] += 1
            good[level][name] += g
    total, sums = len(outcomes), sum(g for _, g in outcomes)
    out = []
    for page_id, url in rows:
        host, path = split(url)
        mean = (sums + 1) / (total + 2)
        for level in (2, 1, 0):
            name = levels(host)[level]
            mean = (good[level][name] + hosts.STRENGTH * mean) / (n[level][name] + hosts.STRENGTH)
        bound = mean + hosts.BOUND * math.sqrt(mean * (1 - mean) / (n[0][host] + hosts.STRENGTH + 1))
        rule = verdict = None
        for v, h, p in hosts.RULES:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (rule is None or len(h + p) > len(rule)):
                rule, verdict = h + p, v
        out.append((page_id, host, path, rule, verdict or ("allow" if bound >= hosts.LEAST else "block"), round(mean, 9), round(bound, 9)))
    return Counter(out)


def test_url_verdicts(spark):
    source, docs, labels = (queries.table(spark, FOLDER, t) for t in ("pages", "documents", "labels"))
    bare = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", "", t or "")
    marks = {r.doc_id: r.quality * (1 - (r.toxic or 0)) for r in labels.collect() if r.quality is not None}
    known = defaultdict(list)
    for r in docs.collect():
        if r.doc_id in marks:
            known[bare(r.text)].append(marks[r.doc_id])
    outcomes, rows = [], []
    for r in source.collect():
        text = article(r.html)
        values = [sum(v) / len(v) for v in (known.get(x) for x in {bare(text), bare(text[text.find("\n") + 1:])}) if v]
        if values:
            outcomes.append((split(r.url)[0], sum(values) / len(values)))
        rows.append((r.page_id, r.url))
    assert len(outcomes) > 20
    got = Counter((*tuple(r)[:5], round(r["mean"], 9), round(r["bound"], 9)) for r in hosts.url_verdicts(source, docs, labels).collect())
    assert got == plain_verdicts(rows, outcomes)


def test_url_rules_of_odd_rows(spark):
    urls = [
        None, "", "no scheme", "HTTP://EXAMPLE.NET/en/X?q=/de/", "http://badexample.net/en/", "https://a.b.org/fr/1#x/", "http://org/fr/", "ftp://example.com/de",
        "http://x.example.com/de/y", "http://example.com?/de/", "http://", "http:///en/", "http://ÉX.Net#top", "x://net/", "a://b://c/d",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3]), (None, urls[8])]
    df = spark.createDataFrame([(i, u, None, "h", 0.5) for i, u in rows], "page_id long, url string, html string, host string, mean double")
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Counter((*tuple(r)[:5], round(r["mean"], 9), round(r["bound"], 9)) for r in hosts.url_verdicts(df, docs, labels).collect())
    assert got == plain_verdicts(rows, [])
    assert hosts.url_verdicts(df.limit(0), docs, labels).count() == 0


# --- the pipeline --------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs, after
        docs = after
    for name, (before, after) in seen.items():
        if name != "packing":
            assert after.columns == before.columns
    before, after = seen["quality_classifier"]
    truth = {r.doc_id: r.quality for r in queries.table(spark, "/root/testdata/sf0.001", "labels").collect()}
    ids = {r.doc_id for r in after.collect()}
    good = [i for i, q in truth.items() if q == 1]
    assert sum(i in ids for i in good) >= 0.97 * len(good) and after.count() < before.count()
    before, after = seen["line_dedup"]
    kept = {r.doc_id: r.kept for r in lines.drop_lines(before).collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, t in kept.items()}
    before, after = seen["jaccard_join"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(
        r.doc_id for r in jaccard.jaccard_classes(before).collect() if r.doc_id == r.component_id)
    before, after = seen["decontamination"]
    bad = {r.doc_id for r in decontam.contamination_report(before, queries.table(spark, "/root/testdata/sf0.001", "benchmark")).collect() if r.contaminated}
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id not in bad)
    before, after = seen["packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, folder)
            assert out.columns == table.columns
            assert out.count() <= table.count()


def test_every_kind_of_token_has_a_weight(spark):
    """A name of any length is looked up as it was counted, and more than 500 names have weights of their own."""
    long = "x-" + "y" * 60
    names = [long, *(f"x-{i}" for i in range(700))]
    inside = "".join(f"<{n}>word word word</{n}>" for n in names)
    rows = [(i, f"<html><body><div>menu</div><article>{inside}</article></body></html>") for i in range(3)]
    weights = pages.learn(spark.createDataFrame(rows, "page_id long, html string"))
    kinds = {k for _, html in rows for k, _, _, _ in pages.tokens(html)} - {"#br"}
    assert set(weights) == kinds and len(kinds) > 700
    assert pages.main_text(f"<body><{long}>one two</{long}></body>", weights) == "one two"
