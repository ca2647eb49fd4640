"""One query per operator over its whole table, and the same result as SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphtrails.llm import decontam, fingerprints, hosts, jaccard, lines, packing, pages, periodic, quality, substrings, tokens, toxicity, tries

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: make(table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality": lambda spark, folder: quality.quality_scores(
            table(spark, folder, "documents"), table(spark, folder, "labels")),
        "op2_decontamination": lambda spark, folder: decontam.contamination_report(
            table(spark, folder, "documents"), table(spark, folder, "benchmark")),
        "op3_line_dedup": _documents(lines.line_digests),
        "op4_substring_dedup": _documents(substrings.substring_digests),
        "op5_fingerprints": _documents(fingerprints.fingerprint_report),
        "op6_html_extraction": lambda spark, folder: pages.page_texts(table(spark, folder, "pages")),
        "op7_url_reputation": lambda spark, folder: hosts.url_verdicts(
            table(spark, folder, "pages"), table(spark, folder, "documents"), table(spark, folder, "labels")),
        "op8_token_output": _documents(tokens.token_digests),
        "op9_jaccard_join": _documents(jaccard.jaccard_classes),
        "op10_packing": _documents(packing.packing_report),
        "op11_toxicity": lambda spark, folder: toxicity.toxicity_scores(
            table(spark, folder, "documents"), table(spark, folder, "labels")),
        "op12_conversation_trie": lambda spark, folder: tries.rebuilt_trie(table(spark, folder, "conversations")),
        "op13_periodic_runs": _documents(periodic.run_report),
    }


_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keys AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE often.key IS NOT NULL) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
  FROM keys LEFT JOIN often USING (key) GROUP BY doc_id
)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM kept
"""

_SUBSTRING_DEDUP = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35)
), twice AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM windows SEMI JOIN twice USING (h)
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT each.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL), '') AS kept
  FROM each LEFT JOIN gone USING (doc_id, p) GROUP BY each.doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


_DECONTAMINATION = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM windows
), places AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS x
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM words, sizes WHERE len(w) >= k)
), found AS (
  SELECT doc_id, item_id, s, k FROM places JOIN windows USING (k, x)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS s FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS d, a AS r FROM ways UNION SELECT reach.d, ways.b FROM reach JOIN ways ON ways.a = reach.r
), least AS (
  SELECT d AS doc_id, min(r) AS r FROM reach GROUP BY d
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, documents.doc_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

# A checksum of a decimal number's digits, bit by bit: a digit is taken in, then eight marks of -1 shift it out.
_CONVERSATION_TRIE = r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, n, c - c % 20 AS b, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
    lambda x: list_concat([CAST(ascii(x) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c)
), lead AS (
  SELECT convs.c, convs.b, convs.h, least(convs.h, coalesce(k.n, 0)) AS lead FROM convs LEFT JOIN convs k ON k.c = convs.b
), built AS (
  SELECT lead.c, pos, role, text FROM lead JOIN turns ON turns.c = lead.b WHERE pos < lead
  UNION ALL
  SELECT lead.c, pos - h + lead, role, text FROM lead JOIN turns ON turns.c = lead.c WHERE pos >= h
), prefixes AS (
  SELECT c, pos + 1 AS depth, text, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY pos)) AS id FROM built
), named AS (
  SELECT *, lag(id, 1, '') OVER (PARTITION BY c ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY c) AS last FROM prefixes
  UNION ALL
  SELECT lead.c, 0, '', '', NULL, NOT EXISTS (SELECT 1 FROM built WHERE built.c = lead.c) FROM lead
), nodes AS (
  SELECT id, min(c) AS conv_id, max(depth) AS depth, max(up) AS up, count(*) AS n_convs,
         (count(*) - 1) * len(regexp_extract_all(max(text), '[^\x20\x09-\x0D]+')) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM named GROUP BY id
), kids AS (
  SELECT up AS id, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT named.id, sum(saved) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM nodes JOIN named ON named.c = nodes.conv_id AND named.depth <= nodes.depth LEFT JOIN kids ON kids.id = nodes.id GROUP BY named.id
)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children,
       below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN below ON below.id = nodes.id LEFT JOIN kids ON kids.id = nodes.id LEFT JOIN nodes up ON up.id = nodes.up
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_conversation_trie": _CONVERSATION_TRIE,
        "op2_decontamination": _DECONTAMINATION,
        "op3_line_dedup": _LINE_DEDUP,
        "op4_substring_dedup": _SUBSTRING_DEDUP,
        "op9_jaccard_join": _JACCARD_JOIN,
    }
