"""The registered queries of the package, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm.best_fit import pack_documents
from sensorframe.llm.chat_format import format_chats, read_back
from sensorframe.llm.collocations import collocations
from sensorframe.llm.common import bare, table
from sensorframe.llm.exact_dedup import exact_dedup
from sensorframe.llm.html_extract import extract_pages
from sensorframe.llm.importance import importance_resample
from sensorframe.llm.line_dedup import dedup_report
from sensorframe.llm.ngram_join import ngram_join
from sensorframe.llm.piece_viterbi import round_trip
from sensorframe.llm.prefix_trie import numbered, prefix_trie, shared_openings
from sensorframe.llm.quality_rules import quality_rules
from sensorframe.llm.secret_scan import secret_scan
from sensorframe.llm.suffix_dedup import remove_repeats


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = bare(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]
    return read_back(format_chats(turns.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("class_id", "n_copies")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*shared_openings(numbered(table(spark, sf_dir, "conversations"))))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_ngram_join": op5_ngram_join,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_best_fit": op7_best_fit,
    "op8_importance": op8_importance,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM d),
w AS (SELECT doc_id, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l),
s AS (
  SELECT DISTINCT doc_id, no, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS token FROM w),
n AS (SELECT doc_id, no, count(*) AS n FROM s GROUP BY ALL),
pairs AS (
  SELECT a.doc_id AS da, a.no AS na, b.doc_id AS db, b.no AS nb, count(*) AS shared FROM s a JOIN s b ON a.token = b.token
    AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.no < b.no)) GROUP BY ALL),
late AS (
  SELECT DISTINCT db AS doc_id, nb AS no FROM pairs JOIN n x ON x.doc_id = da AND x.no = na JOIN n y ON y.doc_id = db AND y.no = nb
  WHERE 100 * shared >= 80 * (x.n + y.n - shared))
SELECT l.doc_id, count(*) AS n_lines, count(late.no) AS n_removed,
  coalesce(string_agg(CASE WHEN late.no IS NULL THEN line END, chr(10) ORDER BY l.no), '') AS text
FROM l LEFT JOIN late ON late.doc_id = l.doc_id AND late.no = l.no GROUP BY l.doc_id""",
    "op5_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.seen),
low AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents JOIN low ON low.node = doc_id LEFT JOIN n USING (doc_id)""",
    # These pages mark their article and use three character references, which SQL can follow.
    "op2_html_extract": r"""
WITH a AS (
  SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '<article>((?:.|\n)*?)</article>', 1), '<br>', ' ') AS body FROM pages),
b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:h1|p)>'),
    lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'),
      '[\x20\x09-\x0D]+', ' ', 'g'))) AS blocks FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c""",
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS no,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, count(*) AS n, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),
    4294967295::UBIGINT) % 4 AS h FROM t GROUP BY c),
r AS (
  SELECT h.c, no, 0 AS own, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 AND no < h
  UNION ALL SELECT h.c, no, 1, role, text FROM h JOIN t ON t.c = h.c AND no >= h),
d AS (
  SELECT c, row_number() OVER o AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER o AS prefix FROM r WINDOW o AS (PARTITION BY c ORDER BY own, no)),
p AS (SELECT c, depth, words, prefix FROM d UNION ALL SELECT c, 0, 0, '' FROM h),
e AS (SELECT c, max(depth) AS n FROM p GROUP BY c),
m AS (SELECT p.*, depth = n AS ends, min(p.c) OVER (PARTITION BY depth, prefix) AS owner FROM p JOIN e USING (c)),
v AS (
  SELECT owner, depth, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
    sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM m GROUP BY owner, depth),
up AS (SELECT v.owner, v.depth, m.owner AS parent FROM v JOIN m ON m.c = v.owner AND m.depth = v.depth - 1),
k AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
s AS (
  SELECT m.owner, m.depth, sum(v.saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM v LEFT JOIN k USING (owner, depth) JOIN m ON m.c = v.owner AND m.depth <= v.depth GROUP BY m.owner, m.depth)
SELECT v.owner AS conv_id, v.depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM v LEFT JOIN up USING (owner, depth) LEFT JOIN k USING (owner, depth) JOIN s USING (owner, depth)""",
    "op12_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT r, doc_id, b, octet_length(b) AS n FROM d),
w AS (
  SELECT r, p, md5(array_slice(b, p, p + 399)) AS h
  FROM (SELECT r, b, unnest(range(1, n - 398)) AS p FROM n WHERE n >= 400)),
hit AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS prev FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS uses FROM w) WHERE uses > 1),
runs AS (SELECT r, p, sum(CASE WHEN p <= prev + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit),
s AS (SELECT r, min(p) AS a, max(p) + 400 AS z FROM runs GROUP BY r, k),
g AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM s GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN g.r IS NULL THEN b ELSE list_reduce(list_transform(range(0, n_spans + 1),
    lambda i: array_slice(b, CASE WHEN i = 0 THEN 1 ELSE z[i] END, CASE WHEN i = n_spans THEN n ELSE a[i + 1] - 1 END)), lambda x, y: x || y) END) AS kept_sha256
FROM n LEFT JOIN g USING (r)""",
    "op13_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS no, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
x AS (SELECT lang, no, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM w),
y AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY no ORDER BY i)),
g AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM y UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM y WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM y WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 10),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
parts AS (
  SELECT lang, phrase, a, 1 AS cut, words[1] AS head, array_to_string(words[2:], ' ') AS tail FROM c
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(words[1:2], ' '), words[3] FROM c WHERE k = 3),
cut AS (
  SELECT parts.lang, parts.phrase, a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM parts JOIN f AS l ON l.lang = parts.lang AND l.phrase = head JOIN f AS r ON r.lang = parts.lang AND r.phrase = tail),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
}
