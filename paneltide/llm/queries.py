"""Registered queries of the training-data operators (thin: each reads its whole table,
applies its operator with production parameters and derives the result columns)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, decontaminate, embedding_dedup, filter_audit, html_text, jaccard_join, language_id, line_templates, pseudonyms, quality_rules, substring_dedup, suffix_dedup
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


@_query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_join.jaccard_components(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")


@_query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = language_id.fold("doc_id")
    model = language_id.fit(docs, remainder != 1)
    marked = language_id.predict(docs.select("doc_id", "text"), model)
    return marked.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


OP7_SQL = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS li, len(p) AS nl FROM parts),
placed AS (
  SELECT *, length(line) + CASE WHEN li < nl THEN 1 ELSE 0 END AS width,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY li) - length(line) - 1 AS start FROM lines),
cut AS (SELECT *, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, '.*?[.!?][ \t]+|.+') END AS s FROM placed),
sents AS (SELECT doc_id, li, nl, start AS line_start, unnest(s) AS unit, unnest(range(1, len(s) + 1)) AS si, len(s) AS ns FROM cut),
spots AS (
  SELECT *, length(unit) + CASE WHEN si = ns AND li < nl THEN 1 ELSE 0 END AS width,
         line_start + sum(length(unit)) OVER (PARTITION BY doc_id, li ORDER BY si) - length(unit) AS start FROM sents),
every AS (
  SELECT doc_id, start, trim(regexp_replace(lower(line), '[ \t\n\r\f\v]+', ' ', 'g')) AS norm FROM placed
  UNION ALL SELECT doc_id, start, trim(regexp_replace(lower(unit), '[ \t\n\r\f\v]+', ' ', 'g')) FROM spots),
first AS (SELECT norm, min(struct_pack(d := doc_id, s := start)) AS f FROM every WHERE len(string_split(norm, ' ')) >= 6 GROUP BY norm),
gone_lines AS (
  SELECT p.doc_id, p.li, true AS g FROM placed p JOIN first ON first.norm = trim(regexp_replace(lower(p.line), '[ \t\n\r\f\v]+', ' ', 'g'))
  WHERE struct_pack(d := p.doc_id, s := p.start) <> first.f),
marked AS (
  SELECT t.*, coalesce(g.g, false) OR coalesce(struct_pack(d := t.doc_id, s := t.start) <> first.f, false) AS gone FROM spots t
  LEFT JOIN first ON first.norm = trim(regexp_replace(lower(t.unit), '[ \t\n\r\f\v]+', ' ', 'g'))
  LEFT JOIN gone_lines g ON g.doc_id = t.doc_id AND g.li = t.li),
kept AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(sum(width) FILTER (WHERE gone), 0)::BIGINT AS chars_removed,
         coalesce(string_agg(unit || CASE WHEN si = ns AND li < nl THEN chr(10) ELSE '' END, '' ORDER BY li, si) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(chars_removed, 0) AS chars_removed, sha256(kept) AS kept_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN kept USING (doc_id)
"""


@_query("op7_substring_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_units(table(spark, sf_dir, "documents"))
    spans = F.coalesce("removed", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    return out.select(
        "doc_id", "n_units", "n_removed",
        F.aggregate(spans, F.lit(0).cast("bigint"), lambda t, s: t + s["stop"] - s["start"]).alias("chars_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


#: The key of the registered query; a user passes a secret of their own.
PSEUDONYM_KEY = "paneltide-example-key"


@_query("op9_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)
    return out.select(
        "doc_id", F.size("found").cast("bigint").alias("n_found"),
        F.size(F.filter("found", lambda f: f["valid"])).cast("bigint").alias("n_replaced"), "text", "found",
    )


OP3_SQL = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
raw AS (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) - 1 AS idx FROM parts),
toks AS (SELECT doc_id, idx, list_transform(regexp_extract_all(line, '[^ \t\n\r\f\v]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM raw),
lines AS (SELECT doc_id, idx, t, len(t) AS width, (len(t), list_slice(t, 1, 4)) AS leaf, array_to_string(t, ' ') AS line FROM toks WHERE len(list_filter(t, lambda x: x <> '<*>')) > 0),
distinct_lines AS (SELECT leaf, line, any_value(t) AS t, any_value(width) AS width, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY leaf, line),
leaves AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
several AS (SELECT leaf FROM distinct_lines SEMI JOIN leaves USING (leaf) GROUP BY leaf HAVING count(*) > 1),
tokens AS (SELECT leaf, line, n_docs, width, unnest(t) AS token, unnest(range(0, width)) AS pos FROM distinct_lines SEMI JOIN several USING (leaf)),
late AS (SELECT * FROM tokens WHERE pos >= least(4, width - 1)),
votes AS (SELECT leaf, pos, token, sum(n_docs) AS v FROM late GROUP BY leaf, pos, token),
modal AS (SELECT leaf, pos, token FROM votes QUALIFY row_number() OVER (PARTITION BY leaf, pos ORDER BY v DESC, token) = 1),
matched AS (
  SELECT leaf, line FROM late JOIN modal USING (leaf, pos, token) GROUP BY leaf, line
  HAVING (count(*) + least(4, max(width) - 1)) * 100 >= 70 * max(width)),
members AS (SELECT doc_id, idx, leaf FROM lines SEMI JOIN matched USING (leaf, line)),
general AS (SELECT leaf FROM members GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
by_leaf AS (SELECT doc_id, idx FROM members SEMI JOIN general USING (leaf) QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY doc_id, idx) > 1),
exact AS (SELECT leaf, line FROM distinct_lines WHERE n_docs >= 10),
by_line AS (SELECT doc_id, idx FROM lines SEMI JOIN exact USING (leaf, line) QUALIFY row_number() OVER (PARTITION BY leaf, line ORDER BY doc_id, idx) > 1),
origins AS (SELECT leaf, line, min(doc_id) AS origin FROM lines GROUP BY leaf, line),
old AS (SELECT doc_id, idx, width, doc_id > origin AS again FROM lines JOIN origins USING (leaf, line)),
copies AS (SELECT doc_id FROM old GROUP BY doc_id HAVING coalesce(sum(width) FILTER (WHERE again), 0) * 100 >= CASE WHEN count(*) FILTER (WHERE again) > 1 THEN 35 ELSE 80 END * sum(width)),
by_length AS (SELECT doc_id, idx FROM old ANTI JOIN copies USING (doc_id) WHERE again AND width >= 50),
gone AS (SELECT doc_id, idx, true AS gone FROM (SELECT * FROM by_leaf UNION SELECT * FROM by_line UNION SELECT * FROM by_length)),
out AS (
  SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE gone IS NULL), '') AS kept
  FROM raw LEFT JOIN gone USING (doc_id, idx) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept, text)) AS kept_sha256
FROM documents d LEFT JOIN out USING (doc_id)
"""


@_query("op3_line_templates", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_templates.drop_templates(docs, line_templates.recurring_lines(docs, min_tokens=1), "n_lines", "n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` encoded by the 50k byte-level vocabulary, with digests of ids and bytes."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(spark, table(spark, sf_dir, "documents"))


@_query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@_query("op8_embedding_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


@_query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("bigint"), lambda t, s: t + s["stop"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


OP12_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D,
         coalesce(docs.doc_id > first, false) AS E, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM docs JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = docs.doc_id),
grouped AS (SELECT part, A, B, C, D, E, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step::INT, 1) AS f, substr(filter_order, 1, (step - 1)::INT) AS before FROM orders, range(1, 6) r(step)),
failed AS (
  SELECT g.*, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END)
              || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS fails FROM grouped g),
placed AS (
  SELECT s.filter_order, s.step, s.f, p.*, contains(fails, s.f) AS hit,
         regexp_matches(fails, '[' || s.before || '-]') AS gone
  FROM steps s, failed p),
out AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = f), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM out
"""


@_query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = filter_audit.csr_shards(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.failures(shards), table(spark, sf_dir, "labels"))

OP13_SQL = """
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+') AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
tri AS (
  SELECT doc_id, i, [word, lead(word, 1) OVER p, lead(word, 2) OVER p] AS win, lead(word, 2) OVER p IS NOT NULL AS whole FROM placed
  WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, win FROM tri WHERE whole GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM tri JOIN twice USING (doc_id, win), (SELECT unnest([0, 1, 2]) AS k) WHERE whole),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
again AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^ \t\n\r\f\v]') GROUP BY doc_id, line) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, lang, t, len(w) AS n_words, length(regexp_replace(t, '[ \t\n\r\f\v]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(again.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM d LEFT JOIN again USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
counts AS (
  SELECT doc_id, lang, n_words, length(t) AS n, length(regexp_replace(t, '[^\\p{Lu}\\p{Lt}]', '', 'g')) AS c1, length(regexp_replace(t, '[^\\p{L}\\p{M}]', '', 'g')) AS cl,
         length(regexp_replace(t, '[^\\p{N}]', '', 'g')) AS c2, length(regexp_replace(t, '[^ \t\n\r\f\v]', '', 'g')) AS c3,
         length(regexp_replace(t, '[^.,;:!?''"()-]', '', 'g')) AS c4 FROM base),
kinds AS (SELECT doc_id, lang, n_words, n, unnest([0, 1, 2, 3, 4, 5]) AS k, unnest([cl - c1, c1, c2, c3, c4, n - cl - c2 - c3 - c4]) AS c FROM counts),
ref_kinds AS (SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM kinds WHERE n_words >= 100 AND lang IS NOT NULL GROUP BY lang, k),
bags AS (SELECT doc_id, trim(lower(word), '.,;:!?''"()-') AS word, count(*) AS c FROM placed GROUP BY ALL),
taught AS (SELECT b.lang, word, sum(c) AS c FROM bags JOIN base b USING (doc_id) WHERE n_words >= 100 AND lang IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(c) AS total FROM taught GROUP BY lang),
common AS (
  SELECT lang, word, c / total AS q FROM taught JOIN totals USING (lang) WHERE regexp_matches(word, '\\p{L}')
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) <= 100),
rest AS (SELECT lang, 1 - sum(q) AS q FROM common GROUP BY lang),
pairs AS (
  SELECT doc_id, r.lang AS ref, n_words FROM base b JOIN totals r ON b.lang = r.lang OR b.lang IS NULL OR b.lang NOT IN (SELECT lang FROM totals)),
hits AS (SELECT p.doc_id, ref, c / n_words AS p, q FROM pairs p JOIN bags USING (doc_id) JOIN common r ON r.lang = ref AND r.word = bags.word),
left_over AS (SELECT p.doc_id, p.ref, 1 - coalesce(sum(h.p), 0) AS p FROM pairs p LEFT JOIN hits h USING (doc_id, ref) GROUP BY ALL),
bins AS (SELECT * FROM hits UNION ALL SELECT doc_id, ref, p, q FROM left_over l JOIN rest ON rest.lang = ref),
by_word AS (
  SELECT doc_id, ref, sqrt(greatest((sum(CASE WHEN p > 1e-12 THEN p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q)) ELSE 0 END)
                           + 1 - sum(CASE WHEN p > 1e-12 THEN q ELSE 0 END)) / 2, 0)) AS x
  FROM bins JOIN base USING (doc_id) WHERE n_words > 0 GROUP BY doc_id, ref),
by_kind AS (
  SELECT k.doc_id, r.lang AS ref,
         sqrt(greatest((sum(CASE WHEN c > 0 THEN c / n * log2(2 * (c / n) / (c / n + q)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(2 * q / (c / n + q)) ELSE 0 END)) / 2, 0)) AS x
  FROM kinds k JOIN pairs p USING (doc_id) JOIN ref_kinds r ON r.lang = p.ref AND r.k = k.k WHERE n > 0 GROUP BY ALL),
nearest AS (
  SELECT doc_id, by_kind.x AS char_distance, by_word.x AS word_distance FROM by_kind JOIN by_word USING (doc_id, ref)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY by_kind.x + by_word.x, ref) = 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (length(t) >= 200 AND coalesce(char_distance, 0) > 0.25)
       AND NOT (n_words >= 100 AND coalesce(word_distance, 0) > 0.12 + sqrt(101 / (8 * greatest(n_words, 1) * ln(2)))) AS kept
FROM judged LEFT JOIN nearest USING (doc_id)
"""


@_query("op13_quality_rules", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

OP11_SQL = """
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (  -- CRC-32, bit by bit
  SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS m
  FROM (SELECT DISTINCT k FROM src)),
hurt AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src JOIN coded USING (k) WHERE m <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t\n\r\f\v]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][ \t\n\r\f\v]*$') THEN 't' ELSE '' END AS fault,
         substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
steps AS (  -- cheapest (cost, audit) and its text of each output so far: nothing yet, s, ..u, ..a
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS s0, {'c': 1000000::BIGINT, 'a': '', 't': ''} AS s1,
         {'c': 1000000::BIGINT, 'a': '', 't': ''} AS s2, {'c': 1000000::BIGINT, 'a': '', 't': ''} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, {'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t},
    least({'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + cut + CASE WHEN r = 's' THEN 0 ELSE 1000000 END, 'a': s0.a || 'K', 't': s0.t || chr(10) || role || ':' || text}),
    least({'c': u.c + 3, 'a': u.a || 'D', 't': u.t}, {'c': w.c + cut + CASE WHEN r = 'u' THEN 0 ELSE 1000000 END, 'a': w.a || 'K', 't': w.t || chr(10) || role || ':' || text},
          {'c': w.c + cut + 2, 'a': w.a || 'R', 't': w.t || chr(10) || 'user:' || text}),
    least({'c': a.c + 3, 'a': a.a || 'D', 't': a.t}, {'c': u.c + cut + CASE WHEN r = 'a' THEN 0 ELSE 1000000 END, 'a': u.a || 'K', 't': u.t || chr(10) || role || ':' || text},
          {'c': u.c + cut + 2, 'a': u.a || 'R', 't': u.t || chr(10) || 'assistant:' || text})
  FROM (
    SELECT *, least(s0, s1, a) AS w FROM (
      SELECT *, least(s3, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}) AS a FROM (
        SELECT s.conv_id, f.i, role, text, f.r, CASE WHEN fault IN ('b', 'd') THEN 1000000 WHEN fault = 't' THEN 1 ELSE 0 END AS cut, s0, s1, s3,
               least(s2, {'c': least(s0, s1, s3).c + 2, 'a': least(s0, s1, s3).a || 'I', 't': least(s0, s1, s3).t || chr(10) || 'user:'}) AS u
        FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)))),
ends AS (
  SELECT s.conv_id, least(s0, s3, {'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
                          {'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS e
  FROM steps s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.n)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@_query("op11_conversation_repair", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_report(damaged, copies="copies")
