"""Registered queries of the operators, each over its whole table, and their DuckDB statements.

The general operators live in their own modules; a query applies one with production parameters
and derives the digest columns of its result. Operators that SQL cannot express (trained models,
vocabularies, hashes DuckDB lacks, substring search) have no statement here and are tested against
brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, divergence, langid, linededup, packing, quality, simhash, suffix, tokens, topk, toxicity, warc,
               whitening)
from .common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"), min_bytes=0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), size=2048, end_id=0)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary(), limit=2048)


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks alone: a document that is not in the result is clean."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_report(table(spark, sf_dir, "documents"), span=400)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), min_docs=3, scale=1_000_000_000, terms=200)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_topk, op3_simhash, op4_warc, op5_packing, op6_langid, op7_tokens,
                                    op8_linededup, op9_decontam, op10_suffix, op11_whitening, op12_divergence,
                                    op13_quality)}


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# four base32 digits of each stretch of five hex digits
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(f"substr('{_BASE32}', CAST((v >> {s}) & 31 AS INTEGER) + 1, 1)" for s in (15, 10, 5, 0))

ORACLES = {
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    "op4_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(
        list_transform(range(8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT)), lambda v: {_DIGITS}), '') AS payload_digest
      FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to FROM m""",
    "op8_linededup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT r) AS n, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key),
m AS (SELECT k.*, coalesce(c.n >= 5 AND c.holder IS DISTINCT FROM k.doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""",
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT d.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS n FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN k USING (lang) GROUP BY d.lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS cnt, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (gn.n + l.v) AS p,
             1 + (1000000000 * (k.total + 1)) // (l.n + l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) JOIN gn ON gn.lang = g.lang AND gn.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE cnt > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 200""",
    "op13_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM d),
t AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT *, CASE WHEN count(*) OVER a = 5 THEN string_agg(word, ' ') OVER a END AS gram FROM t
      WINDOW a AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
f AS (SELECT r, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g),
h AS (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM f),
n AS (SELECT r, count(*) FILTER (WHERE covered) AS n_repeat_words FROM h GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, line, regexp_extract_all(line, '{WORD}') AS ws, array_to_string(regexp_extract_all(line, '{WORD}'), ' ') AS s FROM l
      WHERE regexp_matches(line, '{WORD}')),
b AS (SELECT r, line, strlen(line) AS bytes, length(replace(s, ' ', '')) AS chars, len(ws) AS k, s,
             len(regexp_extract_all(s, '[#*$%&|<>]')) AS symbols, len(list_filter(ws, lambda x: regexp_full_match(x, '{SEPARATOR}'))) AS separators
      FROM m),
j AS (SELECT r, line, chars,
             symbols > k
             OR (NOT regexp_matches(s, '{ENDS}') AND {PROSE} * len(regexp_extract_all(s, '{INNER}')) < k)
             OR 3 * len(regexp_extract_all(s, '{SHOUTS}')) > k
             OR (separators >= 2 AND 3 * separators >= k)
             OR (k <= {SHORT} AND regexp_matches(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BOILER}')) AS bad
      FROM b),
o AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost_chars,
             count(*) FILTER (WHERE bad) AS n_failed_lines FROM j GROUP BY r),
s AS (SELECT w.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_failed_lines, 0) AS n_failed_lines,
             CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
      FROM w LEFT JOIN n USING (r) LEFT JOIN o USING (r)),
z AS (SELECT * EXCLUDE (r), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM z""",
}


def _pattern(pattern: str) -> str:
    return pattern.replace("'", "''")


# the line rules are stated once, in the operator's module
for _name, _text in {"WORD": r"[^\x20\x09-\x0D]+", "SEPARATOR": quality.SEPARATOR, "ENDS": quality.ENDS, "INNER": quality.INNER,
                     "SHOUTS": quality.SHOUTS, "BOILER": quality.BOILERPLATE, "PROSE": str(quality.PROSE_WORDS),
                     "SHORT": str(quality.BOILERPLATE_WORDS)}.items():
    ORACLES["op13_quality"] = ORACLES["op13_quality"].replace("{" + _name + "}", _pattern(_text))


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
