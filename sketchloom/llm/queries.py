"""The queries of this subpackage, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, langid, licenses, pitman_yor, quality, sharding, simhash, spm, urlfilter
from .common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(read(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return spm.encode_documents(docs, with_text=False)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_html_text, op3_license_scan, op4_sharding, op5_url_filter, op6_simhash, op7_lm_score, op8_sentencepiece, op9_decontaminate, op10_quality_rules)
    return {f.__name__: f for f in own}


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), judged AS (
  SELECT *,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(path, '/(WORDS)[/.]') OR regexp_matches(host || path, '^([^/]*[.])?(WORDS)[.][^/]*/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""".replace("WORDS", "|".join(urlfilter.BLOCKED_WORDS))

OP9_SQL = r"""
WITH item_words AS (
  SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), items AS (
  SELECT row_number() OVER () AS k, item_id, w, least(5, len(w)) AS width FROM item_words WHERE len(w) > 0
), item_shingles AS (
  SELECT DISTINCT k, width, array_to_string(w[i:i + width - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM items)
), sizes AS (SELECT k, count(*) AS n FROM item_shingles GROUP BY k
), doc_rows AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL
), docs AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM doc_rows
), places AS (
  SELECT d, doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, (SELECT DISTINCT width FROM items) x
), doc_shingles AS (
  SELECT DISTINCT d, doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s FROM places
), hits AS (
  SELECT d, doc_id, k, count(*) AS found FROM doc_shingles JOIN item_shingles USING (width, s) GROUP BY d, doc_id, k
)
SELECT DISTINCT doc_id, item_id, n AS n_shingles, found AS n_found, found / n AS containment
FROM hits JOIN sizes USING (k) JOIN items USING (k) WHERE 100 * found >= 80 * n
"""

OP10_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), windows AS (
  SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w
), keyed AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM windows
), again AS (
  SELECT r, g FROM keyed GROUP BY r, g HAVING count(*) > 1
), places AS (
  SELECT r, count(DISTINCT i + k) AS n FROM keyed JOIN again USING (r, g), range(0, 8) x(k) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), digest AS (
  SELECT doc_id, host, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(places.n, 0) AS n_repeat_words
  FROM w LEFT JOIN places USING (r) LEFT JOIN lines USING (r)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS noisy FROM digest
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR noisy) AS f FROM failed WHERE host IS NOT NULL GROUP BY host
), moments AS (
  SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS k FROM moments
), bad AS (
  SELECT host FROM hosts, prior WHERE (f + m * k) / (n + k) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT noisy AND (host IS NULL OR host NOT IN (SELECT host FROM bad)) AS kept
FROM failed
"""


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the operator; the others are tested in tests/llm."""
    return {"op5_url_filter": OP5_SQL, "op9_decontaminate": OP9_SQL, "op10_quality_rules": OP10_SQL}
