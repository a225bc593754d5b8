"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import (
    audit,
    decontam,
    html,
    importance,
    languages,
    licenses,
    lines,
    neardup,
    perplexity,
    pieces,
    secrets,
    simhash,
    urls,
)
from eventloom.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"), vocabulary())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.report(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.report(table(spark, sf_dir, "documents"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"), min_words=1)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secrets, op2_html_extraction, op3_near_duplicates, op4_sentencepiece,
        op5_language_id, op6_decontamination, op7_url_filter, op8_licenses, op9_quality_rules,
        op10_fuzzy_lines, op11_importance_resampling, op12_simhash_groups, op13_filter_audit)
}

OP6 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS k,
               unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
spots AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
found AS (SELECT r, i, s.k, item FROM spots s JOIN wins USING (k, win)),
hits AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item)) AS ids FROM found GROUP BY r),
spans AS (
  SELECT DISTINCT item, k, w[i:i + k - 1] AS win
  FROM (SELECT item, w, least(len(w), 10) AS k,
               unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM items WHERE len(w) > 0)),
places AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
counted AS (SELECT word, count(*) AS n FROM places GROUP BY word),
anchors AS (
  SELECT item, k, win, arg_min(j, n) AS j
  FROM (SELECT item, k, win, unnest(win) AS word, unnest(range(1, k + 1)) AS j FROM spans)
  JOIN counted USING (word) GROUP BY item, k, win HAVING count(*) = k),
begun AS (
  SELECT DISTINCT r, item, k, win, p - j + d AS b
  FROM anchors JOIN places ON word = win[j], (SELECT unnest(range(-2, 3)) AS d)),
close AS (
  SELECT r, list_sort(list(DISTINCT item)) AS near
  FROM begun JOIN docs USING (r)
  WHERE len(list_filter(range(1, k + 1), lambda m: list_contains(
    w[greatest(b + m - 2, 1):greatest(b + m + 2, 0)], win[m]))) = k
  GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n, 0) > 0 AS contaminated,
       CAST(coalesce(len(near), 0) AS BIGINT) AS n_near_items,
       sha256(coalesce(array_to_string(near, ','), '')) AS near_items_sha256
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r) LEFT JOIN close USING (r)
"""

OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
  FROM documents),
told AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN told USING (doc_id)),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
sequences AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, i, 1) AS f,
         1 << (ascii(substr(filter_order, i, 1)) - 65) AS bit,
         coalesce(list_sum(list_transform(range(1, i),
           lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))), 0)::INTEGER AS earlier
  FROM sequences, (SELECT unnest(range(1, 6)) AS i)),
counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

SQL: dict[str, str] = {"op6_decontamination": OP6, "op13_filter_audit": OP13}
