"""Queries of the operators that judge each text by itself: rules, secrets, licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import license_scan, quality_rules, secret_scan
from catalens.llm.queries import query, table


_OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents
), places AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words)
), repeated AS (
  SELECT doc_id, unnest(range(i, i + 8)) AS place FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM places) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM repeated GROUP BY doc_id
), counts AS (
  SELECT doc_id, t, ls, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, length(replace(replace(t, ' ', ''), chr(10), '')) AS solid,
    length(t) AS size
  FROM words LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    coalesce(length(regexp_replace(t, '[^#*$%&|<>{}~^]+', '', 'g')) / nullif(size, 0) > 0.06, false)
    OR coalesce((size - length(replace(replace(t, '!', ''), '?', ''))) / nullif(size, 0) > 0.08, false)
    OR coalesce(length(regexp_replace(t, '[^A-ZÀ-ÖØ-ÞΑ-ΩА-Я]+', '', 'g')) / nullif(solid, 0) > 0.50, false)
    OR coalesce(length(regexp_replace(t, '[^\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) / nullif(solid, 0) > 0.50, false)
    OR size / (1 + size - solid) > 40
    OR len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•‣◦]'))) / len(ls) > 0.90 AS rejected
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept
FROM judged
"""


@query("op6_quality_rules", _OP6_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secret_scan.span_text(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("all_spans")).alias("spans"),
    )


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licences(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
