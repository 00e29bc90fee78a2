"""Queries of the operators that find repetition."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from catalens.llm import line_dedup, ngram_join
from catalens.llm.queries import query, table

_OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM docs WHERE text IS NOT NULL
), sums AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
    sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM lines
), runs AS (
  SELECT 0 AS kind, a.doc_id, a.i AS lo, min(b.i) AS hi
  FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50
  GROUP BY ALL
  UNION ALL
  SELECT 1, b.doc_id, max(a.i), b.i
  FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50
  GROUP BY b.doc_id, b.i
), texts AS (
  SELECT kind, doc_id, lo, hi, array_to_string(ls[lo + 1 : hi + 1], chr(10)) AS run
  FROM runs JOIN docs USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY kind, run ORDER BY doc_id, lo) AS copy FROM texts
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM ranked WHERE copy > 1
), kept AS (
  SELECT l.doc_id, count(g.i) AS n_deleted, count(*) AS n_lines,
    string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op3_line_dedup", _OP3_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")


_OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE
    list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g
  FROM words WHERE w IS NOT NULL
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * inter >= 85 * (a.n + b.n - inter)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""


@query("op1_ngram_join", _OP1_SQL)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.ngram_groups(docs, n=4, threshold=Fraction(85, 100)).select(
        "doc_id", "n_shingles", "component_id"
    )
