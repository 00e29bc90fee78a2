"""Query of the operator that ranks documents for items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalens.llm import lexical_search
from catalens.llm.queries import query, table

_TERMS = """regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

_OP12_SQL = f"""
WITH docs AS (
  SELECT doc_id, {_TERMS} AS terms FROM documents
), totals AS (
  SELECT count(*) FILTER (len(terms) > 0) AS documents, sum(len(terms))::BIGINT AS length FROM docs
), asked AS (
  SELECT DISTINCT item_id, unnest(terms) AS term
  FROM (SELECT item_id, {_TERMS} AS terms FROM benchmark WHERE item_id IS NOT NULL)
), held AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, totals GROUP BY term, documents
), valued AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // length)) AS v
  FROM held, totals
), scores AS (
  SELECT item_id, doc_id, sum(w * v)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN valued USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM scores WHERE score > 0)
WHERE rank <= 50
"""


@query("op12_lexical_search", _OP12_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
