"""Query of the operator that finds periodic runs."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import periodic_runs
from catalens.llm.queries import query, table
from catalens.shipping import ship_by_value

ship_by_value(__name__)


def with_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a tenth of the documents, chosen by id, made periodic from some word on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(len(words) - a)]


_OP13_SQL = r"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
    xor(list_reduce(
      flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda s: list_transform(range(8), lambda k: (ascii(s)::BIGINT >> k::INT) & 1))),
      lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END),
      4294967295), 4294967295) AS h
  FROM documents
), places AS (
  SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS changed, h // 10 AS g,
    CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a
  FROM hashed
), words AS (
  SELECT doc_id, n, i, CASE WHEN changed AND i >= a
    THEN o[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE o[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM places)
), equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM equal)
  GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL
), strongest AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1
), listed AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM words w LEFT JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i WHERE d.i IS NULL GROUP BY w.doc_id
)
SELECT p.doc_id, coalesce(l.n_runs, 0) AS n_runs, s.start, s.length, s.period,
  (1000 * s.length) // s.period AS exponent_milli,
  sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM places p LEFT JOIN listed l ON p.doc_id = l.doc_id LEFT JOIN strongest s ON p.doc_id = s.doc_id
LEFT JOIN kept k ON p.doc_id = k.doc_id
"""


@query("op13_periodic_runs", _OP13_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(
        table(spark, sf_dir, "documents").select("doc_id", "text"), change=with_repeats
    )
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
