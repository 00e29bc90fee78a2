"""Query of the operator on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalens.llm import chat_format
from catalens.llm.queries import query, table

_OP9_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, unnest(range(len(ls))) AS i, unnest(ls) AS line
  FROM (SELECT conv_id, turn, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations)
), levels AS (
  SELECT conv_id, turn, i, regexp_extract(line, '^\x20{0,3}(?:>\x20?)+') AS q, line FROM lines
), bodies AS (
  SELECT conv_id, turn, i, length(regexp_replace(q, '[^>]', '', 'g')) AS level,
    substring(line, length(q) + 1) AS body FROM levels
), marked AS (
  SELECT *, level = 0 AND NOT (
      regexp_matches(body, '(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$')
      AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) > 0) AS own,
    i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run
  FROM bodies
), said AS (
  SELECT conv_id, turn, regexp_replace(regexp_replace(
    coalesce(string_agg(CASE WHEN own THEN body END, chr(10) ORDER BY i), ''), '\A(?:[\x20\t]*\n)+', ''), '\s+\z', '') AS own_text,
    count(CASE WHEN level > 0 THEN 1 END) AS n_quoted
  FROM marked GROUP BY conv_id, turn
), quotes AS (
  SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS t FROM (
    SELECT conv_id, turn, level, body AS t FROM marked WHERE level > 0
    UNION ALL
    SELECT conv_id, turn, level, string_agg(body, ' ' ORDER BY i) FROM marked WHERE level > 0
    GROUP BY conv_id, turn, level, run)
), origins AS (
  SELECT conv_id, t, min(turn) AS origin FROM (
    SELECT conv_id, turn, trim(regexp_replace(lower(unnest(list_append(string_split(own_text, chr(10)), own_text))), '\s+', ' ', 'g')) AS t
    FROM said) GROUP BY conv_id, t
), named AS (
  SELECT q.conv_id, turn, origin, min(level) AS level, sum(length(t)) AS size
  FROM quotes q JOIN origins o USING (conv_id, t) WHERE t <> '' AND origin < turn GROUP BY ALL
), parents AS (
  SELECT conv_id, turn, origin AS parent FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, origin DESC) AS r FROM named)
  WHERE r = 1
), tree AS (
  SELECT conv_id, turn, turn AS thread_turn, 0 AS depth FROM said
  WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.conv_id = said.conv_id AND p.turn = said.turn)
  UNION ALL
  SELECT p.conv_id, p.turn, t.thread_turn, t.depth + 1
  FROM tree t JOIN parents p ON p.conv_id = t.conv_id AND p.parent = t.turn
)
SELECT c.conv_id, c.turn, c.role, s.own_text, s.n_quoted, p.parent AS parent_turn, t.thread_turn,
  t.depth::BIGINT AS depth, '<|' || coalesce(c.role, 'unknown') || '|>' || chr(10) || s.own_text || chr(10) AS formatted
FROM conversations c JOIN said s USING (conv_id, turn) JOIN tree t USING (conv_id, turn)
LEFT JOIN parents p USING (conv_id, turn)
"""


@query("op9_chat_format", _OP9_SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "own_text", "n_quoted", "parent_turn", "thread_turn", "depth",
        "formatted",
    )
