"""Registered queries and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans.stages import KnowledgeBase

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(kb) -> DataFrame`` under ``name``, with its SQL if there is one."""

    def register(fn: Callable[[KnowledgeBase], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(KnowledgeBase(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = BASE + "\n" + oracle.strip()
        return fn

    return register


# The stage tables of colloquy.plans.stages in SQL. Queries select from these.
BASE = r"""
WITH turns AS (
  SELECT 'c' || conv_id AS conv_id, printf('c%d_m%04d', conv_id, turn) AS message_id, role AS speaker,
         make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) AS created_at,
         turn AS ordinal, text AS content
  FROM conversations
),
shown AS (
  SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS norm FROM turns
  WHERE speaker IN ('user', 'assistant') AND regexp_replace(content, '^\s+|\s+$', '', 'g') <> ''
),
heard AS (SELECT *, lead(speaker) OVER w AS next_speaker, lead(norm) OVER w AS next_norm FROM shown WINDOW w AS (PARTITION BY conv_id ORDER BY ordinal)),
messages AS (
  SELECT conv_id, message_id, speaker, created_at, ordinal, content, row_number() OVER (PARTITION BY conv_id ORDER BY ordinal) - 1 AS position
  FROM heard WHERE NOT (speaker = 'user' AND coalesce(next_speaker = 'user' AND next_norm = norm, false))
),
grp AS (
  SELECT *, CAST(sum(CASE WHEN speaker = 'user' OR position = 0 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY conv_id ORDER BY position) - 1 AS BIGINT) AS g
  FROM messages
),
gstat AS (
  SELECT conv_id, g, bool_or(speaker = 'assistant') AS answered, arg_min(speaker, position) = 'user' AS led,
         max(g) OVER (PARTITION BY conv_id) = g AS is_last
  FROM grp GROUP BY conv_id, g
),
segrows AS (
  SELECT m.*, m.g AS segment_index FROM grp m JOIN gstat s USING (conv_id, g)
  WHERE NOT (s.led AND NOT s.answered AND s.is_last)
  UNION ALL
  SELECT m.*, m.g - 1 FROM grp m JOIN gstat s ON s.conv_id = m.conv_id AND s.g = m.g - 1
  WHERE m.speaker = 'user' AND s.led AND s.answered
),
segments AS (
  SELECT printf('%s_s%03d', conv_id, segment_index) AS segment_id, conv_id, segment_index,
         min(position) AS start_position, max(position) AS end_position,
         string_agg(message_id, ',' ORDER BY position) AS message_ids,
         arg_min(created_at, position) AS conversation_date,
         string_agg(speaker || ': ' || regexp_replace(content, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY position) AS segment_text
  FROM segrows GROUP BY conv_id, segment_index
),
tails AS (
  SELECT m.* FROM grp m JOIN gstat s USING (conv_id, g) WHERE s.led AND NOT s.answered AND s.is_last
),
seg_parts AS (
  SELECT segment_id, segment_index, conv_id,
         string_split(regexp_replace(segment_text, '(?im)^(user|assistant)\s*:', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts
  FROM segments
),
seg_turns AS (
  SELECT segment_id, segment_index, conv_id, row_number() OVER (PARTITION BY segment_id ORDER BY n) - 1 AS turn_index, speaker, body
  FROM (SELECT segment_id, segment_index, conv_id, n, lower(split_part(part, chr(2), 1)) AS speaker,
               regexp_replace(split_part(part, chr(2), 2), '^\s+|\s+$', '', 'g') AS body
        FROM (SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM seg_parts) WHERE n > 1)
  WHERE body <> ''
),
seg_sentences AS (
  SELECT segment_id, segment_index, conv_id, speaker, turn_index, n, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS text
  FROM (SELECT *, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS n
        FROM (SELECT *, string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS pieces FROM seg_turns))
),
statements AS (
  SELECT printf('%s_x_st%04d', segment_id, statement_index) AS statement_id, segment_id || '_x' AS extract_id,
         segment_id, segment_index, conv_id, statement_index, speaker, text
  FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY turn_index, n) - 1 AS statement_index
        FROM (SELECT *, row_number() OVER (PARTITION BY segment_id, speaker, text ORDER BY turn_index, n) AS copy
              FROM seg_sentences WHERE text <> '') WHERE copy = 1)
),
extracts AS (
  SELECT segment_id || '_x' AS extract_id, segment_id, segment_index, conv_id, 'local' AS provider,
         'baseline' AS model, 'ok' AS status, conversation_date AS created_at
  FROM segments
),
st_words AS (
  SELECT *, statement_index // 50 AS batch, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ws FROM statements
),
st_lag AS (
  SELECT *, lag(ws) OVER w AS pws, lag(batch) OVER w AS pbatch FROM st_words WINDOW w AS (PARTITION BY extract_id ORDER BY statement_index)
),
st_start AS (
  SELECT *, CASE WHEN pbatch IS NULL OR pbatch <> batch THEN 1
                 WHEN len(pws) = 0 OR len(ws) = 0 THEN 1
                 WHEN len(list_intersect(pws, ws)) / (len(pws) + len(ws) - len(list_intersect(pws, ws))) < 0.05 THEN 1
                 ELSE 0 END AS starts
  FROM st_lag
),
st_run AS (SELECT *, sum(starts) OVER (PARTITION BY extract_id ORDER BY statement_index) AS run FROM st_start),
st_pos AS (SELECT *, (row_number() OVER (PARTITION BY extract_id, run ORDER BY statement_index) - 1) % 10 AS position_in_fragment FROM st_run),
grouped AS (
  SELECT *, CAST(sum(CASE WHEN position_in_fragment = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY extract_id ORDER BY statement_index) - 1 AS BIGINT) AS fragment_index
  FROM st_pos
),
frag0 AS (
  SELECT extract_id, segment_id, conv_id, fragment_index,
         array_to_string(list_slice(string_split(regexp_replace(arg_min(text, position_in_fragment), '\s+', ' ', 'g'), ' '), 1, 6), ' ') AS title,
         string_agg(speaker || ': ' || text, chr(10) ORDER BY position_in_fragment) AS body,
         string_agg(speaker || ': ' || text, ' / ' ORDER BY position_in_fragment) FILTER (position_in_fragment < 2) AS head,
         count(*) AS statement_count
  FROM grouped GROUP BY ALL
),
fragments AS (
  SELECT printf('%s_f%03d', extract_id, fragment_index) AS fragment_id, *,
         title || chr(10) || chr(10) || body AS retrieval_text, 'ok' AS status
  FROM frag0
),
links AS (
  SELECT printf('%s_f%03d', extract_id, fragment_index) AS fragment_id, statement_id, position_in_fragment FROM grouped
),
conversations_dim AS (
  SELECT conv_id, 'Conversation ' || substr(conv_id, 2) AS title, 'chatgpt' AS source_platform,
         sha256('raw:' || conv_id) AS raw_source_file_id, sha256('normalized:' || conv_id) AS normalized_source_file_id,
         count(*) AS message_count,
         (SELECT s.conversation_date FROM segments s WHERE s.conv_id = m.conv_id AND s.segment_index = 0) AS conversation_date
  FROM messages m GROUP BY conv_id
),
sources AS (
  SELECT raw_source_file_id AS source_file_id, 'raw_export' AS source_kind, substr(raw_source_file_id, 1, 8) || '.json' AS original_filename, conversation_date AS created_at FROM conversations_dim
  UNION ALL
  SELECT normalized_source_file_id, 'normalized', substr(normalized_source_file_id, 1, 8) || '.json', conversation_date FROM conversations_dim
)"""


def hashed_vectors(source: str, key: str, text: str, prefix: str = "hv") -> str:
    """SQL for unit vectors of signed hashed terms, 64 wide, over ``source``."""
    return rf""",
{prefix}_terms AS (
  SELECT {key} AS id, CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % 64 AS d,
         CASE WHEN CAST(('0x' || substr(md5(w), 5, 1)) AS INT) >= 8 THEN -1 ELSE 1 END AS s
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')) AS w FROM {source})
),
{prefix}_counts AS (SELECT id, d, CAST(sum(s) AS DOUBLE) AS c FROM {prefix}_terms GROUP BY id, d),
{prefix}_norms AS (SELECT id, sqrt(sum(c * c)) AS n FROM {prefix}_counts GROUP BY id),
{prefix} AS (
  SELECT i.id, list(CASE WHEN i.n > 0 THEN coalesce(c.c, 0) / i.n ELSE 0.0 END ORDER BY r.d) AS vector
  FROM {prefix}_norms i CROSS JOIN (SELECT unnest(range(64)) AS d) r
  LEFT JOIN {prefix}_counts c ON c.id = i.id AND c.d = r.d
  GROUP BY i.id
)"""
