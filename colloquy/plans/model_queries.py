"""Queries over whole runs of model stages, with stub models that SQL can follow."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import functions as F

from colloquy.operators import model_runs as mr
from colloquy.operators import models
from colloquy.plans.registry import query
from colloquy.session import durable, new_path

GROUP = 3


def group_lines(prompt: str) -> str:
    """Stub: every three lines that begin with a speaker are a fragment; a quarter of the
    answers come inside a code fence."""
    said = [m.groups() for m in (re.match(r"(user|assistant): (.*)\Z", line, re.S) for line in prompt.split("\n")) if m]
    groups = [
        {"title": f"Group {i // GROUP}", "statements": [{"speaker": s, "text": t} for s, t in said[i : i + GROUP]]}
        for i in range(0, len(said), GROUP)
    ]
    body = json.dumps({"fragments": groups})
    return f"```json\n{body}\n```" if hashlib.md5(prompt.encode()).hexdigest()[0] < "4" else body


def digest_summary(prompt: str) -> str:
    """Stub: the summary is the beginning of the prompt's digest, so it shows all of it."""
    return json.dumps({"summary": hashlib.md5(prompt.encode()).hexdigest()[:8]})


@query(
    "model_fragments",
    f"""
, asked AS (
  SELECT extract_id, statement_index // 50 AS batch, string_agg(speaker || ': ' || text, chr(10) ORDER BY statement_index) AS prompt
  FROM statements GROUP BY ALL
),
pieces AS (SELECT extract_id, batch, unnest(string_split(prompt, chr(10))) AS line, generate_subscripts(string_split(prompt, chr(10)), 1) AS n FROM asked),
said AS (
  SELECT extract_id, batch, line, row_number() OVER (PARTITION BY extract_id, batch ORDER BY n) - 1 AS rn
  FROM pieces WHERE regexp_matches(line, '^(user|assistant): ')
),
numbered AS (
  SELECT *, rn // {GROUP} AS k, rn % {GROUP} AS pos, dense_rank() OVER (PARTITION BY extract_id ORDER BY batch, rn // {GROUP}) - 1 AS fragment_index FROM said
),
state AS (
  SELECT extract_id, bool_or(substr(md5(prompt), 1, 1) < '4' AND EXISTS (SELECT 1 FROM said s WHERE s.extract_id = a.extract_id AND s.batch = a.batch)) AS fenced
  FROM asked a GROUP BY extract_id
),
texts AS (SELECT extract_id, text, arg_max(statement_id, statement_index) AS statement_id FROM statements GROUP BY ALL),
linked AS (
  SELECT n.extract_id, n.fragment_index, t.statement_id, min(pos) AS pos
  FROM numbered n JOIN texts t ON t.extract_id = n.extract_id AND t.text = substr(n.line, strpos(n.line, ': ') + 2) GROUP BY ALL
),
ids AS (SELECT extract_id, fragment_index, string_agg(statement_id, ',' ORDER BY pos, statement_id) AS statement_ids FROM linked GROUP BY ALL)
SELECT printf('%s_f%03d', n.extract_id, n.fragment_index) AS fragment_id, any_value(e.segment_id) AS segment_id,
       any_value('Group ' || k) AS title, any_value('Group ' || k) || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS retrieval_text,
       CASE WHEN any_value(s.fenced) THEN 'degraded' ELSE 'ok' END AS status, count(*) AS statement_count,
       coalesce(any_value(i.statement_ids), '') AS statement_ids
FROM numbered n JOIN state s USING (extract_id) JOIN extracts e USING (extract_id)
LEFT JOIN ids i ON i.extract_id = n.extract_id AND i.fragment_index = n.fragment_index
GROUP BY n.extract_id, n.fragment_index
""",
)
def model_fragments(kb):
    """Whole fragments of a stub model, asked batch by batch through a log."""
    blocks = kb.spark.createDataFrame([], "extract_id string, block_id string, block_kind string, line_count bigint, archival_description " + mr.DESCRIPTION)
    out = mr.model_fragments(
        kb.extracts, kb.statements, blocks, lambda: lambda asked: [group_lines(p) for p in asked],
        "{statements_text}", "stub", new_path(kb.spark, "answers"),
    )
    links = out["links"].groupBy("fragment_id").agg(F.array_sort(F.collect_list(F.struct("position_in_fragment", "statement_id"))).alias("_l"))
    linked = links.select("fragment_id", F.array_join(F.transform("_l", lambda x: x["statement_id"]), ",").alias("statement_ids"))
    return out["fragments"].join(linked, "fragment_id", "left").select(
        "fragment_id", "segment_id", "title", "retrieval_text", "status", "statement_count", F.coalesce("statement_ids", F.lit("")).alias("statement_ids")
    )


@query(
    "model_summaries",
    r"""
SELECT segment_id, summary FROM (
  WITH RECURSIVE told AS (
    SELECT segment_id, conv_id, segment_index, list_value(substr(md5('---BEGIN SEGMENT TRANSCRIPT---' || chr(10) || segment_text || chr(10) || '---END SEGMENT TRANSCRIPT---'), 1, 8)) AS prior
    FROM segments WHERE segment_index = 0
    UNION ALL
    SELECT s.segment_id, s.conv_id, s.segment_index, list_slice(list_append(t.prior, substr(md5(
      '---BEGIN PREVIOUS CONTEXT---' || chr(10) || array_to_string(list_transform(t.prior, lambda p, i: 'Segment ' || (i - 1) || ': ' || p), chr(10)) || chr(10) || '---END PREVIOUS CONTEXT---' || chr(10) || chr(10)
      || '---BEGIN SEGMENT TRANSCRIPT---' || chr(10) || s.segment_text || chr(10) || '---END SEGMENT TRANSCRIPT---'), 1, 8)), -3, -1)
    FROM told t JOIN segments s ON s.conv_id = t.conv_id AND s.segment_index = t.segment_index + 1
  )
  SELECT segment_id, list_extract(prior, -1) AS summary FROM told
)
""",
)
def model_summaries(kb):
    """Summaries in two ranges of segments; the second starts from what the first one left."""
    factory = lambda: digest_summary
    first, context = mr.summarize_range(kb.segments.where("segment_index < 2"), factory)
    second, _ = mr.summarize_range(kb.segments.where("segment_index >= 2"), factory, durable(context, "seed"))
    return first.unionByName(second).select("segment_id", "summary")


def counted_letters(texts: list[str]) -> list[list[float]]:
    """Stub: a text's length and how often a few letters are in it."""
    return [[float(len(t)), *[float(t.count(c)) for c in "aeo "]] for t in texts]


@query(
    "embedder",
    """
SELECT statement_id, array_to_string([CAST(length(text) AS VARCHAR),
  CAST(length(text) - length(replace(text, 'a', '')) AS VARCHAR), CAST(length(text) - length(replace(text, 'e', '')) AS VARCHAR),
  CAST(length(text) - length(replace(text, 'o', '')) AS VARCHAR), CAST(length(text) - length(replace(text, ' ', '')) AS VARCHAR)], ',') AS vector
FROM statements
""",
)
def embedder(kb):
    """Vectors by a plugged-in embedder, called with batches of texts."""
    found = models.run_embedder(kb.statements, lambda: counted_letters).where("error is null")
    whole = F.transform("vector", lambda x: x.cast("bigint").cast("string"))
    return found.select("statement_id", F.array_join(whole, ",").alias("vector"))
