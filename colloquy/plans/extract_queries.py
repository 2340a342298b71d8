"""Queries over statements, fragments, drift rules and text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.functions import text as tx
from colloquy.operators import blocks as bl
from colloquy.operators import fragments as fr
from colloquy.operators import similarity as sim
from colloquy.operators import statements as st
from colloquy.plans.registry import query
from colloquy.plans.stages import KnowledgeBase


@query("split_by_message", "SELECT segment_id, turn_index, speaker, body FROM seg_turns")
def split_by_message(kb):
    return bl.split_by_message(kb.segments, "segment_id", "segment_text").withColumn(
        "turn_index", F.col("turn_index").cast("bigint")
    )


@query("statements", "SELECT statement_id, extract_id, conv_id, statement_index, speaker, text FROM statements")
def statements(kb):
    return kb.statements.select("statement_id", "extract_id", "conv_id", "statement_index", "speaker", "text")


@query(
    "safe_statements",
    "SELECT statement_id, extract_id, statement_index, speaker, text FROM statements",
)
def safe_statements(kb):
    """The same statements by way of turn de-duplication and block archiving."""
    safe = st.safe_segments(kb.segments, "placeholder")
    return st.extract_statements(safe, "working_view").select(
        "statement_id", "extract_id", "statement_index", "speaker", "text"
    )


@query(
    "shingles",
    r"""
, tok AS (SELECT statement_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM statements)
SELECT statement_id, coalesce(array_to_string(list_sort(list_distinct(
         CASE WHEN len(w) = 0 THEN []
              WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)), '|'), '') AS shingles
FROM tok
""",
)
def shingles(kb):
    found = tx.shingles(tx.words(F.col("text")))
    return kb.statements.select("statement_id", F.array_join(F.array_sort(found), "|").alias("shingles"))


def _with_copies(kb: KnowledgeBase) -> DataFrame:
    """Statements with an exact copy of some and a near copy of others."""
    n, words = F.col("statement_index"), F.size(tx.words(F.col("text")))
    columns = ["extract_id", "statement_index", "text"]
    near = kb.statements.where(words >= 12).select(
        "extract_id", (n + 10000).alias("statement_index"), F.concat("text", F.lit(" indeed")).alias("text")
    )
    exact = kb.statements.where(words % 3 == 0).select("extract_id", (n + 20000).alias("statement_index"), "text")
    return kb.statements.select(*columns).unionByName(near).unionByName(exact)


COPIES_SQL = r"""
, tok AS (SELECT *, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n FROM statements),
copies AS (
  SELECT extract_id, statement_index, text FROM tok
  UNION ALL SELECT extract_id, statement_index + 10000, text || ' indeed' FROM tok WHERE n >= 12
  UNION ALL SELECT extract_id, statement_index + 20000, text FROM tok WHERE n % 3 = 0
),
cw AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM copies),
sh AS (
  SELECT extract_id, statement_index, list_sort(list_distinct(
         CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s
  FROM cw
)"""


@query(
    "near_dup_pairs",
    COPIES_SQL
    + """
, cls AS (SELECT extract_id, s, min(statement_index) AS first_at, count(*) AS members FROM sh WHERE len(s) > 0 GROUP BY extract_id, s),
pairs AS (
  SELECT extract_id, first_at AS a, first_at AS b, 1.0::DOUBLE AS jaccard, members * (members - 1) // 2 AS pairs FROM cls WHERE members > 1
  UNION ALL
  SELECT x.extract_id, x.first_at, y.first_at,
         len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), x.members * y.members
  FROM cls x JOIN cls y ON x.extract_id = y.extract_id AND x.first_at < y.first_at
)
SELECT extract_id, a, b, round(jaccard, 6) AS jaccard, pairs FROM pairs WHERE jaccard >= 0.7
""",
)
def near_dup_pairs(kb):
    return sim.near_dup_pairs(_with_copies(kb)).select(
        "extract_id", "a", "b", F.round("jaccard", 6).alias("jaccard"), "pairs"
    )


@query(
    "dominant_ngram",
    COPIES_SQL
    + """
, grams AS (
  SELECT extract_id, statement_index, unnest(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) AS gram
  FROM cw WHERE len(w) >= 4
),
freq AS (SELECT extract_id, gram, count(*) AS c FROM grams GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY extract_id ORDER BY c DESC, gram) AS r FROM freq),
tot AS (SELECT extract_id, count(*) AS n FROM copies GROUP BY extract_id)
SELECT extract_id, gram, c AS statements_with, n AS statement_count, n >= 6 AND c >= greatest(5, n // 2) AS is_drift
FROM top JOIN tot USING (extract_id) WHERE r = 1
""",
)
def dominant_ngram(kb):
    return sim.dominant_ngram(_with_copies(kb))


@query(
    "dedup_turns",
    r"""
, doubled AS (
  SELECT conv_id || '_g' || g AS id, 'user: ' || arg_min(regexp_replace(content, '^\s+|\s+$', '', 'g'), position) FILTER (speaker = 'user') AS question,
         arg_min(regexp_replace(content, '^\s+|\s+$', '', 'g'), position) FILTER (speaker = 'assistant') AS reply
  FROM grp GROUP BY conv_id, g HAVING count(*) FILTER (speaker = 'user') > 0 AND count(*) FILTER (speaker = 'assistant') > 0
), sized AS (SELECT *, len(regexp_extract_all(lower(reply), '[\p{L}\p{N}_]+')) AS n FROM doubled)
SELECT id, CASE WHEN n < 5 THEN CAST(1 AS BIGINT) WHEN n >= 11 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS dropped_turns,
       question || chr(10) || chr(10) ||
       CASE WHEN n >= 11 THEN '' ELSE 'assistant: ' || reply || chr(10) || chr(10) END ||
       'assistant: ' || reply || ' indeed so' AS text
FROM sized
""",
)
def dedup_turns(kb):
    """First reply to every user message twice, then a slightly longer one: copies go, near ones too."""
    body = tx.strip(F.col("content"))
    first = kb.messages.groupBy(F.format_string("%s_g%d", "conv_id", "segment_index").alias("conv_id")).agg(
        F.min_by(body, F.when(F.col("speaker") == "user", F.col("position"))).alias("question"),
        F.min_by(body, F.when(F.col("speaker") == "assistant", F.col("position"))).alias("reply"),
    ).where("question is not null and reply is not null")
    gap = F.lit("\n\nassistant: ")
    text = F.concat(
        F.lit("user: "), "question", gap, "reply", gap, "reply", gap, F.concat("reply", F.lit(" indeed so"))
    )
    return sim.dedup_assistant_turns(first.select(F.col("conv_id").alias("id"), text.alias("text")))


@query("batch_statements", "SELECT statement_id, statement_index // 2 AS batch FROM statements")
def batch_statements(kb):
    return fr.batch_statements(kb.statements, 2).select("statement_id", "batch")


@query(
    "fragments",
    "SELECT fragment_id, extract_id, fragment_index, title, statement_count FROM fragments",
)
def fragments(kb):
    return kb.fragments.select("fragment_id", "extract_id", "fragment_index", "title", "statement_count")


@query(
    "fragment_text",
    """
, tagged AS (SELECT *, text || ' see [ARCHIVED_BLOCK_1] and [ARCHIVED_BLOCK_9]' AS full_text FROM grouped)
SELECT printf('%s_f%03d', extract_id, fragment_index) AS fragment_id,
       array_to_string(list_slice(string_split(regexp_replace(arg_min(
           replace(full_text, '[ARCHIVED_BLOCK_1]', 'fenced_code (7 lines)'), position_in_fragment), '\\s+', ' ', 'g'), ' '), 1, 6), ' ')
       || chr(10) || chr(10) || string_agg(speaker || ': ' || replace(full_text, '[ARCHIVED_BLOCK_1]', 'fenced_code (7 lines)'), chr(10) ORDER BY position_in_fragment)
       || chr(10) || chr(10) || '[Archived: fenced_code (7 lines)]' AS retrieval_text
FROM tagged GROUP BY extract_id, fragment_index
""",
)
def fragment_text(kb):
    """Statements that name a known and an unknown block, expanded and assembled."""
    tagged = kb.grouped.withColumn("text", F.concat("text", F.lit(" see [ARCHIVED_BLOCK_1] and [ARCHIVED_BLOCK_9]")))
    blocks = kb.extracts.select(
        "extract_id",
        F.lit("ARCHIVED_BLOCK_1").alias("block_id"),
        F.lit("fenced_code").alias("block_kind"),
        F.lit(7).cast("bigint").alias("line_count"),
        F.struct(F.lit("").alias("brief_description")).alias("archival_description"),
    )
    expanded = bl.expand_placeholders(tagged, blocks, ["extract_id", "statement_index"], "extract_id")
    return fr.assemble_fragments(expanded).select("fragment_id", "retrieval_text")


@query("links", "SELECT fragment_id, statement_id, position_in_fragment FROM links")
def links(kb):
    return kb.links


@query(
    "statement_span",
    """
SELECT printf('%s_f%03d', extract_id, fragment_index) AS fragment_id, min(statement_index) AS statement_start_index, max(statement_index) AS statement_end_index
FROM grouped GROUP BY extract_id, fragment_index
""",
)
def statement_span(kb):
    return fr.statement_span(kb.grouped)


def _members(kb: KnowledgeBase) -> DataFrame:
    """Fragment members; those of odd fragments come without an index."""
    return kb.grouped.select(
        F.format_string("%s_f%03d", "extract_id", "fragment_index").alias("fragment_id"),
        "position_in_fragment",
        "text",
        F.when(F.col("fragment_index") % 2 == 0, F.col("statement_index")).alias("statement_index"),
    )


@query(
    "repair_links",
    """
, last_text AS (SELECT extract_id, text, arg_max(statement_id, statement_index) AS statement_id FROM statements GROUP BY ALL)
SELECT printf('%s_f%03d', g.extract_id, g.fragment_index) AS fragment_id,
       CASE WHEN g.fragment_index % 2 = 0 THEN g.statement_id ELSE l.statement_id END AS statement_id,
       row_number() OVER (PARTITION BY g.extract_id, g.fragment_index ORDER BY g.position_in_fragment) - 1 AS position_in_fragment
FROM grouped g JOIN last_text l USING (extract_id, text)
WHERE g.fragment_index % 3 <> 0
QUALIFY row_number() OVER (PARTITION BY g.extract_id, g.fragment_index, CASE WHEN g.fragment_index % 2 = 0 THEN g.statement_id ELSE l.statement_id END ORDER BY g.position_in_fragment) = 1
""",
)
def repair_links(kb):
    """Every third fragment still has its links; the others are repaired."""
    kept = kb.links.join(
        kb.fragments.where(F.col("fragment_index") % 3 == 0).select("fragment_id"), "fragment_id", "left_semi"
    )
    return fr.repair_links_by_text(kb.fragments, _members(kb), kb.statements, kept)


@query(
    "merge_batches",
    """
, b AS (
  SELECT extract_id, batch, count(*) * 10 AS latency_ms, batch % 3 = 1 AS is_degraded, batch % 4 = 2 AS is_partial,
         CASE WHEN batch % 5 = 4 THEN 'timeout' END AS skip_reason, count(*) AS fragment_count,
         CASE WHEN batch % 3 = 1 THEN 'fences removed' END AS warning
  FROM (SELECT *, statement_index // 5 AS batch FROM statements) GROUP BY extract_id, batch
)
SELECT extract_id, CAST(sum(latency_ms) AS BIGINT) AS latency_ms,
       coalesce(bool_or(is_degraded) FILTER (skip_reason IS NULL), false) AS is_degraded,
       coalesce(bool_or(is_partial) FILTER (skip_reason IS NULL), false) AS is_partial,
       CAST(coalesce(sum(fragment_count) FILTER (skip_reason IS NULL), 0) AS BIGINT) AS fragment_count,
       coalesce(string_agg('batch ' || (batch + 1) || ': ' || warning, '; ' ORDER BY batch) FILTER (skip_reason IS NULL), '') AS warning
FROM b GROUP BY extract_id
""",
)
def merge_batches(kb):
    b = F.col("batch")
    batches = fr.batch_statements(kb.statements, 5).groupBy("extract_id", "batch").agg(F.count("*").alias("n")).select(
        "extract_id",
        "batch",
        (F.col("n") * 10).alias("latency_ms"),
        (b % 3 == 1).alias("is_degraded"),
        (b % 4 == 2).alias("is_partial"),
        F.when(b % 5 == 4, "timeout").alias("skip_reason"),
        F.col("n").alias("fragment_count"),
        F.when(b % 3 == 1, "fences removed").alias("warning"),
    )
    return fr.merge_batches(batches)


def _answers(kb: KnowledgeBase) -> DataFrame:
    """Model answers made from the statements, with faults set by segment number.

    0 plain, 1 fenced, 2 an extra key, 3 a made-up speaker, 4 broken JSON, 5 empty,
    6 every statement twice; attempt 2 is always sound.
    """
    listed = F.array_sort(F.collect_list(F.struct("statement_index", F.struct("speaker", "text").alias("s"))))
    per = (
        kb.statements.groupBy("segment_id", "conv_id", "segment_index")
        .agg(listed.alias("_l"))
        .withColumn("_s", F.transform("_l", lambda x: x["s"]))
        .withColumn("fault", (F.substr(F.col("conv_id"), F.lit(2)).cast("bigint") + F.col("segment_index")) % 7)
    )
    items = F.to_json(F.struct(F.col("_s").alias("statements")))
    fault = F.col("fault")
    twice = F.to_json(F.struct(F.concat("_s", "_s").alias("statements")))
    raw = (
        F.when(fault == 1, F.concat(F.lit("```json\n"), items, F.lit("\n```")))
        .when(fault == 2, F.concat(items.substr(F.lit(1), F.length(items) - 1), F.lit(', "note": 1}')))
        .when(fault == 3, F.replace(items, F.lit('"speaker":"user"'), F.lit('"speaker":"system"')))
        .when(fault == 4, items.substr(F.lit(1), F.length(items) - 2))
        .when(fault == 5, F.lit('{"statements": []}'))
        .when(fault == 6, twice)
        .otherwise(items)
    )
    both = per.select("segment_id", "fault", F.lit(1).alias("attempt"), raw.alias("raw")).unionByName(
        per.select("segment_id", "fault", F.lit(2).alias("attempt"), F.when(fault != 5, items).alias("raw"))
    )
    views = kb.segments.select("segment_id", F.col("segment_text").alias("working_view"))
    return both.join(views, "segment_id").withColumn("error", F.when(F.col("raw").isNull(), "timeout"))


FAULTS_SQL = """
, per AS (
  SELECT segment_id, (CAST(substr(conv_id, 2) AS BIGINT) + segment_index) % 7 AS fault, count(*) AS n,
         count(*) FILTER (speaker = 'user') AS users
  FROM statements GROUP BY segment_id, conv_id, segment_index
)"""


@query(
    "read_model_output",
    FAULTS_SQL
    + """
SELECT segment_id, CAST(1 AS INTEGER) AS attempt, fault <> 4 AS is_readable, fault = 1 AS is_degraded FROM per
UNION ALL SELECT segment_id, 2, fault <> 5, false FROM per
""",
)
def read_model_output(kb):
    return st.read_model_output(_answers(kb)).select(
        "segment_id", "attempt", F.col("parsed").isNotNull().alias("is_readable"), "is_degraded"
    )


def _checked(kb: KnowledgeBase) -> DataFrame:
    return st.validate_statements(st.read_model_output(_answers(kb)), ["segment_id", "attempt"])


VALID_SQL = (
    FAULTS_SQL
    + r"""
, cw AS (SELECT segment_id, statement_index, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM statements),
sh AS (
  SELECT segment_id, statement_index, list_sort(list_distinct(
         CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s
  FROM cw
),
single_pairs AS (
  SELECT x.segment_id, count(*) AS p FROM sh x JOIN sh y ON x.segment_id = y.segment_id AND x.statement_index < y.statement_index
  WHERE len(x.s) > 0 AND len(y.s) > 0
    AND len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) >= 0.7
  GROUP BY x.segment_id
),
own AS (SELECT segment_id, count(*) FILTER (len(s) > 0) AS shingled FROM sh GROUP BY segment_id),
grams AS (
  SELECT segment_id, unnest(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) AS gram FROM cw WHERE len(w) >= 4
),
gtop AS (SELECT segment_id, max(c) AS c, (array_agg(gram ORDER BY c DESC, gram))[1] AS gram FROM (SELECT segment_id, gram, count(*) AS c FROM grams GROUP BY ALL) GROUP BY segment_id),
shape AS (
  SELECT p.*, 1 AS attempt, CASE WHEN fault = 6 THEN 2 ELSE 1 END AS times, fault AS f FROM per p
  UNION ALL SELECT p.*, 2, 1, CASE WHEN fault = 5 THEN 4 ELSE 0 END FROM per p
),
facts AS (
  SELECT s.segment_id, s.attempt, s.f, s.fault,
         CASE WHEN s.f IN (4, 5) THEN 0 ELSE s.n * s.times END AS statement_count, s.users,
         s.times, coalesce(sp.p, 0) * s.times * s.times + CASE WHEN s.times = 2 THEN o.shingled ELSE 0 END AS pairs,
         coalesce(g.c, 0) * s.times AS gram_count, g.gram, s.n * s.times AS texts,
         length(seg.segment_text) - length(replace(seg.segment_text, chr(10), '')) + 1 AS lines,
         length(trim(seg.segment_text)) AS chars
  FROM shape s JOIN segments seg USING (segment_id) JOIN own o USING (segment_id)
  LEFT JOIN single_pairs sp USING (segment_id) LEFT JOIN gtop g USING (segment_id)
),
verdict AS (
  SELECT *, f = 4 AS r_json, f = 2 AS r_keys, f = 3 AND users > 0 AS r_speaker,
         f <> 4 AND statement_count > greatest(40, lines // 2) AS r_count,
         f = 5 AND chars > 200 AS r_zero,
         f NOT IN (4, 5) AND pairs >= 5 AS r_pairs,
         f NOT IN (4, 5) AND statement_count >= 6 AND gram_count >= greatest(5, statement_count // 2) AS r_gram
  FROM facts
)"""
)


@query(
    "validate_statements",
    VALID_SQL
    + """
SELECT segment_id, CAST(attempt AS INTEGER) AS attempt, statement_count,
       CASE WHEN r_json THEN 'output is not JSON' ELSE concat_ws('|',
         CASE WHEN r_keys THEN 'unexpected keys in output: note' END,
         CASE WHEN r_speaker THEN printf('invalid speaker in %d statement(s)', users) END,
         CASE WHEN r_count THEN printf('statement count %d exceeds plausible max %d for %d-line input', statement_count, greatest(40, lines // 2), lines) END,
         CASE WHEN r_zero THEN 'zero statements extracted from non-empty segment' END,
         CASE WHEN r_pairs THEN printf('found %d near-duplicate statement pair(s)', pairs) END,
         CASE WHEN r_gram THEN printf('4-gram ''%s'' appears in %d/%d statements', gram, gram_count, texts) END) END AS reasons,
       NOT (r_json OR r_keys OR r_speaker OR r_count OR r_zero OR r_pairs OR r_gram) AS is_valid
FROM verdict
""",
)
def validate_statements(kb):
    return _checked(kb).select("segment_id", "attempt", "statement_count", F.array_join("reasons", "|").alias("reasons"), "is_valid")


@query(
    "pick_attempt",
    VALID_SQL
    + """
, ok AS (SELECT *, NOT (r_json OR r_keys OR r_speaker OR r_count OR r_zero OR r_pairs OR r_gram) AND statement_count > 0 AS usable FROM verdict)
SELECT segment_id, CAST(coalesce(min(attempt) FILTER (usable), 2) AS INTEGER) AS attempt,
       CASE WHEN NOT bool_or(usable) THEN 'partial' WHEN max(fault) = 1 THEN 'degraded' ELSE 'ok' END AS status
FROM ok GROUP BY segment_id
""",
)
def pick_attempt(kb):
    return st.pick_attempt(_checked(kb)).select("segment_id", "attempt", "status")


@query(
    "statement_index",
    VALID_SQL
    + """
, ok AS (SELECT *, NOT (r_json OR r_keys OR r_speaker OR r_count OR r_zero OR r_pairs OR r_gram) AND statement_count > 0 AS usable FROM verdict),
chosen AS (SELECT segment_id, arg_min(times, attempt) FILTER (usable) AS times, any_value(statement_total) AS total
           FROM (SELECT ok.*, count(*) OVER () AS x, (SELECT count(*) FROM statements s WHERE s.segment_id = ok.segment_id) AS statement_total FROM ok)
           GROUP BY segment_id HAVING bool_or(usable))
SELECT printf('%s_st%04d', extract_id, statement_index + r.shift * total) AS statement_id, extract_id,
       statement_index + r.shift * total AS statement_index, speaker, text
FROM statements JOIN chosen USING (segment_id) JOIN (SELECT unnest([0, 1]) AS shift) r ON r.shift < chosen.times
""",
)
def statement_index(kb):
    """Statements of the chosen answers, numbered again from the model text."""
    return st.clean_model_statements(st.pick_attempt(_checked(kb))).select(
        "statement_id", "extract_id", "statement_index", "speaker", "text"
    )


def _fenced(kb: KnowledgeBase) -> DataFrame:
    docs = kb.spark.read.parquet(f"{kb.sf_dir}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("user: look\n```text\n"), "text", F.lit("\n```\nthanks")).alias("text"),
    )


@query(
    "fenced_blocks",
    """
SELECT doc_id AS id, 'fenced_code' AS block_kind, CAST(11 AS BIGINT) AS start_at, 11 + 8 + length(text) + 4 AS end_at,
       length(text) - length(replace(text, chr(10), '')) + 3 AS line_count
FROM documents
""",
)
def fenced_blocks(kb):
    return bl.fenced_blocks(_fenced(kb))


@query(
    "json_schema_blocks",
    """
, made AS (SELECT doc_id AS id, chr(10) || '{' || chr(10) || '"type": "object",' || chr(10) || replace(replace(text, '{', '('), '}', ')') || chr(10) || '}' || chr(10) || 'end' AS t FROM documents),
found AS (SELECT id, t, length(t) - 6 AS body FROM made)
SELECT id, 'json_schema_like' AS block_kind, CAST(1 AS BIGINT) AS start_at, body + 2 AS end_at,
       length(t) - length(replace(t, chr(10), '')) - 1 AS line_count
FROM found WHERE length(t) - length(replace(t, chr(10), '')) - 1 >= 8
""",
)
def json_schema_blocks(kb):
    docs = kb.spark.read.parquet(f"{kb.sf_dir}/documents.parquet")
    body = F.replace(F.replace("text", F.lit("{"), F.lit("(")), F.lit("}"), F.lit(")"))
    made = docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit('\n{\n"type": "object",\n'), body, F.lit("\n}\nend")).alias("text"),
    )
    return bl.json_schema_blocks(made)


def _pages(kb: KnowledgeBase) -> DataFrame:
    pages = kb.spark.read.parquet(f"{kb.sf_dir}/pages.parquet")
    return pages.select(
        F.col("page_id").alias("id"),
        F.concat(F.lit("assistant: the page\n"), F.replace("html", F.lit("<"), F.lit("\n<"))).alias("text"),
    )


XML_SQL = r"""
, page AS (SELECT page_id AS id, 'assistant: the page' || chr(10) || replace(html, '<', chr(10) || '<') AS t FROM pages),
cut AS (SELECT id, string_split(t, chr(10)) AS l FROM page),
one AS (SELECT id, len(l) AS total, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM cut),
kept AS (SELECT id, n, CASE WHEN n < total THEN line || chr(10) ELSE line END AS line, n < total AS breaks FROM one),
placed AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY id ORDER BY n) - length(line) AS start_at,
         regexp_matches(line, '</?[\p{L}\p{N}_:-]+[\s>]') AS is_tag
  FROM kept WHERE line <> ''
),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY id ORDER BY n) AS run FROM placed WHERE is_tag),
xml AS (
  SELECT id, 'xml_like' AS block_kind, CAST(min(start_at) AS BIGINT) AS start_at, CAST(max(start_at + length(line)) AS BIGINT) AS end_at,
         CAST(sum(breaks::INT) + 1 AS BIGINT) AS line_count
  FROM runs GROUP BY id, run HAVING count(*) >= 4
),
archived AS (
  SELECT *, end_at - start_at AS char_count, row_number() OVER (PARTITION BY id ORDER BY start_at) AS block_no
  FROM xml WHERE end_at - start_at >= 400 OR line_count >= 6
)"""


@query("xml_blocks", XML_SQL + "\nSELECT * FROM xml")
def xml_blocks(kb):
    return bl.xml_blocks(bl.text_lines(_pages(kb)))


@query(
    "archive_blocks",
    XML_SQL
    + """
SELECT a.id, a.block_no, 'ARCHIVED_BLOCK_' || a.block_no AS block_id, a.block_kind, 'assistant' AS speaker, a.line_count, a.char_count,
       substr(p.t, a.start_at + 1, a.char_count) AS raw_text
FROM archived a JOIN page p USING (id)
""",
)
def archive_blocks(kb):
    return bl.archive_blocks(_pages(kb)).select(
        "id", "block_no", "block_id", "block_kind", "speaker", "line_count", "char_count", "raw_text"
    )


@query(
    "working_view",
    XML_SQL
    + """
, gaps AS (SELECT a.*, lag(a.end_at, 1, 0) OVER (PARTITION BY a.id ORDER BY a.start_at) AS from_at FROM archived a),
views AS (
  SELECT g.id, string_agg(substr(p.t, g.from_at + 1, g.start_at - g.from_at) || '[ARCHIVED_BLOCK_' || g.block_no || ']', '' ORDER BY g.block_no)
         || substr(any_value(p.t), max(g.end_at) + 1)
         || chr(10) || '---ARCHIVED BLOCKS---' || chr(10)
         || string_agg('[ARCHIVED_BLOCK_' || g.block_no || '] kind=xml_like speaker=assistant lines=' || g.line_count || ' chars=' || g.char_count, chr(10) ORDER BY g.block_no) AS v
  FROM gaps g JOIN page p USING (id) GROUP BY g.id
)
SELECT p.id, coalesce(v.v, p.t) AS working_view FROM page p LEFT JOIN views v USING (id)
""",
)
def working_view(kb):
    pages = _pages(kb)
    return bl.working_view(pages, bl.archive_blocks(pages)).select("id", "working_view")


@query(
    "block_descriptions",
    XML_SQL
    + r"""
, raw AS (SELECT a.*, substr(p.t, a.start_at + 1, a.char_count) AS raw_text FROM archived a JOIN page p USING (id)),
hits AS (
  SELECT *, regexp_extract_all(raw_text, '(?m)^\s*\$\s+([^\n]+)', 1) AS c,
         regexp_extract_all(raw_text, 'https?://[^\s"''<>)]+|(?:[\w.-]+)?/[\w.-]+(?:/[\w.-]+)+') AS q FROM raw
)
SELECT id, block_no, 'xml' AS block_kind,
       substr('xml block of ' || line_count || ' lines and ' || char_count || ' characters', 1, 120) AS brief_description,
       regexp_matches(raw_text, '(?im)^\s*(you are|you must|do not|never|always|ignore)\b') AS is_instruction_like,
       array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[1:8], '|') AS commands,
       array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i)[1:8], '|') AS paths
FROM hits
""",
)
def block_descriptions(kb):
    """What the model-free description says of every archived block of the pages."""
    d = F.col("archival_description")
    return bl.describe_blocks(bl.archive_blocks(_pages(kb))).select(
        "id", "block_no", d["block_kind"].alias("block_kind"), d["brief_description"].alias("brief_description"),
        d["is_instruction_like"].alias("is_instruction_like"),
        F.array_join(d["commands"], "|").alias("commands"), F.array_join(d["paths"], "|").alias("paths"),
    )


@query("describe_blocks")
def describe_blocks(kb):
    """Archival view of the pages with a description line per block."""
    pages = _pages(kb)
    blocks = bl.describe_blocks(bl.archive_blocks(pages))
    return bl.working_view(pages, blocks, mode="archival").select("id", "working_view")


@query(
    "mixed_blocks",
    """
SELECT doc_id AS id, CAST(1 AS BIGINT) AS block_no, 'fenced_code' AS block_kind, 'user' AS speaker,
       length(text) - length(replace(text, chr(10), '')) + 3 AS line_count, length(text) + 12 AS char_count
FROM documents WHERE length(text) + 12 >= 400 OR length(text) - length(replace(text, chr(10), '')) + 3 >= 6
""",
)
def mixed_blocks(kb):
    return bl.block_spans(_fenced(kb)).select("id", "block_no", "block_kind", "speaker", "line_count", "char_count")
