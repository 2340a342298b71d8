"""Queries over stage tables: upkeep, checks, lists, reports, jobs and streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from colloquy.functions import ids, text as tx
from colloquy.operators import messages as ms
from colloquy.operators import reports as rp
from colloquy.operators import segments as sg
from colloquy.operators import tables as tb
from colloquy.operators.buckets import Store
from colloquy.plans.registry import query
from colloquy.plans.stages import KnowledgeBase
from colloquy.session import durable, new_path
from colloquy.sources.messages import normalize_turns
from colloquy.streaming import jobs as sj

number = lambda c="conv_id": F.substr(F.col(c), F.lit(2)).cast("bigint")


@query(
    "insert_ignore",
    """
, target AS (SELECT segment_id, conv_id, segment_index, 'old' AS origin FROM segments WHERE segment_index % 2 = 0),
batch AS (
  SELECT segment_id, conv_id, segment_index, 'new' AS origin, 1 AS arrival FROM segments
  UNION ALL SELECT segment_id, conv_id, segment_index, 'newer', 2 FROM segments
)
SELECT segment_id, conv_id, segment_index, origin FROM target
UNION ALL SELECT segment_id, conv_id, segment_index, origin FROM batch WHERE arrival = 1 AND segment_index % 2 <> 0
""",
)
def insert_ignore(kb):
    """Half of the segments are stored; the batch brings all of them twice."""
    rows = kb.segments.select("segment_id", "conv_id", "segment_index")
    target = rows.where(F.col("segment_index") % 2 == 0).withColumn("origin", F.lit("old"))
    batch = rows.select("*", F.lit("new").alias("origin"), F.lit(1).alias("arrival")).unionByName(
        rows.select("*", F.lit("newer").alias("origin"), F.lit(2).alias("arrival"))
    )
    return target.unionByName(tb.insert_ignore(target, batch, [["segment_id"]]))


@query(
    "insert_ignore_keys",
    """
, k AS (SELECT statement_id, extract_id, statement_index FROM statements)
SELECT statement_id, extract_id, statement_index, 'a' AS origin FROM k WHERE statement_index % 2 = 0
UNION ALL SELECT statement_id || '_x', extract_id, statement_index, 'b' FROM k WHERE statement_index % 2 <> 0
""",
)
def insert_ignore_keys(kb):
    """Two unique keys: a row goes when either is taken by an earlier row."""
    k = kb.statements.select("statement_id", "extract_id", "statement_index")
    odd = F.col("statement_index") % 2 != 0
    batch = (
        k.where(~odd).select("*", F.lit("a").alias("origin"), F.lit(1).alias("arrival"))
        .unionByName(k.where(odd).select(F.concat("statement_id", F.lit("_x")).alias("statement_id"), "extract_id", "statement_index", F.lit("b").alias("origin"), F.lit(1).alias("arrival")))
        .unionByName(k.select("statement_id", "extract_id", "statement_index", F.lit("c").alias("origin"), F.lit(2).alias("arrival")))
    )
    target = batch.drop("arrival").limit(0)
    return tb.insert_ignore(target, batch, [["statement_id"], ["extract_id", "statement_index"]])


@query(
    "upsert",
    """
SELECT segment_id, CASE WHEN segment_index % 2 = 1 THEN 'v3' ELSE 'v1' END AS version FROM segments
""",
)
def upsert(kb):
    rows = kb.segments.select("segment_id", "segment_index")
    target = rows.select("segment_id", F.lit("v1").alias("version"))
    odd = rows.where(F.col("segment_index") % 2 == 1)
    batch = odd.select("segment_id", F.lit("v2").alias("version"), F.lit(1).alias("arrival")).unionByName(
        odd.select("segment_id", F.lit("v3").alias("version"), F.lit(2).alias("arrival"))
    )
    return tb.upsert(target, batch, ["segment_id"])


def _pointed(kb: KnowledgeBase) -> DataFrame:
    """Fragments of which two in three carry a point id."""
    has = F.col("fragment_index") % 3 != 0
    return kb.fragments.select(
        "fragment_id", "extract_id", "conv_id", "fragment_index",
        F.when(has, F.concat(F.lit("pt_"), "fragment_id")).alias("point_id"),
        F.lit(None).cast("string").alias("embedded_at"),
        F.when(has, "first").alias("embedding_model"),
    )


@query(
    "set_embedding",
    """
SELECT fragment_id, CASE WHEN fragment_index % 4 = 0 THEN 'np_' || fragment_id WHEN fragment_index % 3 <> 0 THEN 'pt_' || fragment_id ELSE '' END AS point_id,
       CASE WHEN fragment_index % 4 = 0 THEN 'second' WHEN fragment_index % 3 <> 0 THEN 'first' ELSE '' END AS embedding_model
FROM fragments
""",
)
def set_embedding(kb):
    fragments = durable(_pointed(kb), "fragments")
    new = fragments.where(F.col("fragment_index") % 4 == 0).select(
        "fragment_id", F.concat(F.lit("np_"), "fragment_id").alias("point_id"),
        F.lit("2024-01-01").alias("embedded_at"), F.lit("second").alias("embedding_model"),
    )
    return tb.set_embedding(fragments, new).select(
        "fragment_id", F.coalesce("point_id", F.lit("")).alias("point_id"), F.coalesce("embedding_model", F.lit("")).alias("embedding_model")
    )


def _even(kb: KnowledgeBase) -> DataFrame:
    return kb.segments.where(number() % 2 == 0).select("conv_id").distinct()


EVEN = "CAST(substr(conv_id, 2) AS BIGINT) % 2 = 0"


@query("delete_segments", f"SELECT segment_id FROM segments WHERE NOT ({EVEN} AND segment_index >= 1)")
def delete_segments(kb):
    ask = kb.segments.where("segment_index >= 1").select("segment_id")
    return tb.delete_segments(kb.segments, _even(kb), ask).select("segment_id")


@query("delete_segment_summaries", f"SELECT segment_id || '_ss' AS segment_summary_id FROM segments WHERE NOT ({EVEN})")
def delete_segment_summaries(kb):
    summaries = kb.segments.select(ids.summary_id(F.col("segment_id")).alias("segment_summary_id"), "segment_id")
    gone = kb.segments.join(_even(kb), "conv_id", "left_semi")
    return tb.delete_segment_summaries(summaries, gone).select("segment_summary_id")


def _cascade(kb: KnowledgeBase) -> tuple[dict[str, DataFrame], DataFrame]:
    tables = {"links": kb.links, "fragments": durable(_pointed(kb), "fragments"), "extracts": kb.extracts, "statements": kb.statements}
    gone = kb.extracts.where(tb.in_range(F.col("segment_index"), 1, 2)).join(_even(kb), "conv_id", "left_semi")
    return tables, gone


GONE = f"(SELECT extract_id FROM extracts WHERE {EVEN} AND segment_index BETWEEN 1 AND 2)"


@query(
    "delete_extracts",
    f"""
SELECT 'extracts' AS "table", extract_id AS id FROM extracts WHERE extract_id NOT IN {GONE}
UNION ALL SELECT 'fragments', fragment_id FROM fragments WHERE extract_id NOT IN {GONE}
UNION ALL SELECT 'links', l.fragment_id || '/' || l.statement_id FROM links l JOIN fragments f USING (fragment_id) WHERE f.extract_id NOT IN {GONE}
UNION ALL SELECT 'points', 'pt_' || fragment_id FROM fragments WHERE fragment_index % 3 <> 0 AND extract_id IN {GONE}
UNION ALL SELECT 'statements', statement_id FROM statements WHERE extract_id NOT IN {GONE}
""",
)
def delete_extracts(kb):
    tables, gone = _cascade(kb)
    after = tb.delete_extracts(tables, gone)
    key = {
        "extracts": F.col("extract_id"), "fragments": F.col("fragment_id"), "statements": F.col("statement_id"),
        "links": F.concat("fragment_id", F.lit("/"), "statement_id"), "points": F.col("point_id"),
    }
    parts = [after[name].select(F.lit(name).alias("table"), column.alias("id")) for name, column in key.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@query(
    "stored_deletes",
    f"""
SELECT 'extracts' AS "table", extract_id AS id FROM extracts WHERE extract_id NOT IN {GONE}
UNION ALL SELECT 'fragments', fragment_id FROM fragments WHERE extract_id NOT IN {GONE}
UNION ALL SELECT 'links', l.fragment_id || '/' || l.statement_id FROM links l JOIN fragments f USING (fragment_id) WHERE f.extract_id NOT IN {GONE}
UNION ALL SELECT 'points', 'pt_' || fragment_id FROM fragments WHERE fragment_index % 3 <> 0 AND extract_id IN {GONE}
UNION ALL SELECT 'statements', statement_id FROM statements WHERE extract_id NOT IN {GONE}
""",
)
def stored_deletes(kb):
    """The same cascade on tables stored in key buckets, of which it rewrites the touched ones."""
    tables, gone = _cascade(kb)
    names = ("extracts", "fragments", "statements", "links")
    store = Store.of(kb.spark, new_path(kb.spark, "store"), {name: tables[name] for name in names}, 16)
    after = {"points": store.delete_extracts(gone), **{name: store[name].read() for name in names}}
    key = {
        "extracts": F.col("extract_id"), "fragments": F.col("fragment_id"), "statements": F.col("statement_id"),
        "links": F.concat("fragment_id", F.lit("/"), "statement_id"), "points": F.col("point_id"),
    }
    return reduce(DataFrame.unionByName, [after[name].select(F.lit(name).alias("table"), column.alias("id")) for name, column in key.items()])


@query(
    "stored_upsert",
    """
SELECT segment_id, CASE WHEN segment_index % 2 = 1 THEN 'v3' ELSE 'v1' END AS version FROM segments
UNION ALL SELECT 'new_' || segment_id, 'v3' FROM segments WHERE segment_index = 0
""",
)
def stored_upsert(kb):
    """Upserts into a table in key buckets: new rows, and replacements of every second one."""
    rows = kb.segments.select("conv_id", "segment_id", "segment_index")
    target = rows.select("conv_id", "segment_id", F.lit("v1").alias("version"))
    store = Store.of(kb.spark, new_path(kb.spark, "store"), {"segments": target}, 16)
    for version in ("v2", "v3"):
        odd = rows.where(F.col("segment_index") % 2 == 1).select("conv_id", "segment_id")
        first = rows.where("segment_index = 0").select("conv_id", F.concat(F.lit("new_"), "segment_id").alias("segment_id"))
        batch = odd.unionByName(first).select("*", F.lit(version).alias("version"), F.lit(1).alias("arrival"))
        store["segments"].upsert(batch, ["segment_id"])
    return store["segments"].read().select("segment_id", "version")


@query(
    "delete_fragments",
    f"""
SELECT 'fragments' AS "table", fragment_id AS id FROM fragments WHERE extract_id NOT IN {GONE}
UNION ALL SELECT 'links', l.fragment_id || '/' || l.statement_id FROM links l JOIN fragments f USING (fragment_id) WHERE f.extract_id NOT IN {GONE}
UNION ALL SELECT 'points', 'pt_' || fragment_id FROM fragments WHERE fragment_index % 3 <> 0 AND extract_id IN {GONE}
""",
)
def delete_fragments(kb):
    tables, gone = _cascade(kb)
    after = tb.delete_fragments(tables, gone)
    links = after["links"].select(F.lit("links").alias("table"), F.concat("fragment_id", F.lit("/"), "statement_id").alias("id"))
    return links.unionByName(after["fragments"].select(F.lit("fragments").alias("table"), F.col("fragment_id").alias("id"))).unionByName(
        after["points"].select(F.lit("points").alias("table"), F.col("point_id").alias("id"))
    )


@query(
    "delete_vectors",
    "SELECT 'pt_' || fragment_id AS point_id FROM fragments WHERE fragment_index % 2 <> 0",
)
def delete_vectors(kb):
    fragments = durable(kb.fragments, "fragments")
    points = fragments.select(F.concat(F.lit("pt_"), "fragment_id").alias("point_id"))
    gone = fragments.where(F.col("fragment_index") % 2 == 0).select(F.concat(F.lit("pt_"), "fragment_id").alias("point_id"))
    return tb.delete_keys(points, gone, "point_id")


@query(
    "delete_topics",
    f"""
SELECT 'topics' AS "table", printf('%s_t%03d', conv_id, segment_index) AS id FROM segments WHERE NOT ({EVEN})
UNION ALL SELECT 'topic_segments', printf('%s_t%03d', conv_id, segment_index) || '/' || segment_id FROM segments WHERE NOT ({EVEN})
""",
)
def delete_topics(kb):
    """Each segment its own topic; even conversations lose theirs."""
    topic = ids.topic_id(F.col("conv_id"), F.col("segment_index"))
    topics, members = tb.delete_topics(
        kb.segments.select(topic.alias("topic_id"), "conv_id"), kb.segments.select(topic.alias("topic_id"), "segment_id"), _even(kb)
    )
    return topics.select(F.lit("topics").alias("table"), F.col("topic_id").alias("id")).unionByName(
        members.select(F.lit("topic_segments").alias("table"), F.concat("topic_id", F.lit("/"), "segment_id").alias("id"))
    )


@query(
    "fk_violations",
    """
SELECT 'extract_statements' AS "table", 'extract_id' AS "column", extract_id AS value, count(*) AS rows FROM statements s
WHERE EXISTS (SELECT 1 FROM extracts e WHERE e.extract_id = s.extract_id AND e.segment_index % 3 = 2) GROUP BY extract_id
UNION ALL
SELECT 'fragments', 'extract_id', extract_id, count(*) FROM fragments f
WHERE EXISTS (SELECT 1 FROM extracts e WHERE e.extract_id = f.extract_id AND e.segment_index % 3 = 2) GROUP BY extract_id
""",
)
def fk_violations(kb):
    """Every third extract is missing: its statements and fragments are orphans."""
    tables = dict(kb.stored)
    tables["extracts"] = tables["extracts"].where(F.col("segment_index") % 3 != 2)
    return tb.fk_violations(tables)


@query(
    "unique_violations",
    """
SELECT 'segments' AS "table", 'segment_id' AS rule, segment_id AS value, CAST(2 AS BIGINT) AS rows FROM segments WHERE segment_index % 2 = 1
UNION ALL SELECT 'segments', 'conv_id,segment_index', conv_id || '|' || segment_index, 2 FROM segments WHERE segment_index % 2 = 1
UNION ALL SELECT 'jobs', 'status', event_type, count(*) FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY event_type
""",
)
def unique_violations(kb):
    """Odd segments are stored twice; raw event types are no job states."""
    twice = kb.segments.unionByName(kb.segments.where(F.col("segment_index") % 2 == 1))
    events = kb.spark.read.parquet(f"{kb.sf_dir}/events.parquet")
    jobs = events.select(F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("status"))
    return tb.unique_violations({"segments": twice, "jobs": jobs, "extracts": kb.extracts})


@query(
    "resume_plan",
    """
SELECT segment_id, CASE WHEN segment_index % 5 = 4 THEN 'summary' ELSE 'extract' END AS stage FROM segments WHERE segment_index % 5 IN (1, 2, 4)
UNION ALL SELECT segment_id, 'extract' FROM segments WHERE segment_index % 5 = 4
""",
)
def resume_plan(kb):
    """0 ok, 1 skipped, 2 partial, 3 degraded, 4 not done; summaries go by presence."""
    n = F.col("segment_index") % 5
    status = F.when(n == 1, "skipped").when(n == 2, "partial").when(n == 3, "degraded").otherwise("ok")
    done = kb.segments.where(n != 4).select("segment_id", status.alias("status"))
    extract = tb.resume_plan(kb.segments, done, "segment_id").select("segment_id", F.lit("extract").alias("stage"))
    summary = tb.resume_plan(kb.segments, done, "segment_id", on_presence=True).select("segment_id", F.lit("summary").alias("stage"))
    return extract.unionByName(summary)


@query(
    "force_rerun",
    f"SELECT segment_id, CASE WHEN {EVEN} AND segment_index >= 1 THEN 'again' ELSE 'kept' END AS run FROM segments",
)
def force_rerun(kb):
    rows = kb.segments.select("segment_id", "conv_id", "segment_index")
    table, fresh = rows.withColumn("run", F.lit("kept")), rows.withColumn("run", F.lit("again"))
    return tb.force_rerun(table, fresh, _even(kb), 1).select("segment_id", "run")


@query(
    "force_rerun_cascade",
    f"""
SELECT 'extracts' AS "table", extract_id AS id, CASE WHEN extract_id IN {GONE} THEN 'again' ELSE 'kept' END AS run FROM extracts
UNION ALL SELECT 'fragments', fragment_id, CASE WHEN extract_id IN {GONE} THEN 'again' ELSE 'kept' END FROM fragments
UNION ALL SELECT 'links', l.fragment_id || '/' || l.statement_id, CASE WHEN f.extract_id IN {GONE} THEN 'again' ELSE 'kept' END FROM links l JOIN fragments f USING (fragment_id)
UNION ALL SELECT 'points', 'pt_' || fragment_id, '' FROM fragments WHERE fragment_index % 3 <> 0 AND extract_id IN {GONE}
UNION ALL SELECT 'statements', statement_id, CASE WHEN extract_id IN {GONE} THEN 'again' ELSE 'kept' END FROM statements
""",
)
def force_rerun_cascade(kb):
    """Extraction run anew for two segments of every second conversation."""
    tables, _ = _cascade(kb)
    marked = lambda run: {name: df.withColumn("run", F.lit(run)) for name, df in tables.items()}
    after = tb.force_rerun_cascade(marked("kept"), marked("again"), _even(kb), 1, 2)
    key = {
        "extracts": F.col("extract_id"), "fragments": F.col("fragment_id"), "statements": F.col("statement_id"),
        "links": F.concat("fragment_id", F.lit("/"), "statement_id"),
    }
    rows = after["points"].select(F.lit("points").alias("table"), F.col("point_id").alias("id"), F.lit("").alias("run"))
    for name, column in key.items():
        rows = rows.unionByName(after[name].select(F.lit(name).alias("table"), column.alias("id"), "run"))
    return rows


@query(
    "count_all",
    """
SELECT 'conversations' AS "table", count(*) AS rows FROM conversations_dim UNION ALL SELECT 'segments', count(*) FROM segments
UNION ALL SELECT 'extracts', count(*) FROM extracts UNION ALL SELECT 'extract_statements', count(*) FROM statements
UNION ALL SELECT 'fragments', count(*) FROM fragments UNION ALL SELECT 'fragment_statement_links', count(*) FROM links
UNION ALL SELECT 'source_files', count(*) FROM sources UNION ALL SELECT 'jobs', count(DISTINCT user_id) FROM events
""",
)
def count_all(kb):
    jobs = kb.spark.read.parquet(f"{kb.sf_dir}/events.parquet").select("user_id").distinct()
    return rp.count_all({**kb.stored, "jobs": jobs})


@query(
    "extract_counts",
    """
SELECT c.conv_id, count(e.extract_id) AS extract_count, count(e.extract_id) > 0 AS has_extracts
FROM conversations_dim c LEFT JOIN extracts e USING (conv_id) GROUP BY c.conv_id
""",
)
def extract_counts(kb):
    return rp.extract_counts(kb.conversations, kb.extracts)


@query("link_counts", "SELECT fragment_id, statement_count AS link_count FROM fragments")
def link_counts(kb):
    return rp.link_counts(kb.fragments, kb.links)


@query(
    "recent_records",
    """
, e AS (
  SELECT 'source_files' AS entity, source_file_id AS id, original_filename AS label, created_at FROM sources
  UNION ALL SELECT 'conversations', conv_id, coalesce(title, conv_id), conversation_date FROM conversations_dim
  UNION ALL SELECT 'segments', segment_id, 'Seg #' || segment_index || ' — ' || conv_id, conversation_date FROM segments
  UNION ALL SELECT 'extracts', extract_id, extract_id, created_at FROM extracts
  UNION ALL SELECT 'fragments', fragment_id, fragment_id, s.conversation_date FROM fragments f JOIN segments s USING (segment_id)
)
SELECT entity, id, label, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM e
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY created_at DESC, id) <= 10
""",
)
def recent_records(kb):
    c = F.col
    dated = kb.fragments.select("fragment_id", "segment_id").join(kb.segments.select("segment_id", "conversation_date"), "segment_id")
    entities = {
        "source_files": (kb.sources, c("source_file_id"), c("original_filename"), c("created_at")),
        "conversations": (kb.conversations, c("conv_id"), F.coalesce("title", "conv_id"), c("conversation_date")),
        "segments": (kb.segments, c("segment_id"), F.format_string("Seg #%d — %s", "segment_index", "conv_id"), c("conversation_date")),
        "extracts": (kb.extracts, c("extract_id"), c("extract_id"), c("created_at")),
        "fragments": (dated, c("fragment_id"), c("fragment_id"), c("conversation_date")),
    }
    return rp.recent_records(entities).withColumn("created_at", tx.iso(c("created_at")))


@query(
    "list_page",
    """
SELECT conv_id, strftime(conversation_date, '%Y-%m-%dT%H:%M:%SZ') AS conversation_date FROM conversations_dim
ORDER BY conversations_dim.conversation_date DESC, conv_id LIMIT 20 OFFSET 10
""",
)
def list_page(kb):
    return rp.list_page(kb.conversations, "conversation_date", "conv_id", 20, 10).select(
        "conv_id", tx.iso(F.col("conversation_date")).alias("conversation_date")
    )


@query(
    "children",
    """
SELECT 'segments' AS "table", conv_id AS parent, segment_id AS id, segment_index AS position FROM segments
UNION ALL SELECT 'statements', extract_id, statement_id, statement_index FROM statements
UNION ALL SELECT 'fragments', extract_id, fragment_id, fragment_index FROM fragments
""",
)
def children(kb):
    """Segments, statements and fragments below their parent, in order."""
    def below(name, df, parent, key, position):
        return df.select(F.lit(name).alias("table"), F.col(parent).alias("parent"), F.col(key).alias("id"), F.col(position).alias("position"))

    rows = below("segments", kb.segments, "conv_id", "segment_id", "segment_index")
    rows = rows.unionByName(below("statements", kb.statements, "extract_id", "statement_id", "statement_index"))
    rows = rows.unionByName(below("fragments", kb.fragments, "extract_id", "fragment_id", "fragment_index"))
    return rp.ordered_children(rows)


@query("lookup", "SELECT extract_id, segment_id, status FROM extracts WHERE segment_index = 0")
def lookup(kb):
    keys = kb.segments.where("segment_index = 0").select(ids.extract_id(F.col("segment_id")).alias("extract_id"))
    return rp.lookup(kb.extracts, keys, "extract_id").select("extract_id", "segment_id", "status")


@query(
    "lineage",
    """
SELECT s.source_file_id, coalesce(c.conv_id, '') AS conv_id, coalesce(g.segment_id, '') AS segment_id, coalesce(e.extract_id, '') AS extract_id,
       coalesce((SELECT string_agg(statement_id, ',' ORDER BY statement_index) FROM statements t WHERE t.extract_id = e.extract_id), '') AS statements,
       coalesce((SELECT string_agg(fragment_id, ',' ORDER BY fragment_index) FROM fragments f WHERE f.extract_id = e.extract_id), '') AS fragments
FROM sources s LEFT JOIN conversations_dim c ON s.source_file_id IN (c.raw_source_file_id, c.normalized_source_file_id)
LEFT JOIN segments g ON g.conv_id = c.conv_id LEFT JOIN extracts e ON e.segment_id = g.segment_id
""",
)
def lineage(kb):
    rows = rp.lineage(kb.sources, kb.tables)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        "source_file_id", blank("conv_id"), blank("segment_id"), blank("extract_id"),
        F.array_join(F.transform("statements", lambda s: s["statement_id"]), ",").alias("statements"),
        F.array_join(F.transform("fragments", lambda f: f["fragment_id"]), ",").alias("fragments"),
    )


@query(
    "source_conversations",
    """
SELECT s.source_file_id, c.conv_id FROM sources s JOIN conversations_dim c
ON s.source_file_id = c.raw_source_file_id OR s.source_file_id = c.normalized_source_file_id
""",
)
def source_conversations(kb):
    return rp.source_conversations(kb.conversations, kb.sources)


@query("conversation_fragments", "SELECT conv_id, fragment_id, fragment_index FROM fragments")
def conversation_fragments(kb):
    return rp.conversation_fragments(kb.fragments.drop("conv_id"), kb.extracts).select("conv_id", "fragment_id", "fragment_index")


@query(
    "index_coverage",
    """
SELECT count(*) AS fragments, count(*) FILTER (fragment_index % 3 <> 0) AS with_vector, count(*) FILTER (fragment_index % 3 = 0) AS without_vector FROM fragments
""",
)
def index_coverage(kb):
    return rp.index_coverage(_pointed(kb))


@query(
    "run_report",
    """
SELECT conv_id, count(*) AS total, count(*) FILTER (segment_index % 2 = 0) AS "new", count(*) FILTER (segment_index % 2 = 1) AS reused,
       CAST(coalesce(sum(100 + segment_index) FILTER (segment_index % 2 = 0), 0) AS BIGINT) AS latency_ms, count(*) FILTER (segment_index % 3 = 2) AS not_ok
FROM segments GROUP BY conv_id
""",
)
def run_report(kb):
    n = F.col("segment_index")
    run = kb.segments.select(
        "segment_id", "conv_id", (n + 100).alias("latency_ms"), F.when(n % 3 == 2, "partial").otherwise("ok").alias("status")
    )
    return rp.run_report(run, kb.segments.where(n % 2 == 1), "segment_id", ["conv_id"])


def _events(kb: KnowledgeBase) -> DataFrame:
    """Job log made from events: a user is a job, clicks are ignored."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "pending").when(kind == "view", "running")
        .when(kind == "purchase", "succeeded").when(kind == "error", "failed")
    )
    events = kb.spark.read.parquet(f"{kb.sf_dir}/events.parquet").where(kind != "click")
    return events.select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"),
        status.alias("status"),
        F.col("ts").alias("at"),
        "event_id",
        F.when(status == "succeeded", F.col("props")).alias("result"),
        F.when(status == "failed", F.concat(F.lit("value "), F.col("event_id").cast("string"))).alias("error"),
    )


JOBS_SQL = """
, log AS (
  SELECT 'job_' || user_id AS job_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status,
         ts, event_id, CASE WHEN event_type = 'purchase' THEN props END AS result, CASE WHEN event_type = 'error' THEN 'value ' || event_id END AS error
  FROM events WHERE event_type <> 'click'
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM log),
latest AS (SELECT * FROM ranked WHERE r = 1),
times AS (
  SELECT job_id, min(ts) FILTER (status = 'running') AS started, max(ts) FILTER (status IN ('succeeded', 'failed')) AS finished, count(*) AS events FROM log GROUP BY job_id
)"""


@query(
    "job_events",
    JOBS_SQL + "\nSELECT job_id, status, event_id, coalesce(result, '') AS result, coalesce(error, '') AS error FROM log",
)
def job_events(kb):
    """The log as appended to its table and read back."""
    path = new_path(kb.spark, "jobs")
    log = rp.job_events(_events(kb).select("*", F.lit("extract").alias("job_type"), F.lit(None).cast("string").alias("input")), "event_id")
    tb.append_table(log, path)
    return kb.spark.read.parquet(path).select(
        "job_id", "status", "event_id", F.coalesce("result", F.lit("")).alias("result"), F.coalesce("error", F.lit("")).alias("error")
    )


@query(
    "job_state",
    JOBS_SQL
    + """
SELECT l.job_id, l.status, t.events, coalesce(l.result, '') AS result, coalesce(l.error, '') AS error,
       coalesce(CAST(json_extract(l.result, '$.k') AS BIGINT), -1) AS k,
       coalesce(epoch_us(t.finished) - epoch_us(t.started), 0) // 1000000 AS duration
FROM latest l JOIN times t USING (job_id)
""",
)
def job_state(kb):
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    state = rp.job_state(_events(kb))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    whole = F.coalesce(micros("finished_at") - micros("started_at"), F.lit(0))
    return state.select(
        "job_id", "status", "events", blank("result"), blank("error"),
        F.coalesce(F.try_variant_get("result_json", "$.k", "bigint"), F.lit(-1)).alias("k"),
        F.floor(whole / 1_000_000).alias("duration"),
    )


@query("job_counts", JOBS_SQL + "\nSELECT status, count(*) AS jobs FROM latest GROUP BY status")
def job_counts(kb):
    return rp.job_counts(rp.job_state(_events(kb)))


@query(
    "job_result",
    """
, ranked AS (SELECT 'job_' || user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT job_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (r <= 50) AS ids, any_value(total) AS total, any_value(total) > 50 AS truncated FROM ranked GROUP BY job_id
""",
)
def job_result(kb):
    events = kb.spark.read.parquet(f"{kb.sf_dir}/events.parquet")
    rows = events.select(F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"), "event_id")
    return rp.job_result(rows, "job_id", "event_id", 50).withColumn(
        "ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    )


def _turn_stream(kb: KnowledgeBase) -> DataFrame:
    """The turns table as a file stream of visible messages."""
    stream = sj.table_stream(kb.spark, f"{kb.sf_dir}/conversations.parquet")
    return normalize_turns(stream).where(F.col("speaker").isin("user", "assistant"))


STREAM_PARTS = 3


def _fed(kb: KnowledgeBase, columns: list[str], sink: Callable[[DataFrame, int], None], log: str, copies: int = 1) -> None:
    """Run visible turns through a sink in three batches, later turns partly before earlier
    ones. Each batch is a folder that Spark writes and reads with its own parallelism."""
    source = new_path(kb.spark, "stream-source")
    turns = kb.turns.where(F.col("speaker").isin("user", "assistant")).select(*columns)
    stream = kb.spark.readStream.schema(turns.schema).parquet(f"{source}/part=*").withColumn("arrival", F.col("ordinal"))
    for n in range(STREAM_PARTS):
        part = turns.where(F.col("ordinal") % STREAM_PARTS == STREAM_PARTS - 1 - n)
        for _ in range(copies):
            part.write.mode("append").parquet(f"{source}/part={n}")
        sj.run_available(stream, sink, log)


@query("stream_messages", "SELECT conv_id, message_id, speaker, ordinal FROM messages")
def stream_messages(kb):
    """Messages streamed twice over in several batches, out of order; ids are stored once."""
    out = new_path(kb.spark, "stream")
    columns = ["conv_id", "message_id", "speaker", "ordinal", "created_at"]
    _fed(kb, columns, sj.insert_ignore_sink(out, ["conv_id", "message_id"], "arrival"), f"{out}/log", copies=2)
    return sj.stored_rows(kb.spark, out).select("conv_id", "message_id", "speaker", "ordinal")


@query(
    "stream_late_messages",
    """
SELECT m.conv_id, m.message_id FROM messages m
WHERE EXISTS (SELECT 1 FROM messages e WHERE e.conv_id = m.conv_id AND e.ordinal > m.ordinal AND e.ordinal % 3 > m.ordinal % 3)
""",
)
def stream_late_messages(kb):
    """Messages older than what their conversation had before their batch."""
    out = new_path(kb.spark, "stream")
    sink = sj.insert_ignore_sink(out, ["conv_id", "message_id"], "arrival", late=("conv_id", "created_at"))
    _fed(kb, ["conv_id", "message_id", "ordinal", "created_at"], sink, f"{out}/log")
    return sj.late_rows(kb.spark, out).select("conv_id", "message_id")


@query("stream_segments", "SELECT segment_id, conv_id, segment_index, message_ids, segment_text FROM segments")
def stream_segments(kb):
    """Streamed segments, with the open ones flushed at the end."""
    out = new_path(kb.spark, "stream")
    sj.run_available(_turn_stream(kb), sj.segment_sink(out), f"{out}/log")
    segments, _ = sj.flush_segments(kb.spark, out)
    return segments.select("segment_id", "conv_id", "segment_index", F.array_join("message_ids", ",").alias("message_ids"), "segment_text")


@query("late_messages", "SELECT segment_id, conv_id, segment_index, segment_text FROM segments")
def late_messages(kb):
    """Segments of the first four turns, cut again once the later turns are there."""
    messages = kb.messages.drop("position", "segment_index")
    early = durable(sg.segment_conversations(ms.linear_messages(messages.where("ordinal < 4"))), "early")
    late = messages.where("ordinal >= 4")
    return sj.resegment(early, messages, late).select("segment_id", "conv_id", "segment_index", "segment_text")


@query("stream_insert_ignore", "SELECT conv_id, message_id, content FROM messages")
def stream_insert_ignore(kb):
    out = new_path(kb.spark, "stream")
    stream = _turn_stream(kb).select("conv_id", "message_id", "content", F.col("ordinal").alias("arrival"))
    sj.run_available(stream.unionByName(stream), sj.insert_ignore_sink(out, ["conv_id", "message_id"], "arrival"), f"{out}/log")
    return sj.stored_rows(kb.spark, out).select("conv_id", "message_id", "content")


@query(
    "stream_job_state",
    """
, log AS (
  SELECT 'job_' || user_id AS job_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status, event_id
  FROM events WHERE event_type <> 'click'
),
chained AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY event_id) AS before FROM log),
judged AS (
  SELECT *, NOT coalesce((before IS NULL AND status = 'pending') OR (before = 'pending' AND status = 'running') OR (before = 'running' AND status IN ('succeeded', 'failed')), false) AS illegal FROM chained
)
SELECT job_id, arg_max(status, event_id) AS status, count(*) FILTER (illegal) AS illegal FROM judged GROUP BY job_id
""",
)
def stream_job_state(kb):
    """Last status of every job, and how many of its transitions are not allowed."""
    out = new_path(kb.spark, "stream")
    kind = F.col("event_type")
    stream = sj.table_stream(kb.spark, f"{kb.sf_dir}/events.parquet").where(kind != "click").select(
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"),
        F.when(kind == "signup", "pending").when(kind == "view", "running").when(kind == "purchase", "succeeded").otherwise("failed").alias("status"),
        F.col("ts").alias("at"),
        "event_id",
    )
    sj.run_available(stream, sj.job_state_sink(out), f"{out}/log")
    state = kb.spark.read.parquet(f"{out}/state/batch={sj.last_batch(kb.spark, out)}")
    illegal = kb.spark.read.parquet(f"{out}/illegal").groupBy("job_id").agg(F.count("*").alias("illegal"))
    return state.select("job_id", "status").join(illegal, "job_id", "left").select(
        "job_id", "status", F.coalesce("illegal", F.lit(0)).alias("illegal")
    )
