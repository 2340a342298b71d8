"""Counts, lists, lineage and run reports over the stage tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import text as tx
from colloquy.schemas import JOB_STATUSES

PAGE_LIMIT = 100
RECENT_ROWS = 10
RESULT_IDS = 200

# Texts that stand in for absent parts of a report.
NO_SUMMARY = "No summary available."
NO_ACTIONS = "*No action items identified.*"
DEGRADED_BADGE = " *(Degraded)*"


def count_all(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of all tables in one job."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def extract_counts(conversations: DataFrame, extracts: DataFrame) -> DataFrame:
    counts = extracts.groupBy("conv_id").agg(F.count("*").alias("extract_count"))
    return conversations.select("conv_id").join(counts, "conv_id", "left").select(
        "conv_id",
        F.coalesce("extract_count", F.lit(0)).alias("extract_count"),
        F.col("extract_count").isNotNull().alias("has_extracts"),
    )


def link_counts(fragments: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy("fragment_id").agg(F.count("*").alias("link_count"))
    return fragments.select("fragment_id").join(counts, "fragment_id", "left").select(
        "fragment_id", F.coalesce("link_count", F.lit(0)).alias("link_count")
    )


def list_page(rows: DataFrame, created: str, key: str, limit: int = PAGE_LIMIT, offset: int = 0) -> DataFrame:
    """Newest rows first; the key breaks ties."""
    return rows.orderBy(F.col(created).desc(), key).offset(offset).limit(limit)


def recent_records(entities: dict[str, tuple[DataFrame, Column, Column, Column]], n: int = RECENT_ROWS) -> DataFrame:
    """The ``n`` newest rows of every entity; each list is a top-n of its own."""
    parts = []
    for name, (df, key, label, created) in entities.items():
        top = df.select(key.alias("id"), label.alias("label"), created.alias("created_at"))
        top = top.orderBy(F.col("created_at").desc(), "id").limit(n)
        parts.append(top.select(F.lit(name).alias("entity"), "id", "label", "created_at"))
    return reduce(DataFrame.unionByName, parts)


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of many keys at once; unknown keys give nothing."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def source_conversations(conversations: DataFrame, sources: DataFrame) -> DataFrame:
    """Conversations whose raw or normalized file is a given source.

    Two equal-key joins and a union: an OR condition would compare all pairs.
    """
    def by(column: str) -> DataFrame:
        return conversations.join(
            sources.select(F.col("source_file_id").alias(column)), column
        ).select(F.col(column).alias("source_file_id"), "conv_id")

    return by("raw_source_file_id").unionByName(by("normalized_source_file_id")).distinct()


def conversation_fragments(fragments: DataFrame, extracts: DataFrame) -> DataFrame:
    return fragments.join(extracts.select("extract_id", "conv_id"), "extract_id")


def index_coverage(fragments: DataFrame) -> DataFrame:
    return fragments.agg(
        F.count("*").alias("fragments"),
        F.count("point_id").alias("with_vector"),
        F.count_if(F.col("point_id").isNull()).alias("without_vector"),
    )


def run_report(rows: DataFrame, existing: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Latency, new and reused rows of a run, per group."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return (
        rows.join(known, key, "left")
        .groupBy(*group)
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("_known").isNull()).alias("new"),
            F.count_if(F.col("_known").isNotNull()).alias("reused"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("latency_ms"))), F.lit(0)).alias("latency_ms"),
            F.count_if(F.col("status") != "ok").alias("not_ok"),
        )
    )


def lineage(sources: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Source → conversation → segment → extract → (statements, fragments).

    One row per segment; absent parts are null or empty. Nested lists belong to one
    extract, so their size is that of one segment's contents.
    """
    statements = tables["statements"].groupBy("extract_id").agg(
        F.array_sort(F.collect_list(F.struct("statement_index", "statement_id"))).alias("statements")
    )
    fragments = tables["fragments"].groupBy("extract_id").agg(
        F.array_sort(F.collect_list(F.struct("fragment_index", "fragment_id"))).alias("fragments")
    )
    chain = (
        sources.select("source_file_id")
        .join(source_conversations(tables["conversations"], sources), "source_file_id", "left")
        .join(tables["segments"].select("conv_id", "segment_id", "segment_index"), "conv_id", "left")
        .join(tables["extracts"].select("segment_id", "extract_id"), "segment_id", "left")
        .join(statements, "extract_id", "left")
        .join(fragments, "extract_id", "left")
    )
    return chain.select(
        "source_file_id",
        "conv_id",
        "segment_id",
        "extract_id",
        F.coalesce("statements", F.array().cast(statements.schema["statements"].dataType)).alias("statements"),
        F.coalesce("fragments", F.array().cast(fragments.schema["fragments"].dataType)).alias("fragments"),
    )


def ordered_children(rows: DataFrame) -> DataFrame:
    """Children (table, parent, id, position) in the order of their parent."""
    return rows.orderBy("table", "parent", "position")


def job_events(created: DataFrame, tie: str = "event_id") -> DataFrame:
    """Events in log form; rows with a status outside the allowed four are left out."""
    columns = ["job_id", tie, "status", "at", "job_type", "input", "result", "error"]
    return created.where(F.col("status").isin(*JOB_STATUSES)).select(*columns)


def job_state(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """The state of every job: its last event, times, and the decoded result.

    Only running aggregates are kept, so one busy job is no burden.
    """
    at = F.struct("at", tie)
    ended = F.col("status").isin("succeeded", "failed")
    return (
        events.groupBy("job_id")
        .agg(
            F.max_by("status", at).alias("status"),
            F.min("at").alias("created_at"),
            F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
            F.max(F.when(ended, F.col("at"))).alias("finished_at"),
            F.max_by("result", F.when(F.col("status") == "succeeded", at)).alias("_result"),
            F.max_by("error", F.when(F.col("status") == "failed", at)).alias("_error"),
            F.count("*").alias("events"),
        )
        .withColumn("result", F.when(F.col("status") == "succeeded", F.col("_result")))
        .withColumn("error", F.when(F.col("status") == "failed", F.col("_error")))
        .withColumn("result_json", F.try_parse_json("result"))
        .withColumn("duration_s", F.round(F.unix_micros(F.col("finished_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6, 3))
        .drop("_result", "_error")
    )


def job_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("jobs"))


def job_result(ids: DataFrame, group: str, key: str, limit: int = RESULT_IDS) -> DataFrame:
    """The first ``limit`` ids of each job in order, the full count, and a flag.

    ``row_number() <= limit`` cuts every map task's rows before the shuffle.
    """
    order = Window.partitionBy(group).orderBy(key)
    totals = ids.groupBy(group).agg(F.count("*").alias("total"))
    first = (
        ids.select(group, key)
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= limit)
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(key)).alias("ids"))
    )
    return totals.join(first, group).select(group, "ids", "total", (F.col("total") > limit).alias("truncated"))


def contract_check(rows: DataFrame, schema_name: str, providers: tuple[str, ...]) -> DataFrame:
    """Summary contract: required fields fail, length limits warn.

    Adds ``failures`` and ``warnings`` (rule names).
    """
    def rule(broken: Column, name: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), name)

    def missing(name: str) -> Column:
        return rule(F.col(name).isNull(), f"{name} missing")

    required = ["summary", "bullets", "action_items", "confidence", "schema", "schema_version", "provider", "model", "created_at", "source_file"]
    word_count = F.size(tx.words(F.col("summary")))
    long_item = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.length(x) > 200)
    fails = [missing(c) for c in required] + [
        rule(~F.col("confidence").between(0.0, 1.0), "confidence out of range"),
        rule(F.col("schema") != schema_name, "schema name"),
        rule(~F.col("schema_version").rlike(r"^1\.\d+\.\d+$"), "schema version"),
        rule(~F.col("provider").isin(*providers), "provider"),
        rule(F.col("model") == "", "model empty"),
        rule(~F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), "created_at format"),
        rule(F.col("latency_ms") < 0, "latency negative"),
        rule(~F.col("status").isin("ok", "degraded"), "status"),
    ]
    warns = [
        rule(word_count > 250, "summary over 250 words"),
        rule(~F.size("bullets").between(3, 10), "bullets count"),
        rule(long_item(F.col("bullets")), "bullet over 200 chars"),
        rule(F.size("action_items") > 10, "action items count"),
        rule(long_item(F.col("action_items")), "action item over 200 chars"),
        rule((F.col("status") == "degraded") & (F.col("confidence") > 0.4), "degraded but confident"),
    ]
    return rows.withColumn("failures", F.array_compact(F.array(*fails))).withColumn(
        "contract_warnings", F.array_compact(F.array(*warns))
    )


def render_report(rows: DataFrame) -> DataFrame:
    """Readable report of a summary row, sections in their fixed order."""
    none = F.array().cast("array<string>")

    def listing(items: Column, mark: str) -> Column:
        return F.transform(items, lambda i: F.concat(F.lit(mark), i))

    def text(column: str, default: str = "N/A") -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(default))

    def pair(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))

    def optional(name: str, column: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.array(pair(name, F.col(column)))).otherwise(none)

    title = tx.title_case(F.replace(tx.file_stem(F.col("source_file")), F.lit("_"), F.lit(" ")))
    badge = F.when(F.col("status") == "degraded", DEGRADED_BADGE).otherwise("")
    confidence = F.concat(F.lit("**Confidence:** "), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), badge)
    bullets = F.when(
        F.size("bullets") > 0,
        F.concat(F.array(F.lit("## Bullets"), F.lit("")), listing(F.col("bullets"), "- "), F.array(F.lit(""))),
    ).otherwise(none)
    actions = F.when(F.size("action_items") > 0, listing(F.col("action_items"), "- [ ] ")).otherwise(
        F.array(F.lit(NO_ACTIONS))
    )
    meta = F.concat(
        F.array(
            F.lit("## Metadata"), F.lit(""), F.lit("| Key | Value |"), F.lit("|---|---|"),
            pair("Provider", text("provider")), pair("Model", text("model")),
            pair("Latency (ms)", text("latency_ms")), pair("Created At (UTC)", text("created_at")),
            pair("Source File", text("source_file")),
            pair("Schema / Version", F.concat(text("schema"), F.lit(" / "), text("schema_version"))),
        ),
        optional("Language", "lang"),
        optional("Run ID", "run_id"),
        F.array(F.lit("")),
    )
    warned = F.when(
        F.size("warnings") > 0,
        F.concat(F.array(F.lit("## Warnings"), F.lit("")), listing(F.col("warnings"), "- "), F.array(F.lit(""))),
    ).otherwise(none)
    lines = F.concat(
        F.array(F.concat(F.lit("# "), title), F.lit(""), confidence, F.lit(""), F.lit("## Summary"), F.lit(""),
                F.coalesce("summary", F.lit(NO_SUMMARY)), F.lit("")),
        bullets,
        F.array(F.lit("## Action Items"), F.lit("")), actions, F.array(F.lit("")),
        meta,
        warned,
    )
    return rows.withColumn("report", F.array_join(lines, "\n"))


def render_extract(extracts: DataFrame, statements: DataFrame, blocks: DataFrame) -> DataFrame:
    """Readable form of an extract: head, statements, archived blocks.

    Blocks that carry an ``archival_description`` have its brief text on a line below.
    """
    brief = F.lit(None).cast("string")
    if "archival_description" in blocks.columns:
        brief = F.col("archival_description.brief_description")
    said = statements.groupBy("extract_id").agg(
        F.array_sort(F.collect_list(F.struct("statement_index", F.concat(F.lit("**"), F.col("speaker"), F.lit(":** "), F.col("text"), F.lit("\n")).alias("_line")))).alias("_said")
    )
    listed = blocks.groupBy("extract_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "block_no",
                    F.concat(
                        F.format_string("- `%s` — %s (%d lines, %d chars, speaker=%s)", "block_id", "block_kind", "line_count", "char_count", F.coalesce("speaker", F.lit("unknown"))),
                        F.coalesce(F.concat(F.lit("\n  - "), brief), F.lit("")),
                    ).alias("_line"),
                )
            )
        ).alias("_listed")
    )
    head = F.concat(
        F.lit("# Extract — "), F.col("segment_id"), F.lit("\n\n**Status:** "), F.col("status"),
        F.lit("  \n**Attempt:** "), F.coalesce(F.col("attempt").cast("string"), F.lit("?")),
        F.lit("  \n**Model:** "), F.col("model"), F.lit("  \n**Latency:** "),
        F.coalesce(F.col("latency_ms").cast("string"), F.lit("0")), F.lit("ms\n\n## Statements\n"),
    )
    archived = F.when(
        F.size("_listed") > 0,
        F.concat(F.lit("## Archived Blocks\n\n"), F.array_join(F.transform("_listed", lambda b: b["_line"]), "\n"), F.lit("\n")),
    )
    return extracts.join(said, "extract_id", "left").join(listed, "extract_id", "left").select(
        "extract_id",
        F.concat_ws("\n", head, F.array_join(F.transform("_said", lambda s: s["_line"]), "\n"), archived).alias("report"),
    )


def render_fragment(fragments: DataFrame, statements: DataFrame) -> DataFrame:
    """Readable form of a fragment; statements carry fragment_id and their position."""
    said = statements.groupBy("fragment_id").agg(
        F.array_sort(F.collect_list(F.struct("position_in_fragment", F.concat(F.lit("**"), F.col("speaker"), F.lit(":** "), F.col("text"), F.lit("\n")).alias("_line")))).alias("_said")
    )
    head = F.concat(
        F.lit("# Fragment — "), F.col("segment_id"), F.lit(" / "), F.col("fragment_index").cast("string"),
        F.lit("\n\n**Title:** "), F.coalesce("title", F.lit("")), F.lit("  \n**Status:** "), F.col("status"),
        F.lit("  \n**Model:** "), F.col("model"), F.lit("\n\n## Statements\n"),
    )
    return fragments.join(said, "fragment_id", "left").select(
        "fragment_id",
        F.concat_ws("\n", head, F.array_join(F.transform("_said", lambda s: s["_line"]), "\n")).alias("report"),
    )
