"""Topical fragments: the units that are embedded, retrieved and cited.

Windows here run inside one extract, whose statements all come from one segment row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import ids, text as tx
from colloquy.operators.models import TextModel, run_text_model

# Batch and fragment sizes.
BATCH_STATEMENTS = 50
FRAGMENT_STATEMENTS = 10
TITLE_WORDS = 6

SAME_TOPIC = 0.05


def batch_statements(statements: DataFrame, size: int = BATCH_STATEMENTS) -> DataFrame:
    """Number batches of at most ``size`` consecutive statements of an extract."""
    return statements.withColumn("batch", F.floor(F.col("statement_index") / size))


def group_statements(statements: DataFrame, same_topic: float = SAME_TOPIC) -> DataFrame:
    """Baseline grouping: adds ``fragment_index`` and ``position_in_fragment``.

    A new fragment starts at a batch border, where neighbouring statements share too
    few words, and after ten statements. Statements keep their order.
    """
    order = Window.partitionBy("extract_id").orderBy("statement_index")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        batch_statements(statements)
        .withColumn("_words", F.array_distinct(tx.words(F.col("text"))))
        .withColumn("_shared", tx.jaccard(F.lag("_words").over(order), F.col("_words")))
        .withColumn("_batch_before", F.lag("batch").over(order))
        .withColumn(
            "_starts",
            F.when(F.col("_batch_before").isNull(), 1)
            .when(F.col("_batch_before") != F.col("batch"), 1)
            .when(F.coalesce("_shared", F.lit(0.0)) < same_topic, 1)
            .otherwise(0),
        )
        .withColumn("_run", F.sum("_starts").over(so_far))
    )
    in_run = Window.partitionBy("extract_id", "_run").orderBy("statement_index")
    sized = marked.withColumn("_in_run", F.row_number().over(in_run) - 1).withColumn(
        "position_in_fragment", (F.col("_in_run") % FRAGMENT_STATEMENTS).cast("bigint")
    )
    first = F.when(F.col("position_in_fragment") == 0, 1).otherwise(0)
    return sized.withColumn(
        "fragment_index", (F.sum(first).over(so_far) - 1).cast("bigint")
    ).select(*statements.columns, "fragment_index", "position_in_fragment")


def fragment_text(title: Column, lines: Column, notes: Column) -> Column:
    """Title, statement lines and archive notes; empty parts are left out."""

    def block(items: Column) -> Column:
        return tx.null_if_empty(F.array_join(items, "\n"))

    return F.concat_ws("\n\n", tx.null_if_empty(title), block(lines), block(notes))


def assemble_fragments(grouped: DataFrame) -> DataFrame:
    """Fragment rows from grouped statements (with ``notes`` when placeholders exist)."""
    has_notes = "notes" in grouped.columns
    entry = ["position_in_fragment", "statement_index", "speaker", "text"] + (["notes"] if has_notes else [])
    rows = F.array_sort(F.collect_list(F.struct(*entry)))
    given = F.max("title") if "title" in grouped.columns else F.lit(None).cast("string")
    built = grouped.groupBy("extract_id", "segment_id", "conv_id", "fragment_index").agg(
        rows.alias("_rows"), given.alias("_title")
    )
    first_words = F.slice(F.split(tx.squeeze(F.element_at("_rows", 1)["text"]), " "), 1, TITLE_WORDS)
    title = F.coalesce("_title", F.array_join(first_words, " "))
    lines = F.transform("_rows", lambda r: F.concat(r["speaker"], F.lit(": "), r["text"]))
    notes = (
        F.array_sort(F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["notes"]))))
        if has_notes
        else F.array().cast("array<string>")
    )
    return built.withColumn("title", title).select(
        ids.fragment_id(F.col("extract_id"), F.col("fragment_index")).alias("fragment_id"),
        "extract_id",
        "segment_id",
        "conv_id",
        "fragment_index",
        "title",
        fragment_text(F.col("title"), lines, notes).alias("retrieval_text"),
        F.lit("ok").alias("status"),
        F.size("_rows").cast("bigint").alias("statement_count"),
    )


def build_fragments(statements: DataFrame, same_topic: float = SAME_TOPIC) -> DataFrame:
    return assemble_fragments(group_statements(statements, same_topic))


def statement_span(grouped: DataFrame) -> DataFrame:
    """First and last statement index of every fragment."""
    return grouped.groupBy("extract_id", "fragment_index").agg(
        F.min("statement_index").alias("statement_start_index"),
        F.max("statement_index").alias("statement_end_index"),
    ).select(
        ids.fragment_id(F.col("extract_id"), F.col("fragment_index")).alias("fragment_id"),
        "statement_start_index",
        "statement_end_index",
    )


def link_statements(grouped: DataFrame) -> DataFrame:
    """Fragment-to-statement links with deterministic ids."""
    return grouped.select(
        ids.fragment_id(F.col("extract_id"), F.col("fragment_index")).alias("fragment_id"),
        ids.statement_id(F.col("extract_id"), F.col("statement_index")).alias("statement_id"),
        "position_in_fragment",
    )


def repair_links_by_text(
    fragments: DataFrame, members: DataFrame, statements: DataFrame, links: DataFrame
) -> DataFrame:
    """Links for fragments that have none at all.

    ``members`` lists each fragment's statements (fragment_id, position_in_fragment,
    text, statement_index or null). Index first when the fragment's first member has
    one; else equal text inside the extract, where the last statement wins.
    """
    bare = fragments.select("fragment_id", "extract_id").join(
        links.select("fragment_id").distinct(), "fragment_id", "left_anti"
    )
    todo = bare.join(members, "fragment_id")
    first = todo.groupBy("fragment_id").agg(
        F.min_by(F.col("statement_index").isNotNull(), "position_in_fragment").alias("_indexed")
    )
    todo = todo.join(first, "fragment_id")
    by_index = todo.where(F.col("_indexed") & F.col("statement_index").isNotNull()).select(
        "fragment_id",
        ids.statement_id(F.col("extract_id"), F.col("statement_index")).alias("statement_id"),
        "position_in_fragment",
    )
    last = statements.groupBy("extract_id", "text").agg(
        F.max_by("statement_id", "statement_index").alias("statement_id")
    )
    by_text = (
        todo.where(~F.col("_indexed"))
        .drop("statement_index")
        .join(last, ["extract_id", "text"])
        .select("fragment_id", "statement_id", "position_in_fragment")
    )
    found = by_index.unionByName(by_text)
    # One link per statement, as the key demands; positions close up.
    once = found.groupBy("fragment_id", "statement_id").agg(F.min("position_in_fragment").alias("_at"))
    order = Window.partitionBy("fragment_id").orderBy("_at", "statement_id")
    return once.select(
        "fragment_id",
        "statement_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("position_in_fragment"),
    )


def merge_batches(batches: DataFrame) -> DataFrame:
    """Fold batch results of an extract: latency, flags and warnings.

    Rows need extract_id, batch, latency_ms, is_degraded, is_partial, skip_reason,
    fragment_count and warning. A skipped or empty batch adds its latency only.
    """
    counted = F.col("skip_reason").isNull() & (F.col("fragment_count") > 0)
    note = F.when(
        counted & (F.coalesce("warning", F.lit("")) != ""),
        F.struct("batch", F.concat(F.lit("batch "), (F.col("batch") + 1).cast("string"), F.lit(": "), F.col("warning")).alias("_note")),
    )
    return (
        batches.groupBy("extract_id")
        .agg(
            F.sum("latency_ms").alias("latency_ms"),
            F.coalesce(F.bool_or(F.when(counted, F.col("is_degraded"))), F.lit(False)).alias("is_degraded"),
            F.coalesce(F.bool_or(F.when(counted, F.col("is_partial"))), F.lit(False)).alias("is_partial"),
            F.coalesce(F.sum(F.when(counted, F.col("fragment_count"))), F.lit(0)).alias("fragment_count"),
            F.array_sort(F.collect_list(note)).alias("_notes"),
        )
        .select(
            "extract_id",
            "latency_ms",
            "is_degraded",
            "is_partial",
            "fragment_count",
            F.array_join(F.transform("_notes", lambda n: n["_note"]), "; ").alias("warning"),
        )
    )


def fragment_prompts(statements: DataFrame, template: str) -> DataFrame:
    """One prompt per batch of statements; ``template`` holds ``{statements_text}``."""
    listed = F.array_sort(F.collect_list(F.struct("statement_index", "speaker", "text")))
    body = F.array_join(F.transform("_all", lambda s: F.concat(s["speaker"], F.lit(": "), s["text"])), "\n")
    return (
        batch_statements(statements)
        .groupBy("extract_id", "batch")
        .agg(listed.alias("_all"))
        .select(
            "extract_id",
            "batch",
            F.concat_ws("#", "extract_id", F.col("batch").cast("string")).alias("id"),
            F.replace(F.lit(template), F.lit("{statements_text}"), body).alias("prompt"),
        )
    )


def fragments_with_model(
    statements: DataFrame, factory: Callable[[], TextModel], template: str
) -> tuple[DataFrame, DataFrame]:
    """Group statements by a model, batch by batch.

    Returns (members, runs): members carry fragment_index, position_in_fragment,
    title, speaker and text per extract; runs fold the batches' outcomes. A batch
    that fails leaves the others alone. An item that is no statement is a member
    without speaker and text; a group without statements is one such member.
    """
    from colloquy.session import durable

    prompts = fragment_prompts(statements, template)
    return grouped_answers(durable(run_text_model(prompts, factory), "grouping"), prompts)


def grouped_answers(answers: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, runs) of a model's answers (id, raw, error, latency_ms) to ``fragment_prompts``."""
    from colloquy.operators.statements import read_model_output

    parsed = read_model_output(answers).join(prompts.select("id", "extract_id", "batch"), "id")
    whole = F.try_variant_get("parsed", "$", "array<variant>")
    groups = F.coalesce(whole, F.try_variant_get("parsed", "$.fragments", "array<variant>"))
    listed = parsed.withColumn("_groups", groups)
    runs = merge_batches(
        listed.select(
            "extract_id",
            "batch",
            "latency_ms",
            "is_degraded",
            (F.col("parsed").isNull() & F.col("error").isNull()).alias("is_partial"),
            F.col("error").alias("skip_reason"),
            F.coalesce(F.size("_groups"), F.lit(0)).alias("fragment_count"),
            F.col("parse_warning").alias("warning"),
        )
    )
    flat = listed.select("extract_id", "batch", F.posexplode("_groups").alias("_n", "_g"))
    order = Window.partitionBy("extract_id").orderBy("batch", "_n")
    members = (
        flat.withColumn("fragment_index", (F.row_number().over(order) - 1).cast("bigint"))
        .select(
            "extract_id",
            "fragment_index",
            F.try_variant_get("_g", "$.title", "string").alias("title"),
            F.posexplode_outer(F.try_variant_get("_g", "$.statements", "array<variant>")).alias("_at", "_s"),
        )
        .select(
            "extract_id",
            "fragment_index",
            "title",
            F.coalesce("_at", F.lit(0)).alias("position_in_fragment"),
            F.try_variant_get("_s", "$.speaker", "string").alias("speaker"),
            F.try_variant_get("_s", "$.text", "string").alias("text"),
            F.try_variant_get("_s", "$.statement_index", "bigint").alias("statement_index"),
        )
    )
    return members, runs
