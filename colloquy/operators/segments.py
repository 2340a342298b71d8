"""Cutting conversations into overlapping segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import ids, text
from colloquy.operators.ordered import with_earlier_rows

PREVIEW_CHARS = 120
PREVIEW_MARK = "…"
PAGE_ROWS = 1000


def _with_overlap(grouped: DataFrame) -> DataFrame:
    """Let a user message also close the group before it."""
    own = F.col("_own")
    closes = (F.col("speaker") == "user") & (own > 0)
    targets = F.when(closes, F.array(own, own - 1)).otherwise(F.array(own))
    return (
        grouped.withColumnRenamed("segment_index", "_own")
        .withColumn("segment_index", F.explode(targets))
        .withColumn("_overlap", F.col("segment_index") != own)
    )


def _assemble(messages: DataFrame) -> DataFrame:
    entries = F.array_sort(
        F.collect_list(
            F.struct("position", "_overlap", "speaker", "message_id", "created_at", "content")
        )
    )
    built = (
        _with_overlap(messages)
        .groupBy("conv_id", "segment_index")
        .agg(entries.alias("_all"))
        .withColumn("_led", F.element_at("_all", 1).getField("speaker") == "user")
        .withColumn("_answered", F.exists("_all", lambda m: m["speaker"] == "assistant"))
        .withColumn("_followed", F.exists("_all", lambda m: m["_overlap"]))
    )
    # Only a user-led group with a reply takes the next user message in.
    keep_overlap = F.col("_led") & F.col("_answered")
    return built.withColumn(
        "_rows", F.filter("_all", lambda m: keep_overlap | ~m["_overlap"])
    ).withColumn("_tail", F.col("_led") & ~F.col("_answered") & ~F.col("_followed"))


def segment_text(rows: Column) -> Column:
    return F.array_join(
        F.transform(rows, lambda m: F.concat(m["speaker"], F.lit(": "), text.strip(m["content"]))),
        "\n\n",
    )


def segment_conversations(messages: DataFrame) -> DataFrame:
    """One row per segment; input as from ``assign_positions``.

    A segment is a user message, the replies to it and the next user message, which
    also opens the next segment. Users in a row give one-message segments. The text
    and id list of a segment are single values of the result.
    """
    rows = F.col("_rows")
    return (
        _assemble(messages)
        .where(~F.col("_tail"))
        .select(
            ids.segment_id(F.col("conv_id"), F.col("segment_index")).alias("segment_id"),
            "conv_id",
            "segment_index",
            F.element_at(rows, 1).getField("position").alias("start_position"),
            F.element_at(rows, -1).getField("position").alias("end_position"),
            F.transform(rows, lambda m: m["message_id"]).alias("message_ids"),
            F.element_at(rows, 1).getField("created_at").alias("conversation_date"),
            segment_text(rows).alias("segment_text"),
        )
    )


def pending_tails(messages: DataFrame) -> DataFrame:
    """The last user message of a conversation, when nobody has replied to it."""
    tail = F.element_at("_rows", 1)
    return (
        _assemble(messages)
        .where("_tail")
        .select(
            "conv_id",
            tail.getField("message_id").alias("message_id"),
            tail.getField("position").alias("position"),
            tail.getField("speaker").alias("speaker"),
            tail.getField("created_at").alias("created_at"),
            tail.getField("content").alias("content"),
            text.preview(tail.getField("content"), PREVIEW_CHARS, PREVIEW_MARK).alias("preview"),
        )
    )


def segment_manifest(
    messages: DataFrame, segments: DataFrame, tails: DataFrame, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """Counts, ordered segment ids and the tail of every conversation.

    The id list comes in pages of at most ``page_rows`` ids, so that no list grows
    with a conversation; a conversation of ordinary size has one page. A
    conversation without any segment has page 0 with an empty list.
    """
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"))
    per_conversation = segments.groupBy("conv_id").agg(F.count("*").alias("segment_count"))
    pages = (
        segments.withColumn("page", F.floor(F.col("segment_index") / page_rows))
        .groupBy("conv_id", "page")
        .agg(F.array_sort(F.collect_list(F.struct("segment_index", "segment_id"))).alias("_ids"))
        .select("conv_id", "page", F.transform("_ids", lambda s: s["segment_id"]).alias("segment_ids"))
    )
    head = (
        counts.join(per_conversation, "conv_id", "left")
        .join(
            tails.select(
                "conv_id",
                F.col("message_id").alias("tail_message_id"),
                F.col("position").alias("tail_position"),
                F.col("preview").alias("tail_preview"),
            ),
            "conv_id",
            "left",
        )
        .withColumn("segment_count", F.coalesce("segment_count", F.lit(0)))
    )
    return head.join(pages, "conv_id", "left").select(
        "conv_id",
        "message_count",
        "segment_count",
        F.coalesce("page", F.lit(0)).cast("bigint").alias("page"),
        F.coalesce("segment_ids", F.array().cast("array<string>")).alias("segment_ids"),
        "tail_message_id",
        "tail_position",
        "tail_preview",
    )


def transcript(messages: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Readable transcript per conversation, in pages of ``page_rows`` messages.

    Pages joined by a blank line are the whole transcript. Needs ``position``; a
    missing speaker reads "Unknown", a missing time is left out.
    """
    stamp = F.when(
        F.coalesce(F.col("ts"), F.lit("")) != "", F.concat(F.lit(" ("), F.col("ts"), F.lit(")"))
    ).otherwise("")
    entry = F.concat(
        F.lit("["), F.coalesce("speaker", F.lit("Unknown")), F.lit("]"), stamp, F.lit(":\n"),
        F.coalesce("content", F.lit("")), F.lit("\n"),
    )
    pages = (
        messages.select("conv_id", "position", entry.alias("_entry"))
        .groupBy("conv_id", F.floor(F.col("position") / page_rows).alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("position", "_entry"))).alias("_entries"))
    )
    body = F.array_join(F.transform("_entries", lambda e: e["_entry"]), "\n")
    return pages.select("conv_id", "page", text.strip(body).alias("transcript"))


def conversations_dim(
    messages: DataFrame, segments: DataFrame, headers: DataFrame | None = None
) -> DataFrame:
    """One row per conversation: counts, and the first segment's date.

    ``headers`` may bring title, platform and provenance, keyed by conv_id.
    """
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"))
    dates = segments.where("segment_index = 0").select("conv_id", "conversation_date")
    dim = counts.join(dates, "conv_id", "left")
    return dim if headers is None else headers.join(dim, "conv_id", "left").fillna(
        0, ["message_count"]
    )


def rolling_context(
    summaries: DataFrame, size: int = 3, text_column: str = "summary"
) -> DataFrame:
    """Up to ``size`` summaries before each segment, labelled from 0.

    ``segment_index`` is gap-free, so chunks that also hold the few rows before
    them are enough, whatever the length of the conversation.
    """
    chunked = with_earlier_rows(summaries, ["conv_id"], "segment_index", size)
    prior = Window.partitionBy("conv_id", "_chunk").orderBy("segment_index").rowsBetween(-size, -1)
    labelled = F.transform(
        F.collect_list(text_column).over(prior),
        lambda s, i: F.concat(F.lit("Segment "), i.cast("string"), F.lit(": "), s),
    )
    return (
        chunked.withColumn("context", F.array_join(labelled, "\n"))
        .where(~F.col("_extra"))
        .drop("_chunk", "_extra")
    )
