"""Message-level operators: visibility, text, keys, retries, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import ids, text
from colloquy.operators.ordered import ordered_scan
from colloquy.session import durable

# Who is shown, and which recipient marks a hidden memory note.
SPEAKERS = ("user", "assistant")
HIDDEN_RECIPIENT = "bio"
TEXT_CONTENT = "text"

NEW_SIDE = 1 << 40


def message_text(parts: Column) -> Column:
    """Join the string parts of an ARRAY<VARIANT> by newline, then strip."""
    strings = F.filter(parts, lambda p: F.schema_of_variant(p) == "STRING")
    joined = F.array_join(
        F.transform(strings, lambda p: F.try_variant_get(p, "$", "string")), "\n"
    )
    return text.strip(F.coalesce(joined, F.lit("")))


def visible_messages(messages: DataFrame) -> DataFrame:
    """Keep shown messages: role, recipient, content type, hidden flag, text.

    Expects ``role``, ``recipient``, ``content_type``, ``hidden`` and ``content``.
    A missing recipient or flag passes, a missing content type does not.
    """
    return messages.where(
        F.col("role").isin(*SPEAKERS)
        & ~F.col("recipient").eqNullSafe(HIDDEN_RECIPIENT)
        & F.col("content_type").eqNullSafe(TEXT_CONTENT)
        & ~F.coalesce(F.col("hidden"), F.lit(False))
        & F.coalesce(text.strip(F.col("content")) != "", F.lit(False))
    )


def with_message_key(messages: DataFrame, hashed_id: str = "conv_id") -> DataFrame:
    """Fill ``message_id`` from ``raw_id`` or, failing that, from a content hash.

    ``hashed_id`` names the conversation id that goes into the hash.
    """
    return messages.withColumn(
        "message_id",
        ids.message_key(
            F.col("raw_id"),
            F.col(hashed_id),
            F.col("role"),
            F.col("content"),
            F.when(F.col("create_time") != 0, text.float_text(F.col("create_time"))),
        ),
    )


RETRY_MARKS = ["_user", "_high", "_low"]


def _with_retry_marks(messages: DataFrame) -> DataFrame:
    """Add what decides a retry: a user flag and 120 bits of the words' SHA-256.

    Two integers stand for a text, so no scan moves a neighbour's text.
    """
    user = F.col("speaker") == "user"
    digest = F.when(user, F.sha2(text.squeeze(F.col("content")), 256))

    def bits(first: int) -> Column:
        return F.conv(F.substring(F.col("_digest"), first, 15), 16, 10).cast("bigint")

    return messages.withColumn("_digest", digest).select(
        *messages.columns,
        user.cast("bigint").alias("_user"),
        bits(1).alias("_high"),
        bits(16).alias("_low"),
    )


def _without_retries(marked: DataFrame, kept: bool = True) -> DataFrame:
    """The marks of what stays, or of what goes."""
    following = {f"_next{m}": F.col(m) for m in RETRY_MARKS}
    seen = ordered_scan(marked, ["conv_id"], "ordinal", following=following)
    retried = F.col("_user") == 1
    for mark in RETRY_MARKS:
        retried = retried & F.col(f"_next{mark}").eqNullSafe(F.col(mark))
    return seen.where(~retried if kept else retried).select(*marked.columns)


def collapse_retries(messages: DataFrame) -> DataFrame:
    """Drop a user message followed by a user message with the same words.

    Chains collapse to the last one. The order is settled on narrow marks, written once;
    the few that go are written too, so that as a rule the messages need no shuffle.
    """
    key = ["conv_id", "ordinal"]
    marks = durable(_with_retry_marks(messages).select(*key, *RETRY_MARKS), "marks")
    gone = durable(_without_retries(marks, kept=False).select(*key), "retries")
    return messages.join(gone, key, "left_anti").select(*messages.columns)


def linear_messages(messages: DataFrame) -> DataFrame:
    """Visible messages without retries, with ``position`` and ``segment_index``.

    Order is settled on a narrow table of ordinals and marks, written once; texts
    are read for the marks and meet their numbers in one even join.
    """
    key = ["conv_id", "ordinal"]
    marks = durable(_with_retry_marks(messages).select(*key, "speaker", *RETRY_MARKS), "marks")
    numbers = assign_positions(_without_retries(marks)).select(*key, "position", "segment_index")
    return messages.join(numbers, key).select(*messages.columns, "position", "segment_index")


def assign_positions(messages: DataFrame) -> DataFrame:
    """Number the messages of each conversation, in one scan.

    Adds the 0-based ``position`` and ``segment_index``, the group a message belongs
    to: a user message with the replies after it. Assistant messages before the
    first user message form a group of their own. Groups are gap-free from 0.
    """
    user = (F.col("speaker") == "user").cast("bigint")
    numbered = ordered_scan(
        messages,
        ["conv_id"],
        "ordinal",
        sums={"_rank": F.lit(1), "_users": user},
        firsts={"_first_user": user},
    )
    return numbered.select(
        *messages.columns,
        (F.col("_rank") - 1).cast("bigint").alias("position"),
        (F.col("_users") - F.col("_first_user")).cast("bigint").alias("segment_index"),
    )


def merge_messages(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing messages in their order, then unknown incoming ones, renumbered.

    Both need conv_id, message_id and position. The first of several incoming
    copies wins; copies among the existing ones are kept.
    """
    columns = [c for c in existing.columns if c != "position"]
    key = ["conv_id", "message_id"]
    row = F.struct("position", *[c for c in columns if c not in key])
    first = incoming.groupBy(*key).agg(F.min_by(row, "position").alias("_row")).select(*key, "_row.*")
    unknown = first.join(existing.select(*key).distinct(), key, "left_anti")
    # Incoming ordinals start far beyond every existing one: one scan numbers both.
    both = existing.select("*", F.col("position").alias("_order")).unionByName(
        unknown.select(*existing.columns, (F.col("position") + NEW_SIDE).alias("_order"))
    )
    return ordered_scan(both, ["conv_id"], "_order", sums={"_rank": F.lit(1)}).select(
        *columns, (F.col("_rank") - 1).cast("bigint").alias("position")
    )
