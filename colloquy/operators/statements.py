"""Attributed statements: baseline extraction, reading model output, drift rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import ids, lenient_json, text as tx
from colloquy.operators import blocks as bl
from colloquy.operators import similarity
from colloquy.operators.models import TextModel, run_text_model
from colloquy.session import durable

# Limits of the statement rules.
MIN_PLAUSIBLE = 40
NON_EMPTY_CHARS = 200

# Texts of the reasons for rejecting an answer.
NOT_OBJECT = "output is not a JSON object"
NOT_LIST = "'statements' is not a list"
ZERO_STATEMENTS = "zero statements extracted from non-empty segment"
UNEXPECTED_KEYS = "unexpected keys in output: "
TOO_MANY = "statement count %d exceeds plausible max %d for %d-line input"

NOT_JSON = "output is not JSON"
BAD_SPEAKERS = "invalid speaker in %d statement(s)"
NEAR_DUPLICATES = "found %d near-duplicate statement pair(s)"
DOMINANT_GRAM = "4-gram '%s' appears in %d/%d statements"


def statement_array(text: Column) -> Column:
    """Baseline statements of a transcript: distinct sentences with their speaker."""
    per_turn = F.transform(
        bl.message_array(text),
        lambda m: F.transform(
            tx.sentences(m["body"]),
            lambda s: F.struct(m["speaker"].alias("speaker"), s.alias("text")),
        ),
    )
    return F.array_distinct(F.flatten(per_turn))


def extract_statements(segments: DataFrame, text: str = "segment_text") -> DataFrame:
    """Statements without a model. Works row by row: no shuffle."""
    extract = ids.extract_id(F.col("segment_id"))
    return segments.select(
        extract.alias("extract_id"),
        "segment_id",
        "segment_index",
        "conv_id",
        F.posexplode(statement_array(F.col(text))).alias("statement_index", "_s"),
    ).select(
        ids.statement_id(F.col("extract_id"), F.col("statement_index")).alias("statement_id"),
        "extract_id",
        "segment_id",
        "segment_index",
        "conv_id",
        F.col("statement_index").cast("bigint").alias("statement_index"),
        F.col("_s.speaker").alias("speaker"),
        F.col("_s.text").alias("text"),
    )


def safe_segments(segments: DataFrame, mode: str = "inventory") -> DataFrame:
    """Drop repeated turns, archive blocks, and add the safe ``working_view``."""
    return archived_segments(without_repeats(segments), mode)


def without_repeats(segments: DataFrame) -> DataFrame:
    keyed = segments.withColumn("id", F.col("segment_id"))
    return similarity.dedup_assistant_turns(keyed, "id", "segment_text").drop("id")


def archived_segments(segments: DataFrame, mode: str = "inventory") -> DataFrame:
    """Archive blocks and add the safe ``working_view``; turns stay as they are."""
    deduped = segments.withColumn("id", F.col("segment_id"))
    found = bl.archive_blocks(deduped, "id", "segment_text")
    if mode == "archival":
        found = bl.describe_blocks(found)
    return bl.working_view(deduped, found, "id", "segment_text", mode).drop("id")


def read_model_output(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse model text strictly, then without its code fences.

    Adds VARIANT ``parsed`` (null = unreadable), ``is_degraded``, ``parse_warning``.
    """
    strict = lenient_json.parse_strict(F.col(raw))
    cleaned = lenient_json.parse_strict(lenient_json.strip_fences(F.col(raw)))
    return (
        answers.withColumn("_strict", strict)
        .withColumn("_cleaned", F.when(F.col("_strict").isNull(), cleaned))
        .withColumn("parsed", F.coalesce("_strict", "_cleaned"))
        .withColumn("is_degraded", F.col("_cleaned").isNotNull())
        .withColumn("parse_warning", F.when(F.col("is_degraded"), lenient_json.CLEANUP_WARNING))
        .drop("_strict", "_cleaned")
    )


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return (
        F.when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", "string")
        .otherwise("other")
    )


def _items(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$.statements", "array<variant>")


def model_statements(answers: DataFrame, key: list[str]) -> DataFrame:
    """One row per list item of ``parsed.statements``: kind, speaker, text."""
    return (
        answers.select(*key, F.posexplode(_items(F.col("parsed"))).alias("item_index", "_item"))
        .withColumn("_object", _kind(F.col("_item")) == "object")
        .select(
            *key,
            "item_index",
            F.col("_object").alias("is_object"),
            F.when(F.col("_object"), F.try_variant_get("_item", "$.speaker", "string")).alias("speaker"),
            F.when(
                F.col("_object") & (_kind(F.try_variant_get("_item", "$.text", "variant")) == "string"),
                F.try_variant_get("_item", "$.text", "string"),
            ).alias("text"),
        )
    )


def validate_statements(answers: DataFrame, key: list[str], view: str = "working_view") -> DataFrame:
    """Apply the drift rules to parsed model output.

    Adds ``reasons`` (empty = accepted), ``is_valid`` and ``statement_count``.
    """
    columns, parsed = answers.columns, F.col("parsed")
    keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
    listed = _items(parsed).isNotNull()
    # What the rules ask of an answer itself is settled here: the joins move no texts.
    answers = durable(
        answers.withColumns(
            {
                "_id": F.col(key[0]) if len(key) == 1 else F.concat(*[c for k in key for c in (F.col(k).cast("string"), F.lit("\u0001"))]),
                "_n": F.coalesce(F.size(_items(parsed)), F.lit(0)),
                "_unread": parsed.isNull(),
                "_unexpected": F.array_sort(F.array_except(keys, F.array(F.lit("statements")))),
                "_listed": listed,
                "_lines": bl.line_count(F.col(view)),
                "_filled": F.when(listed & (F.size(_items(parsed)) == 0), F.length(tx.strip(F.col(view))) > NON_EMPTY_CHARS),
            }
        ),
        "answers",
    )
    items = durable(model_statements(answers, [*key, "_id", "_n"]), "items")

    speakers = items.groupBy(*key).agg(
        F.count_if(F.col("is_object") & ~F.coalesce(F.col("speaker").isin("user", "assistant"), F.lit(False))).alias("_bad")
    )
    # Answers of too few statements for a rule do not enter its joins: n texts have at most
    # n (n - 1) / 2 pairs.
    least = next(n for n in range(2, 100) if n * (n - 1) // 2 >= similarity.MAX_NEAR_DUPLICATE_PAIRS)
    texts = items.where(F.col("text").isNotNull())
    pairs = (
        similarity.near_dup_pairs(texts.where(F.col("_n") >= least), "_id", "item_index", "text")
        .groupBy("_id")
        .agg(F.sum("pairs").alias("_pairs"))
    )
    many = texts.where(F.col("_n") >= similarity.MIN_STATEMENTS_FOR_GRAM)
    grams = similarity.dominant_ngram(many, "_id", "text").select(
        "_id", "gram", "statements_with", F.col("statement_count").alias("_texts")
    )

    rows = (
        answers.join(speakers, key, "left")
        .join(pairs, "_id", "left")
        .join(grams, "_id", "left")
        .withColumn("statement_count", F.col("_n").cast("bigint"))
    )
    count, unexpected, listed = F.col("statement_count"), F.col("_unexpected"), F.col("_listed")
    ceiling = F.greatest(F.lit(MIN_PLAUSIBLE), F.floor(F.col("_lines") / 2))
    gram_limit = F.greatest(
        F.lit(similarity.MIN_GRAM_STATEMENTS), F.floor(F.col("_texts") / 2)
    )

    def rule(broken: Column, words: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), words)

    in_list = [
        rule(F.size(unexpected) > 0, F.concat(F.lit(UNEXPECTED_KEYS), F.array_join(unexpected, ", "))),
        rule(~listed, F.lit(NOT_LIST)),
        rule(listed & (F.col("_bad") > 0), F.format_string(BAD_SPEAKERS, "_bad")),
        rule(
            listed & (count > ceiling),
            F.format_string(TOO_MANY, count, ceiling, "_lines"),
        ),
        rule(
            listed & (count == 0) & F.col("_filled"),
            F.lit(ZERO_STATEMENTS),
        ),
        rule(
            listed & (F.col("_pairs") >= similarity.MAX_NEAR_DUPLICATE_PAIRS),
            F.format_string(NEAR_DUPLICATES, "_pairs"),
        ),
        rule(
            listed & (count >= similarity.MIN_STATEMENTS_FOR_GRAM) & (F.col("statements_with") >= gram_limit),
            F.format_string(DOMINANT_GRAM, "gram", "statements_with", "_texts"),
        ),
    ]
    reasons = (
        F.when(F.col("_unread"), F.array(F.lit(NOT_JSON)))
        .when(unexpected.isNull(), F.array(F.lit(NOT_OBJECT)))
        .otherwise(F.array_compact(F.array(*in_list)))
    )
    return (
        rows.withColumn("reasons", reasons)
        .withColumn("is_valid", F.size("reasons") == 0)
        .select(*columns, "statement_count", "reasons", "is_valid")
    )


def pick_attempt(validated: DataFrame) -> DataFrame:
    """First valid, non-empty attempt of each segment, else a partial result.

    Rows need segment_id, attempt, raw, error, reasons, is_valid, is_degraded,
    parse_warning and statement_count. Attempts after the chosen one do not count.
    """
    usable = F.col("is_valid") & (F.col("statement_count") > 0)
    chosen = F.min(F.when(usable, F.col("attempt")))
    note = F.concat(F.lit("attempt "), F.col("attempt").cast("string"), F.lit(": "))
    notes = F.concat(
        F.when(F.col("error").isNotNull(), F.array(F.concat(note, F.col("error")))).otherwise(
            F.transform("reasons", lambda r: F.concat(note, r))
        ),
        F.when(F.col("parse_warning").isNotNull(), F.array(F.concat(note, F.col("parse_warning")))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    per_segment = validated.withColumn("_notes", notes).groupBy("segment_id").agg(
        chosen.alias("chosen_attempt"),
        F.max("attempt").alias("_last_attempt"),
        F.min_by("raw", F.when(usable, F.col("attempt"))).alias("raw"),
        F.array_sort(F.collect_list(F.struct("attempt", "_notes", "is_degraded"))).alias("_all"),
    )
    counted = F.filter(
        "_all", lambda a: F.col("chosen_attempt").isNull() | (a["attempt"] <= F.col("chosen_attempt"))
    )
    degraded = F.exists(counted, lambda a: a["is_degraded"])
    return per_segment.select(
        "segment_id",
        F.coalesce("chosen_attempt", "_last_attempt").alias("attempt"),
        F.when(F.col("chosen_attempt").isNotNull(), F.col("raw")).alias("raw"),
        resolve_status(
            F.lit(False), F.col("chosen_attempt").isNull(), degraded
        ).alias("status"),
        F.flatten(F.transform(counted, lambda a: a["_notes"])).alias("warnings"),
    )


def merge_message_answers(answers: DataFrame) -> DataFrame:
    """Put per-message answers of a segment together in message order (attempt 3).

    Rows need segment_id, turn_index, speaker, parsed and error. A speaker the model
    made up becomes the message's own. One unreadable answer fails the attempt.
    """
    items = answers.select(
        "segment_id",
        "turn_index",
        F.col("speaker").alias("_own"),
        F.posexplode(_items(F.col("parsed"))).alias("item_index", "_item"),
    ).select(
        "segment_id",
        "turn_index",
        "item_index",
        F.struct(
            F.when(
                F.try_variant_get("_item", "$.speaker", "string").isin("user", "assistant"),
                F.try_variant_get("_item", "$.speaker", "string"),
            ).otherwise(F.col("_own")).alias("speaker"),
            F.try_variant_get("_item", "$.text", "string").alias("text"),
        ).alias("_s"),
    )
    merged = items.groupBy("segment_id").agg(
        F.array_sort(F.collect_list(F.struct("turn_index", "item_index", "_s"))).alias("_all")
    )
    failed = answers.groupBy("segment_id").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("turn_index"))).alias("error"),
        F.bool_or(F.col("parsed").isNull()).alias("_failed"),
    )
    found = F.coalesce(F.transform("_all", lambda a: a["_s"]), F.array().cast("array<struct<speaker:string,text:string>>"))
    return failed.join(merged, "segment_id", "left").select(
        "segment_id",
        F.lit(3).alias("attempt"),
        F.when(~F.col("_failed"), F.to_json(F.struct(found.alias("statements")))).alias("raw"),
        F.when(F.col("_failed"), F.coalesce("error", F.lit("unreadable message answer"))).alias("error"),
    )


def clean_model_statements(picked: DataFrame) -> DataFrame:
    """Statements of the picked answers, malformed ones dropped, numbered from 0."""
    parsed = read_model_output(picked)
    kept = model_statements(parsed, ["segment_id"]).where(
        F.col("speaker").isin("user", "assistant") & F.col("text").isNotNull()
    )
    order = Window.partitionBy("segment_id").orderBy("item_index")
    indexed = kept.withColumn("statement_index", (F.row_number().over(order) - 1).cast("bigint"))
    return indexed.withColumn("extract_id", ids.extract_id(F.col("segment_id"))).select(
        ids.statement_id(F.col("extract_id"), F.col("statement_index")).alias("statement_id"),
        "extract_id",
        "segment_id",
        "statement_index",
        "speaker",
        "text",
    )


def extract_prompts(
    views: DataFrame, template: str, text: str = "working_view", key: str = "segment_id"
) -> DataFrame:
    """(id, user) per row; ``template`` holds ``{segment_text}``."""
    filled = F.replace(F.lit(template), F.lit("{segment_text}"), F.col(text))
    return views.select(F.col(key).alias("id"), filled.alias("user"))


def extract_with_model(
    segments: DataFrame, factory: Callable[[], TextModel], template: str
) -> tuple[DataFrame, DataFrame]:
    """(extracts, statements) of the three-step ladder; see ``ladder``."""
    found = ladder(segments, factory, template)
    return found["picked"], found["statements"]


def ladder(
    segments: DataFrame,
    factory: Callable[[], TextModel],
    template: str,
    describe: Callable[[DataFrame], DataFrame] = bl.describe_blocks,
) -> dict[str, DataFrame]:
    """The three-step ladder: inventory view, archival view, message by message.

    Each step runs over all segments that the step before left without a usable answer.
    ``template`` holds ``{segment_text}``; ``describe`` adds the descriptions of blocks
    that the second step shows. Returns ``picked``, ``statements``, ``latency``
    (latency_ms of all attempts by segment) and ``blocks``, described where the second
    step was reached.
    """
    def attempt(todo: DataFrame, number: int, mode: str, found: DataFrame) -> DataFrame:
        named = todo.withColumn("id", F.col("segment_id"))
        viewed = bl.working_view(named, found, "id", "segment_text", mode).drop("id")
        asked = extract_prompts(viewed, template).withColumnRenamed("user", "prompt")
        answers = durable(run_text_model(asked, factory), "answers").withColumnRenamed("id", "segment_id")
        joined = answers.join(viewed.select("segment_id", "working_view"), "segment_id")
        checked = validate_statements(read_model_output(joined), ["segment_id"])
        return durable(checked.withColumn("attempt", F.lit(number)).drop("parsed", "working_view"), "attempt")

    def unanswered(todo: DataFrame, done: DataFrame) -> DataFrame:
        usable = done.where(F.col("is_valid") & (F.col("statement_count") > 0))
        return todo.join(usable.select("segment_id"), "segment_id", "left_anti")

    # Repeated turns go once, before the ladder: no attempt sees them again.
    segments = durable(without_repeats(segments), "deduped")
    blocks = durable(bl.archive_blocks(segments.withColumn("id", F.col("segment_id")), "id", "segment_text"), "blocks")
    first = attempt(segments, 1, "inventory", blocks)
    again = durable(unanswered(segments, first), "again")
    described = durable(describe(blocks.join(again.select(F.col("segment_id").alias("id")), "id", "left_semi")), "described")
    second = attempt(again, 2, "archival", described)
    left = unanswered(again, second)
    turns = bl.split_by_message(left, "segment_id", "segment_text").withColumn(
        "id", F.concat_ws("#", "segment_id", F.col("turn_index").cast("string"))
    )
    whole = left.where(F.size(bl.message_array(F.col("segment_text"))) == 0).select(
        "segment_id", F.lit(0).alias("turn_index"), F.lit("user").alias("speaker"),
        F.col("segment_text").alias("body"), F.concat(F.col("segment_id"), F.lit("#0")).alias("id"),
    )
    turns = turns.unionByName(whole)
    views = bl.working_view(turns, bl.archive_blocks(turns, "id", "body"), "id", "body")
    answers = durable(run_text_model(extract_prompts(views, template, key="id").withColumnRenamed("user", "prompt"), factory), "answers")
    per_turn = read_model_output(answers).join(turns.select("id", "segment_id", "turn_index", "speaker"), "id")
    merged = merge_message_answers(per_turn).join(
        left.select("segment_id", F.col("segment_text").alias("working_view")), "segment_id"
    )
    third = validate_statements(read_model_output(merged), ["segment_id"]).drop("parsed", "working_view")
    picked = durable(
        pick_attempt(first.unionByName(second, allowMissingColumns=True).unionByName(third, allowMissingColumns=True)), "picked"
    )
    taken = first.select("segment_id", "latency_ms").unionByName(second.select("segment_id", "latency_ms")).unionByName(
        per_turn.select("segment_id", "latency_ms")
    )
    kind = described.schema["archival_description"].dataType
    plain = blocks.join(again.select(F.col("segment_id").alias("id")), "id", "left_anti")
    return {
        "picked": picked,
        "statements": clean_model_statements(picked),
        "latency": taken.groupBy("segment_id").agg(F.sum("latency_ms").alias("latency_ms")),
        "blocks": described.unionByName(plain.withColumn("archival_description", F.lit(None).cast(kind))),
    }


def resolve_status(skipped: Column, partial: Column, degraded: Column) -> Column:
    """skipped > partial > degraded > ok."""
    return (
        F.when(skipped, "skipped").when(partial, "partial").when(degraded, "degraded").otherwise("ok")
    )


def clean_warnings(warnings: Column) -> Column:
    return F.filter(warnings, lambda w: w.isNotNull() & (w != ""))


def build_extracts(segments: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """Extract rows of baseline runs: one per segment."""
    return segments.select(
        ids.extract_id(F.col("segment_id")).alias("extract_id"),
        "segment_id",
        "segment_index",
        "conv_id",
        F.lit("local").alias("provider"),
        F.lit("baseline").alias("model"),
        F.lit("ok").alias("status"),
        F.col("conversation_date").alias("created_at"),
    )
