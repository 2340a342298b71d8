"""Extractive summaries: the baseline where no text model is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import lenient_json, text as tx
from colloquy.operators.models import TextModel, run_text_model
from colloquy.session import durable

SUMMARY_SENTENCES = 3
#: A word is common that is one of so many words of all documents: there are no more of them.
COMMON_WORDS = 100_000

# List limits and confidence bands of a summary.
MAX_BULLETS = 10
MIN_BULLETS = 3
MAX_ACTION_ITEMS = 10
STRONG_CONFIDENCE = 0.8
WEAK_CONFIDENCE = 0.4

ACTION = r"(?i)^(todo|action|please|remember to|make sure|do|add|fix|check|send|write|update|create|review)(?:[^\p{L}\p{N}_]|$)"


def sentence_scores(
    sentences: DataFrame, group: list[str], order: str, text: str = "text", documents: DataFrame | None = None
) -> DataFrame:
    """Mean inverse document frequency of each sentence's words.

    A document is one group. ``documents`` may bring its distinct words (``words``, one
    row per document); else they are brought together. Counting is partial before every shuffle. Common words
    make up most of the terms: their weights go to every task, so these terms and
    skewed words stay where they are. Only terms of the other words are shuffled.
    """
    terms = sentences.select(
        *group, order, F.explode(F.array_distinct(tx.words(F.col(text)))).alias("_word")
    )
    if documents is None:
        held = terms.select(*group, "_word").distinct()
    else:
        # Without "outer" a filter would compute the words once more.
        held = documents.select(F.explode_outer("words").alias("_word")).where("_word is not null")
    frequency = durable(held.groupBy("_word").agg(F.count("*").alias("_df")), "frequency")
    total = sentences.select(*group).distinct().agg(F.count("*")).scalar()
    words, uses = frequency.agg(F.count("*"), F.sum("_df")).first()
    weights = frequency.select("_word", "_df", F.log(1 + total / F.col("_df")).alias("_weight"))
    is_common = F.lit(words <= COMMON_WORDS) | (F.col("_df") * COMMON_WORDS >= F.lit(uses))
    common = F.broadcast(weights.where(is_common).drop("_df"))
    weighted = terms.join(common, "_word")
    if words > COMMON_WORDS:
        rare = weights.where(~is_common).drop("_df")
        weighted = weighted.unionByName(terms.join(common, "_word", "left_anti").join(rare, "_word"))
    return weighted.groupBy(*group, order).agg(F.round(F.avg("_weight"), 6).alias("score"))


def summarize(
    sentences: DataFrame, group: list[str], order: str, text: str = "text", documents: DataFrame | None = None
) -> DataFrame:
    """Summary, bullets, action items and confidence per group.

    The best ten sentences by score are the bullets and the best three the summary,
    both in text order. ``row_number() <= n`` keeps n rows per group in every map
    task before the shuffle, so a large group is not brought together.
    """
    scored = sentences.select(*group, order, F.col(text).alias("_text")).join(
        sentence_scores(sentences, group, order, text, documents), [*group, order], "left"
    )
    best = Window.partitionBy(*group).orderBy(F.col("score").desc_nulls_last(), order)
    top = scored.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= MAX_BULLETS)
    lists = top.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(order, "_rank", "_text"))).alias("_top")
    )
    early = Window.partitionBy(*group).orderBy(order)
    actions = (
        sentences.where(F.col(text).rlike(ACTION))
        .select(*group, order, F.col(text).alias("_text"))
        .withColumn("_rank", F.row_number().over(early))
        .where(F.col("_rank") <= MAX_ACTION_ITEMS)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct(order, "_text"))).alias("_actions"))
    )
    enough = F.size("_top") >= MIN_BULLETS
    texts = lambda rows: F.transform(rows, lambda r: r["_text"])
    return lists.join(actions, group, "left").select(
        *group,
        F.array_join(texts(F.filter("_top", lambda r: r["_rank"] <= SUMMARY_SENTENCES)), " ").alias("summary"),
        texts(F.col("_top")).alias("bullets"),
        F.coalesce(texts(F.col("_actions")), F.array().cast("array<string>")).alias("action_items"),
        F.when(enough, STRONG_CONFIDENCE).otherwise(WEAK_CONFIDENCE).alias("confidence"),
        F.when(enough, "ok").otherwise("degraded").alias("status"),
    )


def segment_sentences(segments: DataFrame, key: str = "segment_id", text: str = "segment_text") -> DataFrame:
    from colloquy.operators.statements import statement_array

    return segments.select(
        key, F.posexplode(statement_array(F.col(text))).alias("sentence_index", "_s")
    ).select(key, "sentence_index", F.col("_s.text").alias("text"))


def summarize_segments(segments: DataFrame) -> DataFrame:
    """Sentences are cut out of a segment's text once; its row also gives its words."""
    from colloquy.operators.statements import statement_array

    cut = F.transform(statement_array(F.col("segment_text")), lambda s: s["text"])
    cut = durable(segments.select("segment_id", cut.alias("_sentences")), "sentences")
    sentences = cut.select("segment_id", F.posexplode("_sentences").alias("sentence_index", "text"))
    # Where ids repeat, a document is several rows.
    rows, ids = cut.agg(F.count("*"), F.count_distinct("segment_id")).first()
    words = F.array_distinct(F.flatten(F.transform("_sentences", tx.words)))
    documents = cut.select(words.alias("words")) if rows == ids else None
    return summarize(sentences, ["segment_id"], "sentence_index", documents=documents)


def summarize_topics(members: DataFrame) -> DataFrame:
    """One summary per (conv_id, topic_index) from the summaries of its segments."""
    sentences = members.select(
        "conv_id",
        "topic_index",
        "segment_index",
        F.posexplode(tx.sentences(F.col("summary"))).alias("_n", "text"),
    ).select(
        "conv_id", "topic_index", F.struct("segment_index", "_n").alias("sentence_index"), "text"
    )
    return summarize(sentences, ["conv_id", "topic_index"], "sentence_index")


def summarize_files(messages: DataFrame) -> DataFrame:
    """One summary per chat list; rows need conv_id, position and content."""
    sentences = messages.select(
        "conv_id", "position", F.posexplode(tx.sentences(F.col("content"))).alias("_n", "text")
    ).select("conv_id", F.struct("position", "_n").alias("sentence_index"), "text")
    return summarize(sentences, ["conv_id"], "sentence_index")


SEQUENTIAL_SCHEMA = (
    "segment_id string, conv_id string, segment_index bigint, summary string, raw string, error string"
)


def summarize_with_model(
    segments: DataFrame, factory: Callable[[], TextModel], size: int = 3, window_rows: int = 256
) -> DataFrame:
    """Model summaries whose prompt holds the ``size`` summaries before it.

    A prompt needs earlier outputs, so a conversation is worked through in order.
    Round n takes window n of every conversation, side by side, with the last
    summaries of round n-1; a task reads its rows in order and holds the last summaries
    only. The model is built once per task; fenced answers are read too.
    """
    last = segments.agg(F.max("segment_index")).first()[0]
    rounds = 0 if last is None else last // window_rows + 1
    windows = segments.withColumn("_window", F.floor(F.col("segment_index") / window_rows))

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted; a conversation may go on in the next batch.
        model, conversation = factory(), None
        prior: list[str] = []
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                if row["conv_id"] != conversation:
                    conversation, prior = row["conv_id"], []
                if row["prior_summary"] is not None:
                    prior.append(row["prior_summary"])
                    continue
                context = "\n".join(f"Segment {i}: {s}" for i, s in enumerate(prior[-size:]))
                parts = [(SEGMENT_PART, row["segment_text"])]
                if context:
                    parts.insert(0, (CONTEXT_PART, context))
                prompt = "\n\n".join(f"---BEGIN {n}---\n{body}\n---END {n}---" for n, body in parts)
                raw, summary, error = None, None, None
                try:
                    raw = model(prompt)
                    summary = str(lenient_json.loads(raw).get("summary", ""))
                    prior = [*prior, summary][-size:]
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                rows.append((row["segment_id"], row["conv_id"], row["segment_index"], summary, raw, error))
            yield pd.DataFrame(rows, columns=["segment_id", "conv_id", "segment_index", "summary", "raw", "error"])

    known = ["segment_id", "conv_id", "segment_index", "segment_text", "prior_summary"]
    latest = Window.partitionBy("conv_id").orderBy(F.col("segment_index").desc())
    done: list[DataFrame] = []
    prior: DataFrame | None = None
    for number in range(rounds):
        todo = windows.where(F.col("_window") == number).withColumn(
            "prior_summary", F.lit(None).cast("string")
        )
        batch = todo.select(*known)
        if prior is not None:
            batch = batch.unionByName(prior.join(todo.select("conv_id").distinct(), "conv_id", "left_semi"))
        sorted_rows = batch.repartition("conv_id").sortWithinPartitions("conv_id", "segment_index")
        made = durable(sorted_rows.mapInPandas(in_order, SEQUENTIAL_SCHEMA), "summaries")
        done.append(made)
        # What the next round needs: the last few summaries of each conversation.
        fresh = made.where("summary is not null").select(
            "segment_id", "conv_id", "segment_index", F.lit("").alias("segment_text"), F.col("summary").alias("prior_summary")
        )
        recent = fresh if prior is None else prior.unionByName(fresh)
        prior = durable(
            recent.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= size).select(*known),
            "context",
        )
    if not done:
        return segments.sparkSession.createDataFrame([], SEQUENTIAL_SCHEMA)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def embedding_text(kind: Column, text: Column, bullets: Column, actions: Column, summary: Column) -> Column:
    """Text to embed: a fragment's own, else key points, action items and summary."""

    def listing(title: str, items: Column) -> Column:
        lines = F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")
        return F.when(F.size(items) > 0, F.concat(F.lit(title + ":\n"), lines))

    return F.when(kind == "ai_chat_fragment", tx.strip(F.coalesce(text, F.lit("")))).otherwise(
        F.concat_ws(
            "\n\n",
            listing("Key points", bullets),
            listing("Action items", actions),
            tx.null_if_empty(tx.strip(F.coalesce(summary, F.lit("")))),
        )
    )


# Names of the fenced parts of a prompt.
CONTEXT_PART = "PREVIOUS CONTEXT"
SEGMENT_PART = "SEGMENT TRANSCRIPT"
TOPIC_PART = "TOPIC SEGMENTS"
TRANSCRIPT_PART = "TRANSCRIPT"
PAGES_PART = "PARTIAL SUMMARIES"


def _fenced_part(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"---BEGIN {name}---\n"), body, F.lit(f"\n---END {name}---"))


def segment_prompts(segments: DataFrame, system: str) -> DataFrame:
    """(id, system, user) per segment: earlier summaries, then the transcript.

    Rows need segment_id, segment_text and context (empty when there is none).
    """
    context = F.when(F.col("context") != "", _fenced_part(CONTEXT_PART, F.col("context")))
    return segments.select(
        F.col("segment_id").alias("id"),
        F.lit(system).alias("system"),
        F.concat_ws("\n\n", context, _fenced_part(SEGMENT_PART, F.col("segment_text"))).alias("user"),
    )


def topic_prompts(member_lines: DataFrame, system: str) -> DataFrame:
    """(id, system, user) per topic page, from ``topic_member_lines``."""
    return member_lines.select(
        F.format_string("%s_t%03d#%d", "conv_id", "topic_index", "page").alias("id"),
        F.lit(system).alias("system"),
        _fenced_part(TOPIC_PART, F.col("member_lines")).alias("user"),
    )


def transcript_prompts(transcripts: DataFrame, system: str) -> DataFrame:
    """(id, system, user) per transcript page."""
    return transcripts.select(
        F.concat_ws("#", "conv_id", F.col("page").cast("string")).alias("id"),
        F.lit(system).alias("system"),
        _fenced_part(TRANSCRIPT_PART, F.col("transcript")).alias("user"),
    )


def summary_rows(answers: DataFrame) -> DataFrame:
    """Summary fields of model answers (id, raw, error), read leniently.

    An unreadable answer gives status "partial", a repaired one "degraded".
    """
    from colloquy.operators.statements import clean_warnings, read_model_output, resolve_status

    parsed = read_model_output(answers)

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("parsed", f"$.{name}", kind)

    none = F.array().cast("array<string>")
    return parsed.select(
        "id",
        F.coalesce(field("summary", "string"), F.lit("")).alias("summary"),
        F.coalesce(field("bullets", "array<string>"), none).alias("bullets"),
        F.coalesce(field("action_items", "array<string>"), none).alias("action_items"),
        F.coalesce(field("confidence", "double"), F.lit(0.0)).alias("confidence"),
        field("lang", "string").alias("lang"),
        resolve_status(F.col("error").isNotNull(), F.col("parsed").isNull(), F.col("is_degraded")).alias("status"),
        clean_warnings(F.array("error", "parse_warning")).alias("warnings"),
    )


def summarize_prompts(prompts: DataFrame, factory: Callable[[], TextModel]) -> DataFrame:
    """Model summaries of topics or files from their (id, system, user) prompts."""
    asked = prompts.select("id", F.concat_ws("\n\n", "system", "user").alias("prompt"))
    return summary_rows(durable(run_text_model(asked, factory), "answers"))


def summarize_pages(
    prompts: DataFrame, factory: Callable[[], TextModel], system: str, page_rows: int = 1000
) -> DataFrame:
    """One model summary per unit whose prompt came in pages, ids ``unit#page``.

    Pages are summarised, then the summaries of a unit's pages in their order, until
    each unit has one; a unit of one page keeps that page's summary. Each round has
    ``page_rows`` times fewer rows.
    """
    made = durable(summarize_prompts(prompts, factory), "summaries")
    done: DataFrame | None = None
    while True:
        named = made.withColumn("_unit", F.regexp_replace("id", "#[0-9]+$", "")).withColumn(
            "_page", F.regexp_extract("id", "#([0-9]+)$", 1).cast("bigint")
        )
        pages = named.groupBy("_unit").agg(F.count("*").alias("_pages"))
        counted = durable(named.join(pages, "_unit"), "pages")
        single = counted.where("_pages = 1").select(F.col("_unit").alias("id"), *made.columns[1:])
        done = single if done is None else done.unionByName(single)
        several = counted.where("_pages > 1")
        if several.isEmpty():
            return done
        line = F.concat(F.lit("Part "), F.col("_page").cast("string"), F.lit(": "), F.col("summary"))
        lines = (
            several.groupBy("_unit", F.floor(F.col("_page") / page_rows).alias("_next"))
            .agg(F.array_sort(F.collect_list(F.struct("_page", line.alias("_line")))).alias("_lines"))
        )
        body = _fenced_part(PAGES_PART, F.array_join(F.transform("_lines", lambda l: l["_line"]), "\n"))
        again = lines.select(
            F.concat_ws("#", "_unit", F.col("_next").cast("string")).alias("id"), F.lit(system).alias("system"), body.alias("user")
        )
        made = durable(summarize_prompts(again, factory), "summaries")
