"""Whole runs of model stages: batched calls, a log that runs resume from, whole rows.

The log is a table of (unit, attempt): what was asked, the raw answer, the error. A run
appends to it and asks only for what it does not answer yet, so a run that was ended goes
on where it stopped, and an answer is paid for once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colloquy.functions import ids, lenient_json
from colloquy.operators import blocks as bl
from colloquy.operators import fragments as fr
from colloquy.operators import statements as st
from colloquy.operators.models import MODEL_SCHEMA, TextModel
from colloquy.operators.summaries import CONTEXT_PART, SEGMENT_PART
from colloquy.session import durable

#: Answers a list of prompts in their order. A factory is called once per task.
BatchModel = Callable[[list[str]], list[str]]

#: Estimated tokens of the prompts of one call (four bytes each), and seconds it may take.
CALL_TOKENS, CALL_SECONDS = 16_000, 600.0
#: Further attempts after an answer that could not be read.
RETRIES = 2

LOG = "id string, print string, attempt int, raw string, error string, latency_ms bigint, ok boolean"


def one_by_one(factory: Callable[[], TextModel]) -> Callable[[], BatchModel]:
    """A batch model of one that answers a single prompt."""

    def make() -> BatchModel:
        model = factory()
        return lambda prompts: [model(p) for p in prompts]

    return make


def run_text_batches(
    prompts: DataFrame, factory: Callable[[], BatchModel], tokens: int = CALL_TOKENS, seconds: float = CALL_SECONDS
) -> DataFrame:
    """Answer every (id, prompt) row, several prompts a call, as many as ``tokens`` allow.

    A call that fails, gives another number of answers or takes longer than ``seconds`` is
    made again prompt by prompt, so a failure costs its own row only; that row has an
    ``error``. A prompt beyond the budget is a call of its own. A call's time is shared by
    its rows. A call that is too late is left to itself; the task goes on without it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from concurrent.futures import ThreadPoolExecutor, TimeoutError as Late

        model = factory()
        pool = ThreadPoolExecutor(1)

        def call(asked: list[str]) -> list[str]:
            nonlocal pool
            waiting = pool.submit(model, asked)
            try:
                found = list(waiting.result(seconds))
            except Late:
                pool.shutdown(wait=False)
                pool = ThreadPoolExecutor(1)
                raise TimeoutError(f"no answer in {seconds:g} seconds") from None
            if len(found) != len(asked):
                raise ValueError(f"{len(found)} answers to {len(asked)} prompts")
            return found

        def answered(rows: list[tuple[str, str]]) -> list[tuple]:
            started = time.monotonic()
            spent = lambda n: int((time.monotonic() - started) * 1000 / n)
            try:
                found = call([p for _, p in rows])
                return [(key, raw, None, spent(len(rows))) for (key, _), raw in zip(rows, found)]
            except Exception as problem:
                if len(rows) == 1:
                    return [(rows[0][0], None, f"{type(problem).__name__}: {problem}", spent(1))]
            return [answer for row in rows for answer in answered([row])]

        try:
            for batch in batches:
                held, size, out = [], 0, []
                for key, prompt in zip(batch["id"], batch["prompt"]):
                    cost = len(prompt.encode()) // 4 + 1
                    if held and size + cost > tokens:
                        out += answered(held)
                        held, size = [], 0
                    held.append((key, prompt))
                    size += cost
                if held:
                    out += answered(held)
                yield pd.DataFrame(out, columns=["id", "raw", "error", "latency_ms"])
        finally:
            pool.shutdown(wait=False)

    return prompts.where("prompt is not null").select("id", "prompt").mapInPandas(run, MODEL_SCHEMA)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a log, each attempt of a unit once; empty before the first run."""
    try:
        rows = spark.read.schema(LOG).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)
    first = F.min(F.struct(*[c for c in rows.columns if c not in ("id", "print", "attempt")])).alias("_row")
    return rows.groupBy("id", "print", "attempt").agg(first).select("id", "print", "attempt", "_row.*")


def is_json(answers: DataFrame) -> Column:
    return lenient_json.parse_strict(F.col("raw")).isNotNull() | lenient_json.parse_strict(lenient_json.strip_fences(F.col("raw"))).isNotNull()


def ask(
    prompts: DataFrame,
    factory: Callable[[], BatchModel],
    path: str,
    retries: int = RETRIES,
    accept: Callable[[DataFrame], Column] = is_json,
    **batches,
) -> DataFrame:
    """The final answer to every (id, prompt): id, attempts, raw, error, latency_ms, ok.

    An answer that ``accept`` does not take is asked for again, up to ``retries`` times; a
    call that fails ends its unit. All attempts go to the log at ``path``, a changed prompt
    is another unit. ``latency_ms`` sums a unit's attempts.
    """
    spark = prompts.sparkSession
    units = durable(prompts.select("id", "prompt", F.sha2("prompt", 256).alias("print")), "units")
    for _ in range(retries + 1):
        state = read_log(spark, path).groupBy("id", "print").agg(
            F.max("attempt").alias("_last"), F.bool_or(F.col("ok") | F.col("error").isNotNull()).alias("_done")
        )
        open_units = units.join(state, ["id", "print"], "left").where(
            ~F.coalesce("_done", F.lit(False)) & (F.coalesce("_last", F.lit(-1)) < retries)
        )
        todo = durable(open_units.select("id", "prompt", "print", (F.coalesce("_last", F.lit(-1)) + 1).alias("attempt")), "todo")
        if todo.isEmpty():
            break
        answers = run_text_batches(todo, factory, **batches).withColumn("ok", F.coalesce(accept(prompts), F.lit(False)))
        answers.join(todo.select("id", "print", "attempt"), "id").select(
            "id", "print", "attempt", "raw", "error", "latency_ms", "ok"
        ).write.mode("append").parquet(path)
    log = read_log(spark, path).join(units.select("id", "print"), ["id", "print"], "left_semi")
    last = F.max_by(F.struct("raw", "error", "ok"), "attempt").alias("_row")
    return log.groupBy("id").agg(F.count("*").alias("attempts"), F.sum("latency_ms").alias("latency_ms"), last).select(
        "id", "attempts", "_row.raw", "_row.error", "latency_ms", "_row.ok"
    )


# Extracts


DESCRIPTION = (
    "struct<block_kind:string,is_instruction_like:boolean,brief_description:string,"
    "mentions:array<string>,commands:array<string>,paths:array<string>>"
)


def describe_with_model(blocks: DataFrame, factory: Callable[[], BatchModel], template: str, path: str) -> DataFrame:
    """``archival_description`` of each block by a model; null where it gave none.

    ``template`` holds ``{block_text}``. Blocks are known by their text's id and number.
    """
    named = blocks.withColumn("_unit", F.concat_ws("#", F.col("id").cast("string"), "block_id"))
    prompt = F.replace(F.lit(template), F.lit("{block_text}"), F.col("raw_text"))
    answers = ask(named.select(F.col("_unit").alias("id"), prompt.alias("prompt")), factory, path, retries=0)
    parsed = st.read_model_output(answers).select(
        F.col("id").alias("_unit"),
        F.when(F.schema_of_variant("parsed").startswith("OBJECT"), F.try_variant_get("parsed", "$", DESCRIPTION)).alias("archival_description"),
    )
    return named.join(parsed, "_unit", "left").drop("_unit")


def model_extracts(
    segments: DataFrame,
    factory: Callable[[], TextModel],
    template: str,
    model: str,
    describe: Callable[[DataFrame], DataFrame] = bl.describe_blocks,
) -> dict[str, DataFrame]:
    """Whole rows of a ladder run: ``extracts``, ``statements`` and ``blocks``.

    Extracts carry the attempt that was taken, the time of all attempts, the model, the
    status with its warnings, and their archived blocks in order. Blocks are keyed by
    extract_id, as ``expand_placeholders`` takes them.
    """
    found = st.ladder(segments, factory, template, describe)
    blocks = found["blocks"].withColumn("extract_id", ids.extract_id(F.col("id"))).drop("id")
    shown = ["block_no", "block_id", "block_kind", "speaker", "line_count", "char_count", "raw_text", "archival_description"]
    archived = blocks.groupBy("extract_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("archived_blocks"))
    heads = segments.select("segment_id", "segment_index", "conv_id", *[c for c in ("conversation_date",) if c in segments.columns])
    extracts = (
        found["picked"].join(found["latency"], "segment_id").join(heads, "segment_id")
        .withColumn("extract_id", ids.extract_id(F.col("segment_id")))
        .join(archived, "extract_id", "left")
        .select(
            "extract_id", *heads.columns, F.lit("local").alias("provider"), F.lit(model).alias("model"),
            "status", st.clean_warnings(F.col("warnings")).alias("warnings"), F.col("attempt").alias("extraction_attempt"), "latency_ms",
            F.coalesce("archived_blocks", F.array().cast(archived.schema["archived_blocks"].dataType)).alias("archived_blocks"),
        )
    )
    return {"extracts": extracts, "statements": found["statements"], "blocks": blocks}


# Fragments


def model_fragments(
    extracts: DataFrame,
    statements: DataFrame,
    blocks: DataFrame,
    factory: Callable[[], BatchModel],
    template: str,
    model: str,
    path: str,
    retries: int = RETRIES,
) -> dict[str, DataFrame]:
    """Whole fragments of a model's grouping: ``fragments``, ``links`` and ``runs``.

    Batches of statements are asked for with retries, through the log at ``path``.
    Placeholders of archived blocks are replaced by what the block is about, with a note
    below the text. A fragment has its extract's status and warnings, the span of its
    statements, and links: by statement index where the answer has them, by text else.
    """
    prompts = durable(fr.fragment_prompts(statements, template), "prompts")
    answers = durable(ask(prompts.select("id", "prompt"), factory, path, retries), "grouping")
    members, runs = fr.grouped_answers(answers.select("id", "raw", "error", "latency_ms"), prompts)
    members, runs = durable(members, "members"), durable(runs, "runs")
    real = members.where("speaker is not null or text is not null")
    shown = bl.expand_placeholders(real, blocks, ["extract_id", "fragment_index", "position_in_fragment"], "extract_id")
    line = F.concat(F.coalesce("speaker", F.lit("?")), F.lit(": "), F.coalesce("text", F.lit("")))
    bodies = shown.groupBy("extract_id", "fragment_index").agg(
        F.array_sort(F.collect_list(F.struct("position_in_fragment", line.alias("line"), "notes"))).alias("_rows"),
        F.min("statement_index").alias("statement_start_index"),
        F.max("statement_index").alias("statement_end_index"),
        F.count("*").alias("statement_count"),
    )
    titles = members.groupBy("extract_id", "fragment_index").agg(F.coalesce(F.max("title"), F.lit("")).alias("title"))
    lines = F.coalesce(F.transform("_rows", lambda r: r["line"]), F.array().cast("array<string>"))
    notes = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["notes"])))), F.array().cast("array<string>"))
    status = st.resolve_status(F.lit(False), F.col("is_partial"), F.col("is_degraded"))
    heads = extracts.select("extract_id", "segment_id", "segment_index", "conv_id")
    fragments = durable(
        titles.join(bodies, ["extract_id", "fragment_index"], "left").join(runs, "extract_id").join(heads, "extract_id").select(
            ids.fragment_id(F.col("extract_id"), F.col("fragment_index")).alias("fragment_id"),
            *heads.columns, "fragment_index", "title",
            fr.fragment_text(F.col("title"), lines, notes).alias("retrieval_text"),
            status.alias("status"),
            F.when(status != "ok", st.clean_warnings(F.array("warning"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
            "statement_start_index", "statement_end_index", F.coalesce("statement_count", F.lit(0)).alias("statement_count"),
            F.lit("local").alias("provider"), F.lit(model).alias("model"), "latency_ms",
        ),
        "fragments",
    )
    keyed = real.withColumn("fragment_id", ids.fragment_id(F.col("extract_id"), F.col("fragment_index")))
    told = keyed.select("fragment_id", "position_in_fragment", "text", "statement_index")
    no_links = statements.sparkSession.createDataFrame([], "fragment_id string, statement_id string, position_in_fragment bigint")
    return {"fragments": fragments, "links": fr.repair_links_by_text(fragments, told, statements, no_links), "runs": runs}


# Summaries


SUMMARIES = "segment_id string, conv_id string, segment_index bigint, summary string, raw string, error string"
CONTEXT = "conv_id string, segment_index bigint, summary string"


def summarize_range(
    segments: DataFrame, factory: Callable[[], TextModel], context: DataFrame | None = None, size: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(summaries, context) of segments, each asked for with the ``size`` summaries before it.

    ``context`` (conv_id, segment_index, summary) is what an earlier range left, or
    summaries from elsewhere; only rows before a conversation's first segment here count.
    The context that comes back serves the next range: so ranges one after the other give
    what one run gives. A conversation is one sequence, each prompt needs the answers
    before it: a task reads its conversations in order and holds ``size`` summaries.
    """
    rows = segments.select("conv_id", "segment_index", "segment_id", "segment_text", F.lit(None).cast("string").alias("known"))
    if context is not None:
        begins = segments.groupBy("conv_id").agg(F.min("segment_index").alias("_first"))
        earlier = context.join(begins, "conv_id").where(F.col("segment_index") < F.col("_first"))
        rows = rows.unionByName(
            _last(earlier, size).select("conv_id", "segment_index", F.lit(None).cast("string").alias("segment_id"), F.lit(None).cast("string").alias("segment_text"), F.col("summary").alias("known"))
        )

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, conversation = factory(), None
        prior: list[str] = []
        for batch in batches:
            out = []
            for conv_id, index, segment_id, body, known in batch.itertuples(index=False, name=None):
                if conv_id != conversation:
                    conversation, prior = conv_id, []
                if segment_id is None:
                    prior = [*prior, known][-size:]
                    continue
                told = "\n".join(f"Segment {i}: {s}" for i, s in enumerate(prior))
                parts = ([(CONTEXT_PART, told)] if told else []) + [(SEGMENT_PART, body)]
                raw, summary, error = None, None, None
                try:
                    raw = model("\n\n".join(f"---BEGIN {n}---\n{b}\n---END {n}---" for n, b in parts))
                    summary = str(lenient_json.loads(raw).get("summary", ""))
                    prior = [*prior, summary][-size:]
                except Exception as problem:
                    error = f"{type(problem).__name__}: {problem}"
                out.append((segment_id, conv_id, index, summary, raw, error))
            yield pd.DataFrame(out, columns=["segment_id", "conv_id", "segment_index", "summary", "raw", "error"])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment_index")
    made = durable(ordered.mapInPandas(in_order, SUMMARIES), "summaries")
    fresh = made.where("summary is not null").select("conv_id", "segment_index", "summary")
    known = fresh if context is None else context.select("conv_id", "segment_index", "summary").unionByName(fresh)
    return made, durable(_last(known, size), "context")


def _last(rows: DataFrame, size: int) -> DataFrame:
    """The last ``size`` rows of each conversation; a segment that is there twice counts once."""
    once = rows.groupBy("conv_id", "segment_index").agg(F.max("summary").alias("summary"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("segment_index"))
    return once.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= size).drop("_n")


def persist_run(store, rows: dict[str, DataFrame]) -> dict[str, list[int]]:
    """Put the rows of a run into a bucketed store; what an earlier run stored for the same
    extracts or segments goes. Returns the buckets that were rewritten."""
    return {name: store[name].replace(df.select(*store[name].schema.names), df) for name, df in rows.items()}
