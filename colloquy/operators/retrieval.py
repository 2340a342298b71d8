"""Vector search over a table of questions, hydration, context and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import text as tx, vectors as vx
from colloquy.operators.models import TextModel, run_text_model
from colloquy.session import durable

# Retrieval defaults and bounds.
TOP_K = 10
MAX_TOP_K = 50
MIN_RESULTS = 3
MIN_SCORE = 0.50
SNIPPET_CHARS = 160
ANSWER_MARK = "## Answer"

# The identity sentence of an answer prompt.
NAMED_USER = (
    "The person who owns this assistant is ",
    ". In the context excerpts, 'user' and '",
    "' refer to the same person — the one speaking or being spoken about.",
)
UNNAMED_USER = "In the context excerpts, 'user' refers to the person who owns this assistant."

# Bytes of the query matrix that is sent to the tasks; more queries are met block by block.
LOCAL_BYTES = 16 << 20
SCORE_DIGITS = 9
# Scores that one task is meant to compute, in few enough tasks: each gives out k hits a query.
PAIRS_PER_TASK = 1 << 28
TASKS_PER_CORE = 4
# Queries and vectors of one matrix product: its scores stay in the processor's cache.
TILE = 512


def _unit_matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows scaled to length one; vectors of another size are an error."""
    lengths = set(np.diff(column.offsets.to_numpy()).tolist()) if len(column) else set()
    if len(lengths) > 1 or (dim is not None and lengths and lengths != {dim}):
        raise ValueError(f"vector size mismatch: {sorted(lengths)}, expected {dim or 'one size'}")
    if not lengths:
        return np.zeros((0, dim or 0))
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, lengths.pop())
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _k_best(query: np.ndarray, score: np.ndarray, item: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best hits of every query, with their places; of equal scores the smallest ids."""
    order = np.lexsort((-score, query))
    query, score, item = query[order], score[order], item[order]
    first = np.searchsorted(query, query)
    # Ids are compared only where the first hit that goes scores like the last one that stays.
    out = np.minimum(first + k, len(query) - 1)
    tied = np.flatnonzero((out == first + k) & (query[out] == query) & (score[out] == score))
    item[tied] = item[tied][np.lexsort((item[tied].astype(str), query[tied]))]
    place = np.arange(len(query)) - first
    stay = place < k
    return query[stay], score[stay], item[stay], place[stay]


def _top_k(query_ids: list[str], matrix: np.ndarray, batches: Iterator[pa.RecordBatch], k: int) -> pa.Table:
    """Run over vector batches, holding k hits per query and about as many that wait.

    All pairs are scored in single precision, which is off by less than ``slack``. Those
    that may reach the last of a query's k hits are scored again in double precision.
    """
    coarse = matrix.astype(np.float32)
    slack = (matrix.shape[1] + 8) * 2.0**-24 + 10.0**-SCORE_DIGITS
    floor = np.full(len(query_ids), -np.inf)
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))]
    waiting = 0

    def settle() -> None:
        query, score, item, place = _k_best(*map(np.concatenate, zip(*found)), k)
        found[:] = [(query, score, item)]
        floor[query[place == k - 1]] = score[place == k - 1]

    for batch in batches:
        if batch.num_rows == 0 or not query_ids:
            continue
        items = batch.column("item_id").cast(pa.string()).to_numpy(zero_copy_only=False)
        rows = _unit_matrix(batch.column("vector"), matrix.shape[1])
        sound = ~np.isnan(rows).any(axis=1)  # the others have no score
        items, rows = items[sound], rows[sound]
        for at in range(0, len(rows), TILE):
            part, names = rows[at : at + TILE], items[at : at + TILE]
            turned = part.astype(np.float32).T
            for first in range(0, len(query_ids), TILE):
                scores = coarse[first : first + TILE] @ turned
                least = (floor[first : first + TILE] - slack).astype(np.float32)
                near = np.flatnonzero(scores.max(axis=1) >= least)
                if not len(near):
                    continue
                scores, least = scores[near], least[near]
                if len(part) > k and np.isneginf(least).any():
                    # No query takes more than k of a block, but for equal scores.
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k] - np.float32(2 * slack))
                q, i = np.divmod(np.flatnonzero(scores >= least[:, None]), len(part))
                q = near[q] + first
                exact = np.round(np.einsum("ij,ij->i", matrix[q], part[i]), SCORE_DIGITS) + 0.0
                stay = exact >= floor[q]
                found.append((q[stay], exact[stay], names[i[stay]]))
                waiting += int(stay.sum())
                if waiting >= k * len(query_ids):
                    settle()
                    waiting = 0
    settle()
    query, score, item = found[0]
    columns = [pa.array(query_ids, pa.string()).take(pa.array(query)), pa.array(item, pa.string()), pa.array(score)]
    return pa.table(columns, names=["query_id", "item_id", "score"])


HITS = "query_id string, item_id string, score double"


def search(
    queries: DataFrame, items: DataFrame, k: int = TOP_K, local_bytes: int = LOCAL_BYTES
) -> DataFrame:
    """The k nearest items by cosine for every query: query_id, item_id, score, rank.

    ``queries`` has query_id and vector, ``items`` item_id and vector. Every task
    keeps k hits per query and only those are shuffled. Scores are rounded to nine
    digits, and equal scores are ranked by id.
    """
    # Queries are read several times, what makes them runs once: also a filter would run it again.
    asked = durable(queries.select("query_id", "vector"), "queries").where("query_id is not null and vector is not null")
    stored = items.where("item_id is not null and vector is not null").select("item_id", "vector")
    count, widest = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = max(1, local_bytes // (8 * (widest or 1)))
    stored, spread = _spread(stored, min(count, most) * stored.count())
    if count <= most:
        partial = _near(stored, asked.toArrow(), k)
    else:
        # Vectors are scanned once for each block of queries; of a block the driver holds one
        # matrix, its hits are written before the next one.
        stored = durable(stored, "vectors") if spread else stored
        blocks = -(-count // max(1, most * 3 // 4))
        number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        parts = (asked.where(number == b).toArrow() for b in range(blocks))
        partial = reduce(DataFrame.unionByName, [durable(_near(stored, part, k), "hits") for part in parts if part.num_rows])
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "item_id", "score", F.col("rank").cast("bigint").alias("rank")
    )


def _spread(stored: DataFrame, pairs: int) -> tuple[DataFrame, bool]:
    """The stored vectors in as many parts as their ``pairs`` ask for, and whether that moved them."""
    # Vectors of few terms are small as files: by size alone one task may read all of them.
    cores = stored.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-pairs // PAIRS_PER_TASK), TASKS_PER_CORE * cores)
    if tasks > cores:
        tasks = -(-tasks // cores) * cores  # no core waits for a last few tasks
    return (stored.repartition(tasks, "item_id"), True) if tasks > 1 else (stored, False)


def _near(stored: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """Each task's k nearest stored vectors for every query of a bounded table."""
    query_ids = asked.column("query_id").to_pylist()
    matrix = _unit_matrix(asked.column("vector").combine_chunks())
    shared = stored.sparkSession.sparkContext.broadcast((query_ids, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = shared.value
        yield from _top_k(names, rows, batches, k).to_batches()

    return stored.mapInArrow(score, HITS)


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))


def search_approx(
    queries: DataFrame,
    items: DataFrame,
    k: int = TOP_K,
    bucket_length: float = 0.5,
    tables: int = 8,
    seed: int = 7,
    salts: int = 16,
) -> DataFrame:
    """Nearest items among those that share a random-projection bucket, re-ranked.

    Buckets are joined by key with the items salted, so one crowded bucket is spread
    over ``salts`` tasks; the few queries of a bucket are repeated per salt.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def shaped(df: DataFrame, key: str) -> DataFrame:
        return df.where(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(
            key, vx.unit(F.col("vector")).alias("unit")
        ).withColumn("features", array_to_vector("unit"))

    stored, asked = shaped(items, "item_id"), shaped(queries, "query_id")
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    ).fit(stored)

    def buckets(df: DataFrame, key: str) -> DataFrame:
        return model.transform(df).select(
            key,
            F.posexplode(F.transform("hashes", lambda h: h)).alias("_table", "_hash"),
        ).select(key, "_table", vector_to_array("_hash")[0].cast("bigint").alias("_bucket"))

    left = buckets(stored, "item_id").withColumn("_salt", F.pmod(F.xxhash64("item_id"), F.lit(salts)))
    right = buckets(asked, "query_id").withColumn(
        "_salt", F.explode(_numbers(salts))
    )
    pairs = left.join(right, ["_table", "_bucket", "_salt"]).select("query_id", "item_id").distinct()
    scored = (
        pairs.join(stored.select("item_id", F.col("unit").alias("_i")), "item_id")
        .join(asked.select("query_id", F.col("unit").alias("_q")), "query_id")
        .select("query_id", "item_id", F.round(vx.dot(F.col("_i"), F.col("_q")), SCORE_DIGITS).alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "item_id", "score", F.col("rank").cast("bigint").alias("rank")
    )


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    found = exact.select("query_id", "item_id").join(
        approximate.select("query_id", "item_id", F.lit(1).alias("_hit")), ["query_id", "item_id"], "left"
    )
    return found.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), F.count("*").alias("exact_hits"))


def hybrid_cutoff(hits: DataFrame, min_results: int = MIN_RESULTS, min_score: float = MIN_SCORE) -> DataFrame:
    """Keep the first hits and every further one that scores enough.

    Scores fall with the rank, so this equals stopping at the first miss.
    """
    return hits.where((F.col("rank") <= min_results) | (F.col("score") >= min_score))


def reduced_tables(wanted: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of all tables that belong to the fragments ``wanted`` (distinct fragment_id).

    Keys walk down the references: fragments, their extracts, segments and conversations,
    and links and statements. Each step cuts a table by the keys of the step before it and
    writes what is left; its size is then known, so the next cut is a broadcast as long as
    the keys are few, and the large tables are scanned where they lie, without a shuffle.
    No text of a row that was not asked for goes further than its scan.
    """
    cut = lambda name, keys, column: durable(
        tables[name].join(keys.select(column).distinct(), column, "left_semi").select(*HYDRATED[name]), f"hit-{name}"
    )
    fragments = cut("fragments", wanted, "fragment_id")
    links = cut("links", wanted, "fragment_id")
    extracts = cut("extracts", fragments, "extract_id")
    segments = cut("segments", extracts, "segment_id")
    return {
        "fragments": fragments, "links": links, "extracts": extracts, "segments": segments,
        "statements": cut("statements", links, "statement_id"), "conversations": cut("conversations", segments, "conv_id"),
    }


#: The columns of each table that a hydrated fragment shows, or that lead on to the next.
HYDRATED = {
    "fragments": ["fragment_id", "extract_id", "fragment_index", "title", "retrieval_text", "status"],
    "links": ["fragment_id", "statement_id", "position_in_fragment"],
    "extracts": ["extract_id", "segment_id", "created_at", "status", "provider", "model"],
    "segments": ["segment_id", "conv_id", "segment_index", "segment_text", "conversation_date", "start_position", "end_position"],
    "statements": ["statement_id", "statement_index", "speaker", "text"],
    "conversations": ["conv_id", "title", "source_platform"],
}


def hydrate_fragments(requests: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Fragments with their lineage and ordered statements, per request row.

    ``requests`` has fragment_id and any columns that say who asked and in which
    order; they come back on every row, so order and repeats are kept. Unknown ids
    are left out. Only rows of requested fragments are joined, see ``reduced_tables``.
    """
    hit = reduced_tables(durable(requests.select("fragment_id").distinct(), "wanted"), tables)
    linked = (
        hit["links"].join(hit["statements"], "statement_id")
        .groupBy("fragment_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("position_in_fragment", "statement_id", "statement_index", "speaker", "text"))
            ).alias("statements")
        )
    )
    rows = (
        hit["fragments"].withColumnRenamed("status", "fragment_status")
        .join(hit["extracts"].withColumnRenamed("status", "extract_status"), "extract_id")
        .join(hit["segments"], "segment_id")
        .join(hit["conversations"].withColumnRenamed("title", "conversation_title"), "conv_id")
        .join(linked, "fragment_id", "left")
    )
    none = F.array().cast(linked.schema["statements"].dataType)
    return requests.join(
        rows.withColumn("statements", F.coalesce("statements", none)), "fragment_id"
    )


def statement_lines(statements: Column) -> Column:
    return F.transform(statements, lambda s: F.concat(s["speaker"], F.lit(": "), s["text"]))


def snippet(title: Column, statements: Column) -> Column:
    body = F.array_join(statement_lines(F.slice(statements, 1, 2)), " / ")
    named = F.concat(F.lit("["), title, F.lit("] "), body)
    whole = F.when(F.coalesce(title, F.lit("")) != "", named).otherwise(body)
    return tx.preview(whole, SNIPPET_CHARS, "...")


def retrieve(
    questions: DataFrame,
    indexed: DataFrame,
    tables: dict[str, DataFrame],
    k: int = TOP_K,
    min_results: int = MIN_RESULTS,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Search, cut off and hydrate for a table of questions (query_id, vector).

    ``indexed`` has fragment_id and vector. ``k`` is kept inside [1, 50].
    """
    hits = search(questions, indexed.select(F.col("fragment_id").alias("item_id"), "vector"), min(max(k, 1), MAX_TOP_K))
    kept = hybrid_cutoff(hits, min_results, min_score).withColumnRenamed("item_id", "fragment_id")
    # Hits are few and dear: written once, so that no join runs the search again.
    return hydrate_fragments(durable(kept, "hits"), tables)


def context_blocks(hydrated: DataFrame) -> DataFrame:
    """The excerpt block of every question; at most fifty excerpts each.

    Excerpts are numbered by rank among the fragments that were found.
    """
    date = F.coalesce("conversation_date", "created_at")
    stamp = F.coalesce(tx.iso(date), F.lit(""))
    lines = F.concat(
        F.when(F.coalesce("title", F.lit("")) != "", F.array(F.concat(F.lit("Topic: "), F.col("title")))).otherwise(
            F.array().cast("array<string>")
        ),
        statement_lines(F.col("statements")),
    )
    body = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.col("retrieval_text"))
    entry = F.struct("rank", "segment_id", stamp.alias("date"), body.alias("body"))
    numbered = F.transform(
        "_rows",
        lambda r, i: F.concat(
            F.lit("--- Excerpt "), (i + 1).cast("string"), F.lit(" (segment: "), r["segment_id"],
            F.lit(", date: "), r["date"], F.lit(") ---\n"), r["body"],
        ),
    )
    return (
        hydrated.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
        .select("query_id", F.array_join(numbered, "\n\n").alias("context_block"))
    )


def citations(hydrated: DataFrame) -> DataFrame:
    """Rank among the found fragments, and what to cite."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return hydrated.select(
        "query_id",
        F.row_number().over(order).cast("bigint").alias("rank"),
        "fragment_id",
        F.coalesce("title", F.lit("")).alias("title"),
        "segment_id",
        "conversation_date",
    )


def user_context(user_name: Column) -> Column:
    name = tx.strip(F.coalesce(user_name, F.lit("")))
    first, second, third = map(F.lit, NAMED_USER)
    return F.when(name != "", F.concat(first, name, second, name, third)).otherwise(UNNAMED_USER)


def answer_post(raw: Column) -> Column:
    """Keep what follows the first answer heading, stripped."""
    at = F.instr(raw, ANSWER_MARK)
    rest = raw.substr(at + len(ANSWER_MARK), F.length(raw))
    return tx.strip(F.when(at > 0, rest).otherwise(raw))


def answer_extractive(questions: DataFrame, hydrated: DataFrame, dim: int = 64) -> DataFrame:
    """Baseline answer: the statement most like the question among its fragments.

    Questions have query_id, text and vector; no hits give an empty answer.
    """
    options = durable(
        hydrated.select("query_id", "rank", F.explode("statements").alias("_s")).select(
            "query_id", "rank", "_s.statement_id", "_s.text", "_s.position_in_fragment"
        ),
        "options",
    )
    # A statement is embedded once, however many hits and questions show it.
    shown = options.select("statement_id", "text").dropDuplicates(["statement_id"])
    vectors = shown.select("statement_id", vx.hashed_vectors(tx.words(F.col("text")), dim).alias("_v"))
    scored = (
        options.join(vectors, "statement_id")
        .join(questions.select("query_id", F.col("vector").alias("_q")), "query_id")
        .withColumn("score", F.round(F.coalesce(vx.dot(F.col("_q"), F.col("_v")), F.lit(0.0)), 6))
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", "position_in_fragment")
    chosen = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return questions.select("query_id").join(chosen, "query_id", "left").select(
        "query_id",
        F.coalesce("text", F.lit("")).alias("answer"),
        "statement_id",
        "score",
    )


def answer_with_model(
    questions: DataFrame,
    hydrated: DataFrame,
    factory: Callable[[], TextModel],
    template: str,
    user_name: str = "",
) -> DataFrame:
    """Model answers from the context block; questions without hits stay empty."""
    filled = F.replace(F.lit(template), F.lit("{question}"), F.col("text"))
    filled = F.replace(filled, F.lit("{context_block}"), F.col("context_block"))
    filled = F.replace(filled, F.lit("{user_context}"), user_context(F.lit(user_name)))
    prompts = questions.join(context_blocks(hydrated), "query_id").select(
        F.col("query_id").alias("id"), filled.alias("prompt")
    )
    answers = run_text_model(prompts, factory).withColumnRenamed("id", "query_id")
    return questions.select("query_id").join(answers, "query_id", "left").select(
        "query_id", F.coalesce(answer_post(F.col("raw")), F.lit("")).alias("answer"), "error"
    )


def vector_dims(items: DataFrame) -> DataFrame:
    """How many vectors there are of each size; more than one row is a fault."""
    return items.where("vector is not null").groupBy(F.size("vector").cast("bigint").alias("dim")).agg(
        F.count("*").alias("vectors")
    )


def index_fragments(fragments: DataFrame, factory=None, dim: int = 64) -> DataFrame:
    """Embed fragments that lack a vector; the point key is the fragment id.

    Returns the rows to write back: fragment_id, point_id, vector, error.
    """
    from colloquy.operators.models import embed

    todo = fragments.where("vector is null").select(
        "fragment_id", tx.strip(F.col("retrieval_text")).alias("_text")
    )
    return embed(todo, "_text", factory, dim).select(
        "fragment_id",
        F.when(F.col("vector").isNotNull(), F.concat(F.lit("pt_"), F.col("fragment_id"))).alias("point_id"),
        "vector",
        "error",
    )
