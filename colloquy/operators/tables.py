"""Keeping stage tables: idempotent inserts, upserts, cascading deletes, checks.

Operators take and return DataFrames; ``replace_table`` and ``append_table`` write.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from colloquy.schemas import JOB_STATUSES, TABLES
from colloquy.session import durable


def first_per_key(batch: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The earliest row of each key. Partial aggregation copes with hot keys."""
    rest = [c for c in batch.columns if c not in keys]
    row = F.min_by(F.struct(*rest), arrival).alias("_row")
    return batch.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*batch.columns)


def insert_ignore(
    target: DataFrame, batch: DataFrame, keys: list[list[str]], arrival: str = "arrival"
) -> DataFrame:
    """Rows of ``batch`` to append: no unique key is taken yet; first row wins.

    With one key set this is one aggregation and one anti-join. With several, a row
    that loses on one key must not block others: see ``greedy_rows``. A key with a null
    part is nobody's copy.
    """
    fresh = batch
    for key in keys:
        # Stored keys are cut to the batch's first: a small batch is broadcast by
        # its size, and a large target is then scanned without a shuffle.
        taken = target.select(*key).join(batch.select(*key), key, "left_semi")
        fresh = fresh.join(taken, key, "left_anti")
    if len(keys) == 1:
        return first_per_key(fresh, keys[0], arrival).drop(arrival)
    return greedy_rows(fresh.select(*batch.columns), keys, arrival).drop(arrival)


def greedy_rows(batch: DataFrame, keys: list[list[str]], arrival: str) -> DataFrame:
    """The rows that are kept when each in turn goes if it shares a key with a kept one.

    Decided in rounds on a narrow table of row numbers and keys. Each round accepts the
    rows that come first for all of their keys. A row that only one earlier row can still
    keep out is decided by that one: such rows point at it, and pointer doubling follows
    whole chains of them, so a chain takes the logarithm of its length. What shares a key
    with an accepted row goes; the rest is the next round's. Each group of a key hands on
    its first two rows only, cut before the shuffle.
    """
    rows = durable(batch.withColumn("_id", F.struct(F.col(arrival).alias("at"), F.monotonically_increasing_id().alias("n"))), "insert")
    known = lambda key: reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
    names = [f"_k{j}" for j in range(len(keys))]
    left = rows.select("_id", *[F.when(known(key), F.struct(*key)).alias(n) for n, key in zip(names, keys)])
    accepted: list[DataFrame] = []
    while not left.isEmpty():
        seen = left
        for n in names:
            rank = F.row_number().over(Window.partitionBy(n).orderBy("_id"))
            heads = (
                left.where(F.col(n).isNotNull()).select(n, "_id").withColumn("_rank", rank).where("_rank <= 2")
                .groupBy(n).agg(F.min("_id").alias(f"_first{n}"), F.max("_id").alias(f"_second{n}"))
            )
            seen = seen.join(heads, n, "left")
        behind = [F.when(F.col("_id") != F.col(f"_first{n}"), F.col(f"_first{n}")) for n in names]
        deep = [F.coalesce((F.col("_id") != F.col(f"_first{n}")) & (F.col("_id") != F.col(f"_second{n}")), F.lit(False)) for n in names]
        ahead = F.array_distinct(F.array_compact(F.array(*behind)))
        state = durable(
            seen.select("_id", *names, ahead.alias("_ahead"), reduce(Column.__or__, deep).alias("_deep")).select(
                "_id", *names, (F.size("_ahead") == 0).alias("_free"),
                F.when((F.size("_ahead") == 1) & ~F.col("_deep"), F.element_at("_ahead", 1)).alias("_to"),
            ),
            "insert",
        )
        free = state.where("_free").select("_id")
        ends = _chain_ends(state.where("_to is not null").select("_id", "_to"))
        even = ends.where("not _odd").join(free.withColumnRenamed("_id", "_to"), "_to", "left_semi").select("_id")
        taken = durable(state.join(free.unionByName(even), "_id", "left_semi").select("_id", *names), "insert")
        accepted.append(taken.select("_id"))
        for n in names:
            state = state.join(taken.where(F.col(n).isNotNull()).select(n), n, "left_anti")
        left = durable(state.join(taken, "_id", "left_anti").select("_id", *names), "insert")
    if not accepted:
        return batch.limit(0)
    return rows.join(reduce(DataFrame.unionByName, accepted), "_id", "left_semi").select(*batch.columns)


def _chain_ends(steps: DataFrame) -> DataFrame:
    """``_id, _to, _odd``: where following ``_to`` ends, and whether after an odd number of steps."""
    jump, moved = steps.withColumn("_odd", F.lit(True)), True
    while moved:
        further = jump.select(F.col("_id").alias("_to"), F.col("_to").alias("_far"), F.col("_odd").alias("_more"))
        seen = Observation()
        joined = jump.join(further, "_to", "left").observe(seen, F.count("_far").alias("moved"))
        jump = durable(
            joined.select("_id", F.coalesce("_far", "_to").alias("_to"), (F.col("_odd") != F.coalesce("_more", F.lit(False))).alias("_odd")),
            "insert",
        )
        moved = seen.get["moved"]
    return jump


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """The table after the batch: the last row of each key replaces the old one."""
    latest = first_per_key(batch.withColumn("_reverse", -F.col(arrival)), keys, "_reverse")
    kept = target.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.select(*target.columns))


def set_embedding(fragments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Write point id, time and model back to the fragments they belong to."""
    fields = ["point_id", "embedded_at", "embedding_model"]
    new = vectors.select("fragment_id", *[F.col(c).alias(f"_{c}") for c in fields])
    return fragments.join(new, "fragment_id", "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in fragments.columns]
    )


def delete_keys(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without the given keys; an empty key table changes nothing."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def in_range(index: Column, first: int = 0, last: int | None = None) -> Column:
    check_range(first, last)
    return index >= first if last is None else index.between(first, last)


def check_range(first: int, last: int | None) -> None:
    for bound in (first, last):
        if bound is not None and (not isinstance(bound, int) or isinstance(bound, bool) or bound < 0):
            raise ValueError("segment range bounds must be integers >= 0")
    if last is not None and first > last:
        raise ValueError("segment range must not end before it starts")


def delete_segments(segments: DataFrame, conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove the given segments of the given conversations."""
    gone = segments.join(conversations, "conv_id", "left_semi").join(ids, "segment_id", "left_semi")
    return delete_keys(segments, gone, "segment_id")


def delete_segment_summaries(summaries: DataFrame, segments: DataFrame) -> DataFrame:
    """Remove the summaries of the given segments."""
    return delete_keys(summaries, segments, "segment_id")


def delete_extracts(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove extracts with their links, fragments and statements.

    ``gone`` has extract_id. Also returns ``points``: the vector ids to purge.
    """
    lost = tables["fragments"].join(gone.select("extract_id").distinct(), "extract_id", "left_semi")
    return {
        "links": delete_keys(tables["links"], lost, "fragment_id"),
        "fragments": delete_keys(tables["fragments"], gone, "extract_id"),
        "extracts": delete_keys(tables["extracts"], gone, "extract_id"),
        "statements": delete_keys(tables["statements"], gone, "extract_id"),
        "points": lost.where("point_id is not null").select("point_id"),
    }


def delete_fragments(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Remove the fragments of the given extracts and their links; statements stay."""
    after = delete_extracts(tables, gone)
    return {name: after[name] for name in ("links", "fragments", "points")}


def delete_topics(topics: DataFrame, topic_segments: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the topics of the given conversations and their segment rows."""
    lost = topics.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    return delete_keys(topics, lost, "topic_id"), delete_keys(topic_segments, lost, "topic_id")


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose reference has no target: table, column, value and how many."""
    found = []
    for name, df in tables.items():
        for column, parent, parent_column in TABLES[name].references:
            if parent not in tables:
                continue
            # Counting values first keeps a hot value to one row in the join.
            values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
            parents = tables[parent].select(F.col(parent_column).alias("value")).distinct()
            orphans = values.join(parents, "value", "left_anti")
            found.append(orphans.select(F.lit(name).alias("table"), F.lit(column).alias("column"), "value", "rows"))
    return reduce(DataFrame.unionByName, found)


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that occur more than once, and job states outside the allowed four."""
    found = []
    for name, df in tables.items():
        for key in TABLES[name].keys:
            value = F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("value")
            counts = df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
            found.append(counts.select(F.lit(name).alias("table"), F.lit(",".join(key)).alias("rule"), value, "rows"))
        if name == "jobs":
            bad = df.where(~F.col("status").isin(*JOB_STATUSES)).groupBy(F.col("status").alias("value")).agg(F.count("*").alias("rows"))
            found.append(bad.select(F.lit(name).alias("table"), F.lit("status").alias("rule"), "value", "rows"))
    return reduce(DataFrame.unionByName, found)


def resume_plan(inputs: DataFrame, outputs: DataFrame, key: str, on_presence: bool = False) -> DataFrame:
    """Inputs still to run: not done, or (unless presence is enough) failed before."""
    redo = F.col("_status").isNull()
    if not on_presence:
        redo = redo | F.col("_status").isin("skipped", "partial")
    status = outputs.select(key, F.coalesce("status", F.lit("ok")).alias("_status"))
    return inputs.join(status, key, "left").where(redo).drop("_status")


def force_rerun(table: DataFrame, recomputed: DataFrame, conversations: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Replace the rows of a segment range in the given conversations.

    Rows outside the range stay as they are; ``recomputed`` is cut to the range.
    """
    wanted = conversations.select("conv_id").distinct()
    inside = in_range(F.col("segment_index"), first, last)
    chosen = table.where(inside).join(wanted, "conv_id", "left_semi").select("segment_id")
    fresh = recomputed.where(inside).join(wanted, "conv_id", "left_semi")
    return delete_keys(table, chosen, "segment_id").unionByName(fresh.select(*table.columns))


def force_rerun_cascade(
    tables: dict[str, DataFrame], rebuilt: dict[str, DataFrame], conversations: DataFrame, first: int = 0, last: int | None = None
) -> dict[str, DataFrame]:
    """The tables after running extraction anew for a segment range of some conversations.

    The range's extracts go with their statements, fragments and links; what ``rebuilt``
    has for the same segments takes their place. Also returns ``points``: the ids of the
    vectors to purge. ``rebuilt`` has extracts, statements, fragments and links.
    """
    inside, wanted = in_range(F.col("segment_index"), first, last), conversations.select("conv_id").distinct()
    chosen = lambda t: t["extracts"].where(inside).join(wanted, "conv_id", "left_semi")
    after = delete_extracts(tables, chosen(tables))
    fresh = chosen(rebuilt).select("extract_id")
    part = {name: rebuilt[name].join(fresh, "extract_id", "left_semi") for name in ("extracts", "statements", "fragments")}
    part["links"] = rebuilt["links"].join(part["fragments"].select("fragment_id"), "fragment_id", "left_semi")
    return {**{name: after[name].unionByName(df.select(*after[name].columns)) for name, df in part.items()}, "points": after["points"]}


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table that ``df`` may itself read: written aside first."""
    durable(df, "replace").write.mode("overwrite").parquet(path)
