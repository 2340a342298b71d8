"""Structured Streaming counterparts of re-import, late replies and the job log.

Each micro-batch is handed to the batch operators. State lives in tables under the
output folder, written per batch id, so a repeated batch overwrites its own files
and nothing is emitted twice. No key's history is held in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from colloquy.functions import ids
from colloquy.operators import messages as ms
from colloquy.operators import segments as sg
from colloquy.operators import tables as tb
from colloquy.session import durable

# Parts of a key table: a batch reads those that its keys fall into.
KEY_PARTS = 64

# Which job states may follow which.
NEXT_STATUSES = {None: ("pending",), "pending": ("running",), "running": ("succeeded", "failed")}


def run_available(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process what is there now, batch by batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _saved(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    """State as it was before ``batch_id``: the part the batch before it wrote."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={batch_id - 1}")


def _finished(spark: SparkSession, path: str, batch_id: int) -> None:
    """Note a batch whose files are all written."""
    spark.createDataFrame([(batch_id,)], "done bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/done/batch={batch_id}")


def last_batch(spark: SparkSession, path: str) -> int:
    """The last batch that a sink has written in full, whether or not it had rows."""
    return spark.read.schema("done bigint").parquet(f"{path}/done").agg(F.max("done")).first()[0]


def insert_ignore_sink(
    path: str, keys: list[str], arrival: str, late: tuple[str, str] | None = None
) -> Callable[[DataFrame, int], None]:
    """Idempotent persist: every batch appends the rows whose key is not stored.

    Nothing is ever too late to be stored. With ``late``, a group and a time column,
    the new rows older than what the group had before are written to a side table as
    well. Stored rows lie in parts by key; a batch reads the parts of its own keys.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*(keys if late is None else [late[0]])), F.lit(KEY_PARTS)).cast("int")
        rows = durable(batch.withColumn("part", part), "batch")
        schema = rows.drop(arrival).schema
        stored = spark.createDataFrame([], schema)
        if batch_id > 0:
            touched = [r["part"] for r in rows.select("part").distinct().collect()]
            held = StructType([*schema.fields, StructField("batch", IntegerType())])
            stored = spark.read.schema(held).parquet(f"{path}/rows")
            stored = stored.where(F.col("part").isin(touched) & (F.col("batch") < batch_id)).drop("batch")
        fresh = durable(tb.insert_ignore(stored, rows, [keys], arrival), "fresh")
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows/batch={batch_id}")
        if late is not None:
            group, time = late
            newest = stored.groupBy(group).agg(F.max(time).alias("_newest"))
            behind = fresh.join(newest, group).where(F.col(time) < F.col("_newest")).drop("_newest", "part")
            behind.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        _finished(spark, path, batch_id)

    return each


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch", "part")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the side table: what ``resegment`` takes as late messages."""
    return spark.read.parquet(f"{path}/late").drop("batch")


def segment_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Emit segments as soon as the user message that closes them is settled.

    A user message may still be retried until a reply or another message follows it, so
    a conversation that ends in one keeps its last two groups open, any other its last
    group. Open groups are kept with their segment number and taken up again when more
    messages arrive. Messages need ``ordinal`` and must arrive in conversation order from
    batch to batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = ["conv_id", "message_id", "speaker", "created_at", "ordinal", "content"]
        fresh = batch.select(*columns)
        state_schema = fresh.withColumn("first_index", F.lit(0).cast("bigint")).schema
        state = _saved(spark, f"{path}/open", batch_id, state_schema)
        touched = fresh.select("conv_id").distinct()
        resumed = state.join(touched, "conv_id", "left_semi")
        base = resumed.groupBy("conv_id").agg(F.max("first_index").alias("first_index"))
        grouped = durable(
            ms.assign_positions(ms.collapse_retries(resumed.select(*columns).unionByName(fresh))),
            "grouped",
        )
        ends = grouped.groupBy("conv_id").agg(
            F.max("segment_index").alias("_end"), F.max_by("speaker", "ordinal").alias("_speaker")
        )
        # The first group that stays open.
        unsettled = (F.col("_speaker") == "user").cast("bigint")
        last = ends.select("conv_id", F.greatest(F.col("_end") - unsettled, F.lit(0)).alias("_last"))
        shifted = last.join(base, "conv_id", "left").select(
            "conv_id", "_last", F.coalesce("first_index", F.lit(0)).alias("_base")
        )
        closed = sg.segment_conversations(grouped).join(shifted, "conv_id").where(
            F.col("segment_index") < F.col("_last")
        )
        index = F.col("segment_index") + F.col("_base")
        closed.select(
            ids.segment_id(F.col("conv_id"), index).alias("segment_id"),
            "conv_id",
            index.alias("segment_index"),
            "message_ids",
            "conversation_date",
            "segment_text",
        ).write.mode("overwrite").parquet(f"{path}/segments/batch={batch_id}")
        still_open = grouped.join(shifted, "conv_id").where(F.col("segment_index") >= F.col("_last"))
        kept = still_open.select(*columns, (F.col("_last") + F.col("_base")).alias("first_index"))
        untouched = state.join(touched, "conv_id", "left_anti")
        kept.unionByName(untouched).write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")
        _finished(spark, path, batch_id)

    return each


def flush_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, tails) once a stream has ended: open groups become final."""
    emitted = spark.read.parquet(f"{path}/segments").drop("batch")
    state = spark.read.parquet(f"{path}/open/batch={last_batch(spark, path)}")
    numbered = ms.assign_positions(state)
    base = state.groupBy("conv_id").agg(F.max("first_index").alias("_base"))
    final = sg.segment_conversations(numbered).join(base, "conv_id").select(
        ids.segment_id(F.col("conv_id"), F.col("_base") + F.col("segment_index")).alias("segment_id"),
        "conv_id",
        (F.col("_base") + F.col("segment_index")).alias("segment_index"),
        "message_ids",
        "conversation_date",
        "segment_text",
    )
    return emitted.unionByName(final), sg.pending_tails(numbered)


def resegment(segments: DataFrame, messages: DataFrame, late: DataFrame) -> DataFrame:
    """The segment table after late messages: their conversations are cut again.

    ``messages`` holds all messages, the late ones included; conversations without
    late messages keep their rows.
    """
    touched = late.select("conv_id").distinct()
    again = messages.join(touched, "conv_id", "left_semi")
    fresh = sg.segment_conversations(ms.linear_messages(again))
    return tb.force_rerun(segments, fresh, touched)


def job_state_sink(path: str, order: str = "event_id") -> Callable[[DataFrame, int], None]:
    """Latest status per job, and a side output of transitions that are not allowed."""

    def each(batch: DataFrame, batch_id: int) -> None:
        from colloquy.operators.ordered import ordered_scan

        spark = batch.sparkSession
        fields = ["job_id", "status", "at", order]
        events = batch.select(*fields)
        state = _saved(spark, f"{path}/state", batch_id, events.schema)
        chained = ordered_scan(
            events, ["job_id"], order, previous={"_in_batch": F.col("status")}
        ).join(state.select("job_id", F.col("status").alias("_stored")), "job_id", "left")
        before = F.coalesce("_in_batch", "_stored")
        allowed = F.lit(False)
        for status, following in NEXT_STATUSES.items():
            allowed = allowed | (before.eqNullSafe(F.lit(status)) & F.col("status").isin(*following))
        chained.where(~allowed).select(*fields, before.alias("before")).write.mode("overwrite").parquet(
            f"{path}/illegal/batch={batch_id}"
        )
        latest = events.unionByName(state).groupBy("job_id").agg(
            F.max_by(F.struct(*fields[1:]), order).alias("_row")
        )
        latest.select("job_id", "_row.*").write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        _finished(spark, path, batch_id)

    return each


def stuck_jobs(state: DataFrame, now, limit: str = "1 hour") -> DataFrame:
    """Jobs that have been running for longer than ``limit``."""
    return state.where((F.col("status") == "running") & (F.col("at") < now - F.expr(f"interval {limit}")))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """File-source stream of a Parquet table, be it one file or a folder of parts.

    The last letter is written as a pattern: the source takes a plain path for a
    folder only, a pattern for either.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
