"""Streams that keep their own state: segments, the job machine, de-duplicated messages.

The state of a key lives in the state store of the query, of which Spark saves what a
batch has changed. So the work of a batch grows with the batch, not with what was seen
before it. Event-time timers fire once the watermark has passed them, processing-time
timers when that much time has gone by, also while nothing arrives.

A stateful operator drops rows behind its watermark. ``split_late`` stands before one: it
keeps the same watermark in a table of its own and puts such rows aside, for
``jobs.resegment``, so that none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from colloquy.functions import text
from colloquy.operators.tables import insert_ignore
from colloquy.session import durable
from colloquy.streaming.jobs import NEXT_STATUSES

#: A stretch of time without messages after which open groups are given out.
IDLE = "1 hour"
#: After this long without messages a conversation's open groups are forgotten.
FORGET = "30 days"
#: A job that has been running for longer is stuck.
STUCK = "1 hour"


def stateful(spark: SparkSession) -> SparkSession:
    """The session with a state store that ``transformWithState`` can use, whose
    checkpoints hold changes."""
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def run_to_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to the Parquet table ``path``, each row once, and stop.

    With processing-time timers there is always a next batch, so such a stream never stops
    by itself: ``start_to_table`` runs it.
    """
    query = start_to_table(rows, path, checkpoint, availableNow=True)
    query.awaitTermination()
    return query


def start_to_table(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The running query that appends to the Parquet table ``path``."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**trigger).start()


def _millis(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


# Segments


class SegmentMachine(StatefulProcessor):
    """Cuts one conversation into segments as its messages come in.

    State: the closed group that still waits for its overlap (``waiting``), the open group
    (``open``), and a small value with the index of the open group, the last ordinal seen
    and the number of rows given out. A user message is settled when a reply or a user
    message of other words follows it; until then a retry may take its place.

    A group that waited ``idle`` is given out as it is, a lone user message as a tail. If
    the conversation goes on after that, the segment comes again with a higher version.
    After ``forget`` only the small value is left; a message that comes later still, or
    out of order, is handed on as ``late``, for the conversation to be cut anew.
    """

    def __init__(self, idle: str = IDLE, forget: str = FORGET):
        self.idle, self.forget = _millis(idle), _millis(forget)

    def init(self, handle: StatefulProcessorHandle) -> None:
        row = "message_id string, speaker string, created_at timestamp, ordinal bigint, content string, words string"
        self.handle = handle
        self.waiting = handle.getListState("waiting", row)
        self.open = handle.getListState("open", row)
        self.place = handle.getValueState("place", "next bigint, last bigint, given bigint, heard bigint, forgotten boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        if key[0] is None:
            return
        index, last, given, heard, forgotten = self.place.get() if self.place.exists() else (0, None, 0, None, False)
        waiting, opened = list(self.waiting.get()), list(self.open.get())
        old_timers, out = [heard + self.idle, heard + self.forget] if heard is not None else [], []
        batch = pd.concat(list(rows)).sort_values(["ordinal", "message_id"])
        newest = batch["created_at"].max()
        for m in batch[["message_id", "speaker", "created_at", "ordinal", "content", "words"]].itertuples(index=False, name=None):
            m = tuple(None if pd.isna(v) else v for v in m)
            if forgotten or (last is not None and m[3] <= last):
                out.append(("late", None, [m], given))
                continue
            last = m[3]
            if m[1] != "user":
                # The reply settles the user message that opened this group.
                if waiting and opened:
                    out.append(("segment", index - 1, waiting + opened[:1], given))
                    given, waiting = given + 1, []
                opened.append(m)
            elif len(opened) == 1 and opened[0][1] == "user" and opened[0][5] == m[5]:
                opened = [m]
            else:
                if opened:
                    if waiting:
                        out.append(("segment", index - 1, waiting + opened[:1], given))
                        given, waiting = given + 1, []
                    if opened[0][1] == "user" and len(opened) > 1:
                        waiting = opened
                    else:
                        out.append(("segment", index, opened, given))
                        given += 1
                    index += 1
                opened = [m]
        if not forgotten:
            if pd.notna(newest):
                now = int(pd.Timestamp(newest).timestamp() * 1000)
                if heard is None or now > heard:
                    for at in old_timers:
                        self.handle.deleteTimer(at)
                    heard = now
                    self.handle.registerTimer(heard + self.idle)
                    self.handle.registerTimer(heard + self.forget)
            self._put(self.waiting, waiting)
            self._put(self.open, opened)
            self.place.update((index, last, given, heard, False))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        index, last, given, heard, forgotten = self.place.get()
        if heard is not None and expiredTimerInfo.getExpiryTimeInMs() == heard + self.forget:
            self.waiting.clear()
            self.open.clear()
            self.place.update((index, last, given, heard, True))
            return
        waiting, opened, out = list(self.waiting.get()), list(self.open.get()), []
        if waiting:
            out.append(("segment", index - 1, waiting + opened[:1], given))
            given += 1
        if opened:
            alone = opened[0][1] == "user" and len(opened) == 1
            out.append(("tail" if alone else "segment", index, opened, given))
            given += 1
        self.place.update((index, last, given, heard, forgotten))
        if out:
            yield self._rows(key, out)

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        said = lambda m: f"{m[1]}: {(m[4] or '').strip()}"
        return pd.DataFrame(
            {
                "conv_id": [key[0]] * len(out),
                "kind": [kind for kind, *_ in out],
                "segment_index": pd.array([i for _, i, *_ in out], dtype="Int64"),
                "message_ids": pd.Series([[m[0] for m in rows] for _, _, rows, _ in out], dtype=object),
                "conversation_date": pd.to_datetime(pd.Series([rows[0][2] for _, _, rows, _ in out], dtype=object)),
                "segment_text": ["\n\n".join(map(said, rows)) for _, _, rows, _ in out],
                "version": pd.array([v for *_, v in out], dtype="Int64"),
            }
        )


SEGMENT_ROWS = (
    "conv_id string, kind string, segment_index bigint, message_ids array<string>, "
    "conversation_date timestamp, segment_text string, version bigint"
)


def segment_stream(messages: DataFrame, delay: str, idle: str = IDLE, forget: str = FORGET) -> DataFrame:
    """Segments, tails and late messages of a stream of visible messages.

    ``delay`` is the watermark's on ``created_at``. A row without a conversation only
    moves the watermark, so it can end a stream; one without a time moves nothing.
    """
    stateful(messages.sparkSession)
    words = F.when(F.col("speaker") == "user", F.sha2(text.squeeze(F.col("content")), 256))
    rows = messages.select("conv_id", "message_id", "speaker", "created_at", "ordinal", "content", words.alias("words"))
    return (
        rows.withWatermark("created_at", delay)
        .groupBy("conv_id")
        .transformWithStateInPandas(SegmentMachine(idle, forget), SEGMENT_ROWS, "Append", "EventTime")
    )


def latest_segments(rows: DataFrame, kind: str = "segment") -> DataFrame:
    """The last version of each segment (or tail) that a ``segment_stream`` gave out.

    A tail is one only as long as no version of a segment with its index is newer.
    """
    newest = rows.where("kind <> 'late'").groupBy("conv_id", "segment_index").agg(
        F.max_by(F.struct("kind", "message_ids", "conversation_date", "segment_text"), "version").alias("_row")
    )
    return newest.select("conv_id", "segment_index", "_row.*").where(F.col("kind") == kind).drop("kind")


# The job machine


class JobMachine(StatefulProcessor):
    """Follows each job through its states and marks it stuck if it runs too long.

    State: the job's status, when it came and its number. Every event gives a change,
    with the status before it and whether that may follow. A running job has a timer;
    what comes before the timer fires takes it away. Events that are older than the
    job's last one are changes of no effect. The same state machine serves both kinds
    of time; ``processing`` counts from when the event is handled.
    """

    def __init__(self, stuck: str = STUCK, processing: bool = False):
        self.stuck, self.processing = _millis(stuck), processing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, number bigint, at timestamp, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        status, number, at, timer = self.now.get() if self.now.exists() else (None, None, None, None)
        before_batch, out = timer, []
        for event in pd.concat(list(rows)).sort_values("number")[["status", "number", "at"]].itertuples(index=False, name=None):
            if number is not None and event[1] <= number:
                out.append((*event, status, False))
                continue
            known = None if status == "stuck" else status
            # A stuck job may still end: it was running all the time.
            legal = event[0] in NEXT_STATUSES.get("running" if status == "stuck" else known, ())
            out.append((*event, status, legal))
            status, number, at = event
            timer = None
            if status == "running":
                start = timerValues.getCurrentProcessingTimeInMs() if self.processing else int(pd.Timestamp(at).timestamp() * 1000)
                timer = start + self.stuck
        if timer != before_batch:
            if before_batch is not None:
                self.handle.deleteTimer(before_batch)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.now.update((status, number, at, timer))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        status, number, at, timer = self.now.get()
        if status != "running" or timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.now.update(("stuck", number, at, None))
        yield self._rows(key, [("stuck", number, at, status, True)])

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        columns = ["status", "number", "at", "before", "legal"]
        rows = pd.DataFrame(out, columns=columns).astype({"legal": bool})
        rows.insert(0, "job_id", key[0])
        return rows


CHANGE_ROWS = "job_id string, status string, number bigint, at timestamp, before string, legal boolean"


def job_changes(events: DataFrame, delay: str | None, stuck: str = STUCK) -> DataFrame:
    """Changes of all jobs, from events (job_id, status, number, at).

    With a ``delay``, jobs get stuck by event time, behind the watermark on ``at``;
    without one by processing time.
    """
    stateful(events.sparkSession)
    rows = events.select("job_id", "status", F.col("number").cast("bigint"), "at")
    timed = rows if delay is None else rows.withWatermark("at", delay)
    machine = JobMachine(stuck, processing=delay is None)
    return timed.groupBy("job_id").transformWithStateInPandas(
        machine, CHANGE_ROWS, "Append", "ProcessingTime" if delay is None else "EventTime"
    )


def job_states(changes: DataFrame) -> DataFrame:
    """The current state of every job, and how many of its changes were not allowed.

    Of rows with one number the stuck mark is the later one; a row of no effect has a
    number that is not the highest of its job.
    """
    order = F.struct("number", F.col("status") == "stuck")
    return changes.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"), F.count_if(~F.col("legal")).alias("illegal")
    )


# Messages de-duplicated inside the watermark, and what lies behind it


def split_late(
    path: str, time: str, delay: str, then: Callable[[], object] | None = None
) -> Callable[[DataFrame, int], None]:
    """A sink that deals rows into ``on_time`` and ``late`` by its own watermark.

    The watermark of a batch is what the batches before it had seen, less ``delay``, as
    Spark's own. Rows without a time are late, too. Each batch has folders of its own,
    so a batch that is run again replaces what it wrote. ``then`` runs the operators
    behind it after each batch: they see the same batches, so their watermark is never
    ahead of this one and drops nothing.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.createDataFrame([], "batch bigint, newest timestamp")
        if batch_id > 0:
            seen = spark.read.schema("newest timestamp, batch bigint").parquet(f"{path}/seen").where(F.col("batch") < batch_id)
        mark = seen.agg((F.max("newest") - F.expr(f"interval {delay}")).alias("m")).first()["m"]
        kept = durable(batch, "split")
        behind = F.col(time).isNull() if mark is None else F.coalesce(F.col(time) <= F.lit(mark), F.lit(True))
        kept.where(behind).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        kept.where(~behind).write.mode("overwrite").parquet(f"{path}/on_time/batch={batch_id}")
        newest = kept.where(~behind).agg(F.max(time).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
        if then is not None:
            then()

    return each


def part_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """File stream over the batch folders that ``split_late`` writes."""
    return spark.readStream.schema(schema).parquet(f"{path}/batch=*")


def without_repeats(messages: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once, as long as its copies come within the watermark; keys are forgotten
    when the watermark has passed them."""
    stateful(messages.sparkSession)
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def once_ever(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, for as long as the stream runs: the idempotent insert as a stream.

    The keys that were seen lie in the state store, of which a batch reads and writes its
    own: its work does not grow with what is stored. The first row of a key wins; of rows
    with one key in one batch any may be it. Nothing is ever too late, or forgotten.
    """
    stateful(rows.sparkSession)
    return rows.dropDuplicates(keys)


def reconciled(rows: DataFrame, late: DataFrame, keys: list[str], arrival: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, new late rows): what was put aside joins the rows unless known.

    The new late rows are what ``jobs.resegment`` takes.
    """
    known = rows.select(*late.columns)
    fresh = durable(insert_ignore(known.drop(arrival), late, [keys], arrival), "late")
    return known.drop(arrival).unionByName(fresh), fresh
