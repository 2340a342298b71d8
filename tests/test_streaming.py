"""Streams with their own state: equal to the batch, bounded, and moved by timers."""

import datetime
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from colloquy.operators import messages as ms
from colloquy.operators import segments as sg
from colloquy.session import new_path
from colloquy.streaming import jobs as sj
from colloquy.streaming import stateful as sf

MESSAGES = "conv_id string, message_id string, speaker string, created_at timestamp, ordinal bigint, content string"
START = datetime.datetime(2024, 1, 1)


def conversations(seed, n=25):
    """Random roles, repeated words, gaps in the numbers; minutes apart."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        ordinal = 0
        for _ in range(rng.randint(1, 9)):
            ordinal += rng.randint(1, 3)
            said = rng.choice(["one", "two ", " two", "two\n\nthree"])
            rows.append((f"c{c}", f"c{c}_{ordinal}", rng.choice(["user", "user", "assistant"]), START + datetime.timedelta(minutes=ordinal), ordinal, said))
    return rows


class Feed:
    """A folder of batches and the stream over it."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.source, self.out, self.n = new_path(spark, "source"), new_path(spark, "out"), 0

    def stream(self):
        return sf.part_stream(self.spark, self.source, self.spark.createDataFrame([], self.schema).schema)

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).repartition(2).write.parquet(f"{self.source}/batch={self.n}")
        self.n += 1

    def run(self, rows):
        return sf.run_to_table(rows, f"{self.out}/rows", f"{self.out}/log")

    def rows(self, schema):
        return self.spark.read.schema(schema).parquet(f"{self.out}/rows")


def operator(query):
    """What the stateful operator of the run's batch with rows says of itself."""
    return next(p for p in query.recentProgress if p["numInputRows"])["stateOperators"][0]


def clock(minutes):
    return [(None, None, None, START + datetime.timedelta(minutes=minutes), None, None)]


@pytest.mark.parametrize("batches", [1, 4])
def test_segments_equal_the_batch(spark, batches):
    rows = conversations(batches)
    whole = spark.createDataFrame(rows, MESSAGES)
    linear = ms.linear_messages(whole)
    want = sg.segment_conversations(linear).select("conv_id", "segment_index", "message_ids", "segment_text", "conversation_date")
    tails = sg.pending_tails(linear).select("conv_id", "message_id")
    feed = Feed(spark, MESSAGES)
    stream = sf.segment_stream(feed.stream(), "1 day", idle="1 hour")
    for n in range(batches):
        step = 30 // batches
        feed.put([r for r in rows if n * step <= r[4] and (r[4] < (n + 1) * step or n == batches - 1)])
        feed.run(stream)
    feed.put(clock(10_000))
    feed.run(stream)
    got = feed.rows(sf.SEGMENT_ROWS)
    assert got.where("kind = 'late'").count() == 0
    names = ["conv_id", "segment_index", "message_ids", "segment_text", "conversation_date"]
    assert sorted(map(tuple, sf.latest_segments(got).select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    lone = sf.latest_segments(got, "tail").select("conv_id", F.element_at("message_ids", 1))
    assert sorted(map(tuple, lone.collect())) == sorted(map(tuple, tails.collect()))


def test_state_written_follows_the_batch(spark):
    feed = Feed(spark, MESSAGES)
    stream = sf.segment_stream(feed.stream(), "1 day")
    turn = lambda c, o, who: (f"c{c}", f"c{c}_{o}", who, START + datetime.timedelta(minutes=o), o, f"said {o}")
    feed.put([turn(c, o, w) for c in range(60) for o, w in ((0, "user"), (1, "assistant"))])
    first = operator(feed.run(stream))
    feed.put([turn(0, 2, "user")])
    second = operator(feed.run(stream))
    written = [p["customMetrics"]["rocksdbPutCount"] for p in (first, second)]
    assert written[0] >= 60 and second["numRowsTotal"] >= 60 and written[1] <= written[0] / 10


def test_timer_gives_out_tails_and_takes_them_back(spark):
    feed = Feed(spark, MESSAGES)
    stream = sf.segment_stream(feed.stream(), "1 minute", idle="1 hour", forget="10 days")
    at = lambda m: START + datetime.timedelta(minutes=m)
    feed.put([("c", "m0", "user", at(0), 0, "q"), ("c", "m1", "assistant", at(1), 1, "a"), ("c", "m2", "user", at(2), 2, "more?")])
    feed.run(stream)
    assert feed.rows(sf.SEGMENT_ROWS).count() == 0
    feed.put(clock(120))
    feed.run(stream)
    rows = feed.rows(sf.SEGMENT_ROWS)
    assert [(r["kind"], r["message_ids"]) for r in rows.orderBy("version").collect()] == [("segment", ["m0", "m1", "m2"]), ("tail", ["m2"])]
    # A reply after the timer: the tail becomes a segment, of a higher version.
    feed.put([("c", "m3", "assistant", at(130), 3, "yes"), ("c", "m4", "user", at(131), 4, "thanks")])
    feed.run(stream)
    feed.put(clock(300))
    feed.run(stream)
    rows = feed.rows(sf.SEGMENT_ROWS)
    ids = lambda kind: sorted((r["segment_index"], r["message_ids"]) for r in sf.latest_segments(rows, kind).collect())
    assert ids("segment") == [(0, ["m0", "m1", "m2"]), (1, ["m2", "m3", "m4"])] and ids("tail") == [(2, ["m4"])]
    # Long after that only the place is left: what comes then is late, not lost.
    feed.put(clock(60 * 24 * 30))
    feed.run(stream)
    feed.put([("c", "m5", "assistant", at(60 * 24 * 31), 5, "hello?")])
    feed.run(stream)
    late = feed.rows(sf.SEGMENT_ROWS).where("kind = 'late'")
    assert [r["message_ids"] for r in late.collect()] == [["m5"]]


def test_messages_out_of_order_are_late(spark):
    feed = Feed(spark, MESSAGES)
    stream = sf.segment_stream(feed.stream(), "1 day")
    feed.put([("c", "m5", "user", START, 5, "q"), ("d", "n0", "user", None, 0, "no time")])
    feed.run(stream)
    feed.put([("c", "m3", "user", START, 3, "earlier")])
    feed.run(stream)
    assert [r["message_ids"] for r in feed.rows(sf.SEGMENT_ROWS).where("kind = 'late'").collect()] == [["m3"]]


JOBS = "job_id string, status string, number bigint, at timestamp"


def test_jobs_get_stuck_by_event_time_and_recover(spark):
    feed = Feed(spark, JOBS)
    changes = sf.job_changes(feed.stream(), "1 second", stuck="1 hour")
    at = lambda m: START + datetime.timedelta(minutes=m)
    feed.put([("a", "pending", 1, at(0)), ("a", "running", 2, at(1)), ("b", "running", 1, at(1)), ("c", "pending", 1, at(90))])
    feed.run(changes)
    state = lambda: {r["job_id"]: (r["status"], r["illegal"]) for r in sf.job_states(feed.rows(sf.CHANGE_ROWS)).collect()}
    assert state() == {"a": ("stuck", 0), "b": ("stuck", 1), "c": ("pending", 0)}
    feed.put([("a", "succeeded", 3, at(95)), ("b", "pending", 2, at(96)), ("c", "running", 2, at(97)), ("c", "failed", 3, at(98)), ("a", "running", 2, at(99))])
    feed.run(changes)
    # An event with a number that was seen changes nothing, but is told.
    assert state() == {"a": ("succeeded", 1), "b": ("pending", 2), "c": ("failed", 0)}


def test_jobs_get_stuck_by_processing_time(spark):
    feed = Feed(spark, JOBS)
    changes = sf.job_changes(feed.stream(), None, stuck="1 millisecond")
    feed.put([("a", "pending", 1, START), ("a", "running", 2, START), ("z", "pending", 1, START)])
    query = sf.start_to_table(changes, f"{feed.out}/rows", f"{feed.out}/log", processingTime="200 milliseconds")
    last = {}
    try:
        for _ in range(100):
            time.sleep(0.3)
            if list(pathlib.Path(f"{feed.out}/rows").glob("_spark_metadata/*")):
                last = {r["job_id"]: r["status"] for r in sf.job_states(feed.rows(sf.CHANGE_ROWS)).collect()}
                if last.get("a") == "stuck":
                    break
    finally:
        query.stop()
    assert last == {"a": "stuck", "z": "pending"}


def test_no_message_is_lost_behind_the_watermark(spark):
    feed, keys, delay = Feed(spark, MESSAGES), ["conv_id", "message_id"], "10 minutes"
    at = lambda m: START + datetime.timedelta(minutes=m)
    row = lambda c, m: (f"c{c}", f"c{c}_{m}", "user", at(m), m, "x")
    progress = []

    def drop_repeats():
        stream = sf.part_stream(spark, f"{feed.out}/split/on_time", spark.createDataFrame([], MESSAGES).schema)
        progress.append(feed.run(sf.without_repeats(stream, keys, "created_at", delay)).lastProgress)

    batches = [
        [row(c, m) for c in range(20) for m in (0, 1)] + [row(0, 0)],
        [row(c, m) for c in range(20) for m in (100, 1)],
        [row(1, 91), row(1, 90), row(2, 5), ("c3", "timeless", "user", None, 7, "x"), row(1, 100)],
        [row(4, 300)],
        [row(4, 301), row(2, 5), row(5, 100)],
    ]
    sink = sf.split_late(f"{feed.out}/split", "created_at", delay, drop_repeats)
    for batch in batches:
        feed.put(batch)
        sj.run_available(feed.stream(), sink, f"{feed.out}/split-log")
    rows = feed.rows(MESSAGES).withColumn("arrival", F.col("ordinal"))
    late = spark.read.schema(MESSAGES).parquet(f"{feed.out}/split/late").drop("batch").withColumn("arrival", F.col("ordinal"))
    everything, fresh = sf.reconciled(rows, late, keys, "arrival")
    want = {(r[0], r[1]) for b in batches for r in b}
    got = [(r["conv_id"], r["message_id"]) for r in everything.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # At the edge, as Spark has it: a row of exactly the watermark's time is behind it.
    assert {r["message_id"] for r in fresh.collect()} == {"c2_5", "timeless", "c1_90"}
    # The state holds what the watermark has not passed yet, not all keys that were seen.
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 3


def test_split_repeats_its_batch(spark):
    path = new_path(spark, "split")
    batch = spark.createDataFrame([("c", START)], "conv_id string, at timestamp")
    for _ in range(2):
        sf.split_late(path, "at", "1 minute")(batch, 0)
    assert spark.read.parquet(f"{path}/on_time").count() == 1 and spark.read.parquet(f"{path}/late").count() == 0


