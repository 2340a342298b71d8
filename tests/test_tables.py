"""Unique keys in few rounds, and stored tables that rewrite touched buckets only."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import tables as tb
from colloquy.operators.buckets import BucketTable, Store
from colloquy.session import new_path


def one_by_one(rows, stored=()):
    """(arrival, a, b): what inserting row by row keeps; nulls never clash."""
    taken_a, taken_b, kept = {a for a, _ in stored}, {b for _, b in stored}, []
    for arrival, a, b in sorted(rows):
        if a not in taken_a and b not in taken_b:
            kept.append((a, b))
            taken_a |= {a} - {None}
            taken_b |= {b} - {None}
    return sorted(kept, key=repr)


def inserted(spark, rows, stored=()):
    batch = spark.createDataFrame(rows, "arrival bigint, a int, b int").repartition(4)
    target = spark.createDataFrame(list(stored), "a int, b int")
    return sorted((tuple(r) for r in tb.insert_ignore(target, batch, [["a"], ["b"]]).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_several_keys_equal_row_by_row(spark, seed):
    rng = random.Random(seed)
    size = rng.choice([3, 12, 60])
    some = lambda: None if rng.random() < 0.05 else rng.randint(0, size)
    pairs = [(a, b) for a, b in ((some(), some()) for _ in range(120)) if (a, b) != (None, None)]
    rows = [(i, a or 0, b) if a is None and b is None else (i, a, b) for i, (a, b) in enumerate(pairs)]
    stored = [(1, 2), (size, size)]
    # Null against null in `sorted` cannot occur: arrivals differ.
    assert inserted(spark, rows, stored) == one_by_one(rows, stored)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each row shares a key with the one before it: 10,000 decisions that hang on each other."""
    written = []
    held = tb.durable
    monkeypatch.setattr(tb, "durable", lambda df, name: (written.append(name), held(df, name))[1])
    n = 10_000
    chain = [(i, (i + 1) // 2, i // 2) for i in range(n)]
    assert inserted(spark, chain) == one_by_one(chain)
    assert len(written) <= 20


def test_a_hot_key(spark):
    rows = [(i, 7, i) for i in range(3000)] + [(3000 + i, i + 100, 0) for i in range(500)]
    assert inserted(spark, rows) == one_by_one(rows)


def files(path):
    return {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in pathlib.Path(path.removeprefix("file:")).glob("bucket=*/*.parquet")}


def test_changes_rewrite_touched_buckets_only(spark):
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("value"))
    table = BucketTable(spark, new_path(spark, "table"), rows.schema, "key", 16)
    assert table.read().count() == 0 and table.delete(rows.limit(0)) == []
    table.replace(rows, rows)
    before = files(table.path)
    assert len(before) == 16
    batch = spark.createDataFrame([("k5", -1, 1), ("k5", -2, 2), ("new", 7, 1)], "key string, value bigint, arrival int")
    touched = table.upsert(batch, ["key"])
    after = files(table.path)
    assert 1 <= len(touched) <= 2
    assert {b for b in before if before[b] != after[b]} == {f"bucket={b}" for b in touched}
    got = {r["key"]: r["value"] for r in table.read().collect()}
    assert len(got) == 401 and got["k5"] == -2 and got["new"] == 7 and got["k6"] == 6
    # Deleting all rows of a bucket empties it, and leaves the others alone.
    gone = [r["key"] for r in table.read([touched[0]]).collect()]
    table.delete(spark.createDataFrame([(k,) for k in gone], "key string"))
    last = files(table.path)
    assert table.read([touched[0]]).count() == 0 and table.read().count() == 401 - len(gone)
    assert {b for b in after if after[b] != last[b]} == {f"bucket={touched[0]}"}
    table.insert_ignore(spark.createDataFrame([(gone[0], 1, 2), (gone[0], 0, 1), ("k6" if "k6" not in gone else "k7", 9, 1)], "key string, value bigint, arrival int"), [["key"]])
    assert {r["key"]: r["value"] for r in table.read().collect()}[gone[0]] == 0
    with pytest.raises(ValueError):
        table.insert_ignore(batch, [["value"]])


def test_reads_open_the_touched_folders_only(spark):
    rows = spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"))
    table = BucketTable(spark, new_path(spark, "table"), rows.schema, "key", 8)
    table.replace(rows, rows)
    plan = table.read([3])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]


def test_cascades_in_a_store(spark):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    frames = {
        "extracts": make([("e1",), ("e2",)], "extract_id string"),
        "statements": make([("e1", "s1"), ("e2", "s2")], "extract_id string, statement_id string"),
        "fragments": make([("e1", "f1", "p1", None, None), ("e1", "f2", None, None, None), ("e2", "f3", "p3", None, None)],
                          "extract_id string, fragment_id string, point_id string, embedded_at string, embedding_model string"),
        "links": make([("f1", "s1"), ("f3", "s2")], "fragment_id string, statement_id string"),
        "segments": make([("c", "s_1"), ("c", "s_2"), ("d", "s_3")], "conv_id string, segment_id string"),
        "segment_summaries": make([("s_1", "x"), ("s_3", "y")], "segment_id string, summary string"),
        "topics": make([("c", "t1"), ("d", "t2")], "conv_id string, topic_id string"),
        "topic_segments": make([("t1", "s_1"), ("t2", "s_3")], "topic_id string, segment_id string"),
    }
    store = Store.of(spark, new_path(spark, "store"), frames, 4)
    store.set_embedding(make([("e1", "f2", "p2", "now", "m")], "extract_id string, fragment_id string, point_id string, embedded_at string, embedding_model string"))
    points = store.delete_extracts(make([("e1",), ("none",)], "extract_id string"))
    assert sorted(r[0] for r in points.collect()) == ["p1", "p2"]
    store.delete_segments(make([("c", "s_1")], "conv_id string, segment_id string"))
    store.delete_topics(make([("c",)], "conv_id string"))
    left = {name: sorted(tuple(r)[1] if len(r) > 1 else r[0] for r in table.read().collect()) for name, table in store.tables.items()}
    assert left == {
        "extracts": ["e2"], "statements": ["s2"], "fragments": ["f3"], "links": ["s2"],
        "segments": ["s_2", "s_3"], "segment_summaries": ["y"], "topics": ["t2"], "topic_segments": ["s_3"],
    }


def test_hydration_joins_hits_only(spark):
    from colloquy.operators import retrieval as rt

    n = 200
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {
        "fragments": make([(f"f{i}", f"e{i}", 0, "t", "r", "ok") for i in range(n)], "fragment_id string, extract_id string, fragment_index bigint, title string, retrieval_text string, status string"),
        "links": make([(f"f{i}", f"s{i}_{k}", k) for i in range(n) for k in (1, 0)], "fragment_id string, statement_id string, position_in_fragment bigint"),
        "statements": make([(f"s{i}_{k}", k, "user", f"said {k}") for i in range(n) for k in (0, 1)], "statement_id string, statement_index bigint, speaker string, text string"),
        "extracts": make([(f"e{i}", f"g{i}", None, "ok", "p", "m") for i in range(n)], "extract_id string, segment_id string, created_at timestamp, status string, provider string, model string"),
        "segments": make([(f"g{i}", f"c{i % 5}", i, f"text {i}", None, 0, 1) for i in range(n)], "segment_id string, conv_id string, segment_index bigint, segment_text string, conversation_date timestamp, start_position bigint, end_position bigint"),
        "conversations": make([(f"c{i}", "T", "x") for i in range(5)], "conv_id string, title string, source_platform string"),
    }
    wanted = make([("f3",), ("f8",), ("absent",)], "fragment_id string")
    hit = rt.reduced_tables(wanted, tables)
    assert {name: df.count() for name, df in hit.items()} == {"fragments": 2, "links": 4, "extracts": 2, "segments": 2, "statements": 4, "conversations": 1}
    # The cut of the texts is a broadcast of written keys: the table itself is not shuffled.
    plan = tables["segments"].join(hit["extracts"].select("segment_id").distinct(), "segment_id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    asked = make([("q", "f8", 1), ("q", "f3", 2), ("r", "f8", 1), ("r", "absent", 2)], "query_id string, fragment_id string, rank int")
    rows = rt.hydrate_fragments(asked, tables).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["fragment_id"], r["segment_text"], [s["text"] for s in r["statements"]]) for r in rows] == [
        ("q", "f8", "text 8", ["said 0", "said 1"]), ("q", "f3", "text 3", ["said 0", "said 1"]), ("r", "f8", "text 8", ["said 0", "said 1"]),
    ]
