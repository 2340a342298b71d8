"""Topics, retrieval, tables, jobs and streams."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.functions import vectors as vx
from colloquy.operators import reports as rp
from colloquy.operators import retrieval as rt
from colloquy.operators import tables as tb
from colloquy.operators import topics as tp
from colloquy.plans import catalog
from colloquy.sources import files as fl
from colloquy.streaming import jobs as sj

VECTOR = "conv_id string, segment_id string, segment_index bigint, vector array<double>"


def topic_rows(spark, conversations):
    return spark.createDataFrame(
        [(c, f"{c}_s{i:03d}", i, [float(x) for x in v]) for c, vs in conversations.items() for i, v in enumerate(vs)], VECTOR
    )


def test_topics(spark):
    a, b, zero = [1, 0], [0, 1], [0, 0]
    rows = topic_rows(spark, {"one": [a] * 4, "two": [a, a, b, b], "three": [a, a, b, b, a], "single": [a], "zero": [a, zero]})
    bounded = tp.topic_boundaries(rows)
    report = {r.conv_id: r for r in tp.similarity_report(bounded).collect()}
    assert {c: r.topics for c, r in report.items()} == {"one": 1, "two": 2, "three": 3, "single": 1, "zero": 2}
    assert report["single"].pairs == 0 and report["single"].mean_similarity is None and report["one"].pairs == 3
    plan = {r.topic_id: (r.segment_range, r.segment_count) for r in tp.topic_plan(bounded).collect()}
    assert plan["three_t001"] == ("three_s002-three_s003", 2)
    members = {(r.topic_id, r.segment_id): r.position for r in tp.topic_segments(bounded).collect()}
    assert members["two_t001", "two_s003"] == 1 and members["one_t000", "one_s003"] == 3
    labels = [r.label for r in tp.boundary_labels(bounded).where("conv_id = 'two'").collect()]
    assert labels == ["after two_s001 (0.00)"]


def test_cosine(spark):
    pairs = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])]
    got = spark.createDataFrame(pairs, "a array<double>, b array<double>").select(vx.cosine(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 12) for r in got] == [1.0, 0.0, 0.0]


def vectors(spark, matrix, key, prefix):
    rows = [(f"{prefix}{i:04d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} string, vector array<float>")


@pytest.mark.parametrize("local_bytes", [100 * 64, 3 * 64])
def test_search_is_exact_with_many_copies(spark, local_bytes):
    rng = np.random.default_rng(1)
    items = np.round(rng.normal(size=(300, 8)), 3).astype(np.float32)
    items[100:200] = items[0]
    queries = np.vstack([items[0:1], rng.normal(size=(9, 8))]).astype(np.float32)
    got = rt.search(
        vectors(spark, queries, "query_id", "q"), vectors(spark, items, "item_id", "v").repartition(5), 7, local_bytes
    ).collect()
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    scores = np.round(unit(queries) @ unit(items).T, 9)
    for q in range(10):
        want = sorted(range(300), key=lambda i: (-scores[q, i], i))[:7]
        mine = sorted((r for r in got if r.query_id == f"q{q:04d}"), key=lambda r: r["rank"])
        assert [r.item_id for r in mine] == [f"v{i:04d}" for i in want]


def test_search_is_spread_by_its_pairs(spark, monkeypatch):
    """Vectors in one small file are scored by several tasks, with the same hits."""
    rng = np.random.default_rng(2)
    items = vectors(spark, rng.normal(size=(200, 8)), "item_id", "v").coalesce(1)
    queries, parts = vectors(spark, rng.normal(size=(10, 8)), "query_id", "q"), []
    near = rt._near

    def counted(*args):
        found = near(*args)
        parts.append(found.rdd.getNumPartitions())
        return found

    monkeypatch.setattr(rt, "_near", counted)
    alone = sorted(rt.search(queries, items).collect())
    monkeypatch.setattr(rt, "PAIRS_PER_TASK", 400)
    assert sorted(rt.search(queries, items).collect()) == alone and parts == [1, 5]


def test_search_scores_few_pairs_in_double_precision(monkeypatch):
    """Scores closer than single precision tells apart, and equal ones, are ranked as by brute force."""
    rng = np.random.default_rng(3)
    items = rng.normal(size=(3000, 16))
    items[1000:1500] = items[7] + rng.normal(size=(500, 16)) * 1e-8
    items[2000:2300] = items[7]
    ids = [f"v{i:04d}" for i in rng.permutation(3000)]
    queries = np.vstack([items[7], rng.normal(size=(599, 16)), np.zeros(16)])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    asked, stored, scored = unit(queries), unit(items), []
    batches = pa.table({"item_id": ids, "vector": pa.array(list(items), pa.list_(pa.float64()))}).to_batches(max_chunksize=700)
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: scored.append(len(a)) or einsum(how, a, b))
    got = rt._top_k([f"q{i}" for i in range(601)], asked, iter(batches), 5).to_pylist()
    assert 0 < sum(scored) < 0.1 * 601 * 3000
    exact = np.round(einsum("qd,id->qi", asked, stored), 9) + 0.0
    for q in range(601):
        want = sorted(zip(-exact[q], ids))[:5]
        mine = sorted((-r["score"], r["item_id"]) for r in got if r["query_id"] == f"q{q}")
        assert [i for _, i in mine] == [i for _, i in want] and np.allclose([s for s, _ in mine], [s for s, _ in want])


def test_search_makes_its_queries_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embedded(n):
        made.add(1)
        return [float(n == d) for d in range(4)]

    queries = spark.range(4).select(F.concat(F.lit("q"), "id").alias("query_id"), embedded("id").alias("vector"))
    for local_bytes in (1 << 20, 2 * 32):
        made.value = 0
        assert rt.search(queries, vectors(spark, np.eye(4), "item_id", "v"), 1, local_bytes).count() == 4
        assert made.value == 4


def test_fragments_of_hits_are_read_from_the_index(spark, tmp_path, monkeypatch):
    """What is found is not put together again from all statements."""
    turns = [(c, t, ("user", "assistant")[t % 2], f"Word{c} and word{t}. Some more of word{c}!") for c in range(6) for t in range(3)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hydrate, plans = rt.hydrate_fragments, []

    def seen(requests, tables):
        plans.append(tables["fragments"]._jdf.queryExecution().executedPlan().toString())
        return hydrate(requests, tables)

    monkeypatch.setattr(rt, "hydrate_fragments", seen)
    rows = {n: {r.query_id for r in catalog.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("context_block", "snippet", "answer")}
    assert all(found == {f"c{c}_m0002" for c in range(6)} for found in rows.values())
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)


def test_search_edges(spark):
    good = vectors(spark, np.eye(3), "query_id", "q")
    none = good.limit(0)
    assert rt.search(none, vectors(spark, np.eye(3), "item_id", "v")).count() == 0
    assert rt.search(good, vectors(spark, np.eye(3), "item_id", "v").limit(0)).count() == 0
    holes = vectors(spark, np.eye(3), "item_id", "v").union(spark.createDataFrame([(None, [1.0, 0.0, 0.0])], "item_id string, vector array<float>"))
    assert rt.search(good, holes, 10).count() == 9
    with pytest.raises(Exception, match="vector size mismatch"):
        rt.search(good, vectors(spark, np.eye(4), "item_id", "v")).collect()


def test_approximate_search_finds_most(spark):
    rng = np.random.default_rng(2)
    items, queries = rng.normal(size=(400, 6)), rng.normal(size=(8, 6))
    q, v = vectors(spark, queries, "query_id", "q"), vectors(spark, items, "item_id", "v")
    row = rt.recall(rt.search_approx(q, v, 5), rt.search(q, v, 5)).first()
    assert row.exact_hits == 40 and row.recall > 0.6


def test_cutoff(spark):
    hits = spark.createDataFrame([("q", i + 1, s) for i, s in enumerate([0.9, 0.8, 0.3, 0.1])], "query_id string, rank int, score double")
    assert [r["rank"] for r in rt.hybrid_cutoff(hits).orderBy("rank").collect()] == [1, 2, 3]
    assert rt.hybrid_cutoff(hits, 0, 0.95).count() == 0


def knowledge(spark):
    return {
        "conversations": spark.sql("select 'c' conv_id, 'Talk' title, 'chatgpt' source_platform"),
        "segments": spark.sql("select 's' segment_id, 'c' conv_id, 0L segment_index, 'text' segment_text, timestamp'2024-01-02 03:04:05' conversation_date, 0L start_position, 2L end_position"),
        "extracts": spark.sql("select 's_x' extract_id, 's' segment_id, timestamp'2024-01-01' created_at, 'ok' status, 'local' provider, 'm' model"),
        "statements": spark.sql("select * from values ('st0', 0L, 'user', 'Hi.'), ('st1', 1L, 'assistant', 'Yo.') as t(statement_id, statement_index, speaker, text)"),
        "fragments": spark.sql("select * from values ('f0', 's_x', 0L, 'Greeting', 'body', 'ok'), ('f1', 's_x', 1L, null, 'bare body', 'ok') as t(fragment_id, extract_id, fragment_index, title, retrieval_text, status)"),
        "links": spark.sql("select * from values ('f0', 'st1', 1L), ('f0', 'st0', 0L) as t(fragment_id, statement_id, position_in_fragment)"),
    }


def test_hydration_context_and_citations(spark):
    asked = spark.createDataFrame([("q", 1, "f1"), ("q", 2, "nope"), ("q", 3, "f0"), ("r", 1, "f0")], "query_id string, rank int, fragment_id string")
    hydrated = rt.hydrate_fragments(asked, knowledge(spark))
    rows = {(r.query_id, r["rank"]): r for r in hydrated.collect()}
    assert set(rows) == {("q", 1), ("q", 3), ("r", 1)}
    assert rows["q", 1].statements == [] and [s.text for s in rows["q", 3].statements] == ["Hi.", "Yo."]
    blocks = {r.query_id: r.context_block for r in rt.context_blocks(hydrated).collect()}
    assert blocks["q"] == (
        "--- Excerpt 1 (segment: s, date: 2024-01-02T03:04:05Z) ---\nbare body\n\n"
        "--- Excerpt 2 (segment: s, date: 2024-01-02T03:04:05Z) ---\nTopic: Greeting\nuser: Hi.\nassistant: Yo."
    )
    cited = sorted((r.query_id, r["rank"], r.fragment_id, r.title) for r in rt.citations(hydrated).collect())
    assert cited == [("q", 1, "f1", ""), ("q", 2, "f0", "Greeting"), ("r", 1, "f0", "Greeting")]
    assert rt.hydrate_fragments(asked.limit(0), knowledge(spark)).count() == 0

    questions = spark.createDataFrame([("q", "why?"), ("z", "none")], "query_id string, text string")
    answers = rt.answer_with_model(questions, hydrated, lambda: (lambda p: f"thoughts\n## Answer\n {p[:4]} "), "{question}|{context_block}|{user_context}")
    assert {r.query_id: r.answer for r in answers.collect()} == {"q": "why?", "z": ""}


def test_insert_ignore_is_idempotent_and_greedy(spark):
    schema = "a string, b string, v string, arrival int"
    batch = spark.createDataFrame(
        [("1", "x", "p", 1), ("1", "y", "q", 2), ("2", "y", "r", 3), ("3", "x", "s", 4), ("4", "k", "t", 5), ("9", "z", "u", 6)], schema
    )
    target = spark.createDataFrame([("9", "w", "old")], "a string, b string, v string")
    new = tb.insert_ignore(target, batch, [["a"], ["b"]])
    assert sorted(r.v for r in new.collect()) == ["p", "r", "t"]
    full = target.unionByName(new)
    assert tb.insert_ignore(full, batch, [["a"], ["b"]]).count() == 0
    assert tb.insert_ignore(full, batch, [["a"]]).count() == 1
    assert {(r.a, r.v) for r in tb.upsert(full, batch, ["a"]).collect()} == {("1", "q"), ("2", "r"), ("3", "s"), ("4", "t"), ("9", "u")}


@pytest.mark.parametrize("bad", [(-1, None), (3, 2), (True, 4), (0, 1.5)])
def test_segment_ranges_are_checked(bad):
    with pytest.raises(ValueError):
        tb.in_range(F.lit(1), *bad)


def test_stage_round_trip_pushes_the_range_down(spark, tmp_path):
    path = str(tmp_path / "stage")
    rows = spark.range(10).select(F.lit("c").alias("conv_id"), F.col("id").alias("segment_index"), F.lit(fl.SEGMENT_SUMMARY_KIND).alias("source_kind"))
    fl.write_stage(rows, path)
    stage = fl.read_stage(spark, path, first=3, last=5, kind=fl.SEGMENT_SUMMARY_KIND)
    assert [r.segment_index for r in stage.orderBy("segment_index").collect()] == [3, 4, 5]
    plan = stage._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(segment_index,3)" in plan
    fl.write_readable(spark.createDataFrame([("# One",), ("# Two",)], "report string"), str(tmp_path / "text"))
    tb.replace_table(spark.read.parquet(path).where("segment_index > 7"), path)
    assert spark.read.parquet(path).count() == 2


def test_job_state_and_results(spark):
    at = "timestamp_ntz'2024-01-01 00:00:0{}'"
    events = spark.sql(
        "select * from values "
        + ", ".join(
            f"('{job}', '{status}', {at.format(second)}, {second}L, {result}, {error})"
            for job, status, second, result, error in [
                ("a", "pending", 0, "null", "null"), ("a", "running", 1, "null", "null"), ("a", "succeeded", 4, "'{\"n\": 3}'", "null"),
                ("b", "pending", 0, "null", "null"), ("b", "running", 2, "null", "null"), ("c", "failed", 5, "null", "'boom'"),
            ]
        )
        + " as t(job_id, status, at, event_id, result, error)"
    )
    state = {r.job_id: r for r in rp.job_state(events).drop("result_json").collect()}
    assert (state["a"].status, state["a"].duration_s, state["a"].result) == ("succeeded", 3.0, '{"n": 3}')
    assert (state["b"].status, state["b"].finished_at, state["c"].error) == ("running", None, "boom")
    stuck = sj.stuck_jobs(rp.job_state(events).withColumn("at", F.col("started_at")), F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"))
    assert [r.job_id for r in stuck.collect()] == ["b"]
    ids = spark.range(205).select(F.lit("j").alias("job_id"), F.format_string("%04d", "id").alias("x"))
    row = rp.job_result(ids, "job_id", "x").first()
    assert (len(row.ids), row.total, row.truncated, row.ids[-1]) == (200, 205, True, "0199")


def test_stream_over_several_batches_equals_one_pass(spark, tmp_path):
    """Turns arrive in three files; an open group waits for its next message."""
    schema = "conv_id string, message_id string, speaker string, created_at timestamp, ordinal bigint, content string"
    patterns = {"c1": "uaauau", "c2": "auu", "c3": "uuua", "c4": "u", "c5": "uaua"}
    rows = [(c, f"{c}_{i}", "user" if r == "u" else "assistant", None, i, f"{r}{i}") for c, p in patterns.items() for i, r in enumerate(p)]
    source = tmp_path / "in"
    for n, cut in enumerate([(0, 2), (2, 3), (3, 9)]):
        part = [r for r in rows if cut[0] <= r[4] < cut[1]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = str(tmp_path / "out")
    query = sj.run_available(stream, sj.segment_sink(out), f"{out}/log")
    assert query.lastProgress["batchId"] == sj.last_batch(spark, out) == 2
    segments, tails = sj.flush_segments(spark, out)
    from colloquy.operators import messages as ms
    from colloquy.operators import segments as sg

    whole = ms.assign_positions(spark.createDataFrame(rows, schema))
    flat = lambda df: sorted((r.segment_id, tuple(r.message_ids), r.segment_text) for r in df.collect())
    assert not sj.run_available(stream, sj.segment_sink(out), f"{out}/log").lastProgress["numInputRows"]
    assert sj.last_batch(spark, out) == 2
    assert flat(segments) == flat(sg.segment_conversations(whole))
    assert sorted(r.message_id for r in tails.collect()) == sorted(r.message_id for r in sg.pending_tails(whole).collect())


def test_retry_in_a_later_batch_changes_the_overlap(spark, tmp_path):
    schema = "conv_id string, message_id string, speaker string, created_at timestamp, ordinal bigint, content string"
    rows = [
        ("c", f"m{i}", s, None, i, t)
        for i, (s, t) in enumerate([("user", "a"), ("assistant", "b"), ("user", "c  d"), ("user", "c d"), ("assistant", "e"), ("user", "f"), ("user", "g")])
    ]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for cut in ((0, 3), (3, 5), (5, 6), (6, 7)):
        spark.createDataFrame(rows[cut[0] : cut[1]], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    sj.run_available(stream, sj.segment_sink(out), f"{out}/log")
    segments, tails = sj.flush_segments(spark, out)
    from colloquy.operators import messages as ms
    from colloquy.operators import segments as sg

    whole = ms.linear_messages(spark.createDataFrame(rows, schema))
    flat = lambda df: sorted((r.segment_id, tuple(r.message_ids)) for r in df.collect())
    assert flat(segments) == flat(sg.segment_conversations(whole))
    assert flat(segments)[0] == ("c_s000", ("m0", "m1", "m3"))
    assert [r.message_id for r in tails.collect()] == [r.message_id for r in sg.pending_tails(whole).collect()]


def test_late_messages_are_kept_and_told(spark, tmp_path):
    """Three files, the newest message first: nothing is lost, late rows come out too."""
    from datetime import datetime

    schema = "conv_id string, message_id string, created_at timestamp, arrival bigint"
    rows = [("c", "m9", datetime(2024, 1, 20), 0), ("c", "m1", datetime(2024, 1, 1), 1), ("d", "m2", datetime(2024, 1, 20, 1), 2), ("c", "m9", datetime(2024, 1, 20), 3)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    sj.run_available(stream, sj.insert_ignore_sink(out, ["conv_id", "message_id"], "arrival", late=("conv_id", "created_at")), f"{out}/log")
    assert sorted(r.message_id for r in sj.stored_rows(spark, out).collect()) == ["m1", "m2", "m9"]
    assert [r.message_id for r in sj.late_rows(spark, out).collect()] == ["m1"]


def test_keys_and_references(spark):
    t = knowledge(spark)
    stored = {
        "conversations": t["conversations"], "segments": t["segments"].union(t["segments"]), "extracts": t["extracts"].limit(0),
        "fragments": t["fragments"],
    }
    fk = {(r.table, r.column, r.value, r.rows) for r in tb.fk_violations({**stored, "conversations": t["conversations"].selectExpr("*", "'x' raw_source_file_id", "'y' normalized_source_file_id"), "extracts": stored["extracts"].withColumn("conv_id", F.lit("c"))}).collect()}
    assert fk == {("fragments", "extract_id", "s_x", 2)}
    unique = {(r.table, r.rule, r.rows) for r in tb.unique_violations({"segments": stored["segments"]}).collect()}
    assert unique == {("segments", "segment_id", 2), ("segments", "conv_id,segment_index", 2)}
