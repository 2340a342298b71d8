"""Model stages as whole runs, with stub models: batches, the log, whole rows, resume."""

import json
import pathlib
import time

from pyspark.sql import functions as F

from colloquy.operators import model_runs as mr
from colloquy.operators.buckets import Store
from colloquy.session import new_path

STATEMENT = "extract_id string, segment_id string, conv_id string, statement_index bigint, speaker string, text string, statement_id string"


def prompts(spark, rows):
    return spark.createDataFrame(rows, "id string, prompt string").coalesce(1)


def test_calls_are_batched_by_tokens_and_fall_back(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def factory():
        def model(asked):
            with open(seen, "a") as f:
                f.write(f"{len(asked)}\n")
            if any(p == "bad" for p in asked):
                raise RuntimeError("no")
            if "slow" in asked:
                time.sleep(3)
            return [p.upper() for p in asked][: 1 if "short" in asked and len(asked) > 1 else None]

        return model

    rows = [(str(i), "x" * 36) for i in range(10)]
    got = mr.run_text_batches(prompts(spark, rows), factory, tokens=40).collect()
    assert {r["raw"] for r in got} == {"X" * 36} and len(got) == 10
    assert pathlib.Path(seen).read_text().split() == ["4", "4", "2"]
    odd = [("a", "fine"), ("b", "bad"), ("c", "short"), ("d", None), ("e", "y" * 9000)]
    got = {r["id"]: (r["raw"], r["error"]) for r in mr.run_text_batches(prompts(spark, odd), factory, tokens=40).collect()}
    assert got == {"a": ("FINE", None), "b": (None, "RuntimeError: no"), "c": ("SHORT", None), "e": ("Y" * 9000, None)}
    late = mr.run_text_batches(prompts(spark, [("s", "slow"), ("t", "fine")]), factory, seconds=0.5).collect()
    errors = {r["id"]: r["error"] for r in late}
    assert errors["s"].startswith("TimeoutError") and errors["t"] is None


def failing_once(folder):
    """Answers nothing readable the first time it sees a prompt."""

    def factory():
        import hashlib

        def one(prompt):
            mark = pathlib.Path(folder) / hashlib.md5(prompt.encode()).hexdigest()
            with open(mark, "a") as f:
                f.write("x")
            return "{nope" if mark.read_text() == "x" else grouped(prompt)

        return lambda asked: [one(p) for p in asked]

    return factory


def grouped(prompt):
    """Pairs of lines as fragments, without indices."""
    lines = [line.split(": ", 1) for line in prompt.split("\n") if ": " in line]
    items = [{"speaker": s, "text": t} for s, t in lines]
    return json.dumps({"fragments": [{"title": f"T{i}", "statements": items[i : i + 2]} for i in range(0, len(items), 2)]})


def test_the_log_retries_and_resumes(spark, tmp_path):
    path = new_path(spark, "log")
    rows = prompts(spark, [(f"u{i}", f"user: t{i}") for i in range(4)])
    first = mr.ask(rows, failing_once(str(tmp_path)), path, retries=0).collect()
    assert {(r["attempts"], r["ok"]) for r in first} == {(1, False)}
    # A second run goes on with the attempts that are left; a new unit is asked from its first.
    more = rows.unionByName(prompts(spark, [("new", "user: t9")]))
    got = {r["id"]: (r["attempts"], r["ok"]) for r in mr.ask(more, failing_once(str(tmp_path)), path, retries=1).collect()}
    assert set(got.values()) == {(2, True)} and len(got) == 5
    calls = {p.name: len(p.read_text()) for p in tmp_path.iterdir()}
    # Once all is answered, nothing is asked any more.
    again = mr.ask(more, failing_once(str(tmp_path)), path, retries=1)
    assert again.count() == 5 and calls == {p.name: len(p.read_text()) for p in tmp_path.iterdir()}

    def refusing():
        raise_ = lambda asked: (_ for _ in ()).throw(OSError("down"))
        return raise_

    down = mr.ask(prompts(spark, [("d", "user: x")]), refusing, new_path(spark, "log"), retries=3).collect()
    assert [(r["attempts"], r["ok"], r["error"]) for r in down] == [(1, False, "OSError: down")]


def test_fragments_of_a_model_are_whole(spark, tmp_path):
    texts = ["first", "see [ARCHIVED_BLOCK_1] and [ARCHIVED_BLOCK_9]", "third", "third", "last"]
    rows = [("s_x", "s", "c", i, "user", t, f"s_x_st{i:04d}") for i, t in enumerate(texts)]
    statements = spark.createDataFrame(rows, STATEMENT)
    extracts = spark.createDataFrame([("s_x", "s", 0, "c")], "extract_id string, segment_id string, segment_index bigint, conv_id string")
    blocks = spark.createDataFrame(
        [("s_x", "ARCHIVED_BLOCK_1", "code_fence", 3, None)],
        "extract_id string, block_id string, block_kind string, line_count bigint, archival_description " + mr.DESCRIPTION,
    )
    out = mr.model_fragments(extracts, statements, blocks, failing_once(str(tmp_path)), "{statements_text}", "stub", new_path(spark, "log"))
    got = out["fragments"].orderBy("fragment_index").collect()
    assert [(r["fragment_id"], r["title"], r["status"], r["warnings"], r["statement_count"]) for r in got] == [
        ("s_x_f000", "T0", "ok", [], 2), ("s_x_f001", "T2", "ok", [], 2), ("s_x_f002", "T4", "ok", [], 1),
    ]
    meaning = "code_fence (3 lines)"
    assert got[0]["retrieval_text"] == f"T0\n\nuser: first\nuser: see {meaning} and [ARCHIVED_BLOCK_9]\n\n[Archived: {meaning}]"
    links = sorted((r["fragment_id"], r["position_in_fragment"], r["statement_id"]) for r in out["links"].collect())
    # Of equal texts the last statement is meant; a fragment links it once.
    assert links == [("s_x_f000", 0, "s_x_st0000"), ("s_x_f000", 1, "s_x_st0001"), ("s_x_f001", 0, "s_x_st0003"), ("s_x_f002", 0, "s_x_st0004")]
    store = Store(spark, new_path(spark, "store"), {"fragments": out["fragments"].schema, "links": out["links"].schema}, 4)
    for _ in range(2):
        mr.persist_run(store, {"fragments": out["fragments"], "links": out["links"]})
    assert store["fragments"].read().count() == 3 and store["links"].read().count() == 4


SEGMENT = "segment_id string, conv_id string, segment_index bigint, segment_text string"


def test_extract_rows_are_whole(spark):
    """The first view gets no answer; the second one shows the model's description of the block."""

    def factory():
        def model(prompt):
            if "brief_description=a script" not in prompt:
                return "{nope"
            return json.dumps({"statements": [{"speaker": "user", "text": "run [ARCHIVED_BLOCK_1]"}, {"speaker": "assistant", "text": "ok"}]})

        return model

    def describer():
        return lambda asked: [json.dumps({"block_kind": "code", "is_instruction_like": False, "brief_description": "a script"}) if "ls" in p else "no" for p in asked]

    text = "user: run\n```bash\nls -l\n" + "cd /some/long/folder\n" * 60 + "```\n\nassistant: ok"
    segments = spark.createDataFrame([("c_s000", "c", 0, text), ("c_s001", "c", 1, text.replace("ls -l", "pwd"))], SEGMENT)
    describe = lambda blocks: mr.describe_with_model(blocks, describer, "{block_text}", new_path(spark, "log"))
    out = mr.model_extracts(segments, factory, "{segment_text}", "stub", describe)
    got = {r["segment_id"]: r for r in out["extracts"].collect()}
    whole, failed = got["c_s000"], got["c_s001"]
    assert (whole["extract_id"], whole["extraction_attempt"], whole["model"], whole["status"]) == ("c_s000_x", 2, "stub", "ok")
    assert [(b["block_id"], b["archival_description"]["brief_description"]) for b in whole["archived_blocks"]] == [("ARCHIVED_BLOCK_1", "a script")]
    assert whole["latency_ms"] >= 0 and "ls -l" in whole["archived_blocks"][0]["raw_text"]
    # A description that failed is null, and the segment went through all three steps.
    assert failed["status"] == "partial" and failed["archived_blocks"][0]["archival_description"] is None and failed["warnings"]
    assert [r["text"] for r in out["statements"].where("segment_id = 'c_s000'").orderBy("statement_index").collect()] == ["run [ARCHIVED_BLOCK_1]", "ok"]
    assert {r["extract_id"] for r in out["blocks"].collect()} == {"c_s000_x", "c_s001_x"}


def test_two_ranges_equal_one_run(spark):
    def factory():
        def model(prompt):
            if "broken" in prompt.split("---")[-3]:
                return "{nope"
            context = prompt.count("Segment ")
            own = prompt.split("---BEGIN")[-1].split("---\n", 1)[1].split("\n")[0]
            last = prompt.split("\n---END")[0].split("\n")[-1] if context else ""
            return json.dumps({"summary": f"{own}/{context}/{last[-12:]}"})

        return model

    rows = [(f"c{c}_{i}", f"c{c}", i, "broken" if (c, i) == (1, 4) else f"s{c}.{i}") for c in range(4) for i in range(9 - c)]
    segments = spark.createDataFrame(rows, SEGMENT)
    told = lambda df: sorted((r["segment_id"], r["summary"], r["error"] is None) for r in df.collect())
    whole, end = mr.summarize_range(segments, factory)
    head, context = mr.summarize_range(segments.where("segment_index < 5"), factory)
    tail, last = mr.summarize_range(segments.where("segment_index >= 5"), factory, context)
    assert told(head) + told(tail) != [] and sorted(told(head) + told(tail)) == told(whole)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, end.collect()))
    seeded, _ = mr.summarize_range(
        spark.createDataFrame([("z_0", "z", 3, "own")], SEGMENT), factory,
        spark.createDataFrame([("z", 1, "before"), ("z", 7, "after"), ("y", 0, "other")], mr.CONTEXT),
    )
    assert [r["summary"] for r in seeded.collect()] == ["own/1/nt 0: before"]
    assert segments.where(F.col("conv_id") == "none").count() == 0
