"""Blocks, drift rules, the model ladder, fragments and summaries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import blocks as bl
from colloquy.operators import fragments as fr
from colloquy.operators import models
from colloquy.operators import similarity as sim
from colloquy.operators import statements as st
from colloquy.operators import summaries as sm


def texts(spark, *values):
    return spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(values)], "id string, text string")


CODE = "\n".join(f"line {i}" for i in range(30))
XML = "".join(f"<row id='{i}'>\n" for i in range(6))
SCHEMA = '{\n "type": "object",\n' + "".join(f' "f{i}": {i},\n' for i in range(8)) + ' "z": 1\n}'


def test_block_kinds_numbers_speakers_and_views(spark):
    text = f"user: see\n```py\n{CODE}\n```\nassistant: and\n{XML}ok\n~~~~\n{CODE}\n~~~~\n{SCHEMA}\nend"
    found = bl.archive_blocks(texts(spark, text)).orderBy("block_no").collect()
    assert [(b.block_id, b.block_kind, b.speaker) for b in found] == [
        ("ARCHIVED_BLOCK_1", "fenced_code", "user"), ("ARCHIVED_BLOCK_2", "xml_like", "assistant"),
        ("ARCHIVED_BLOCK_3", "fenced_code", "assistant"), ("ARCHIVED_BLOCK_4", "json_schema_like", "assistant"),
    ]
    assert [b.raw_text for b in found] == [f"```py\n{CODE}\n```", XML, f"~~~~\n{CODE}\n~~~~", SCHEMA]
    assert all(b.char_count == len(b.raw_text) and b.line_count == b.raw_text.count("\n") + 1 for b in found)
    one = texts(spark, text)
    view = bl.working_view(one, bl.archive_blocks(one)).first().working_view
    head, listing = view.split("\n---ARCHIVED BLOCKS---\n")
    assert head == "user: see\n[ARCHIVED_BLOCK_1]\nassistant: and\n[ARCHIVED_BLOCK_2]ok\n[ARCHIVED_BLOCK_3]\n[ARCHIVED_BLOCK_4]\nend"
    assert listing.split("\n")[0] == f"[ARCHIVED_BLOCK_1] kind=fenced_code speaker=user lines=32 chars={len(found[0].raw_text)}"
    archival = bl.working_view(one, bl.describe_blocks(bl.archive_blocks(one)), mode="archival").first().working_view
    assert "  block_kind=xml is_instruction_like=False brief_description=xml block of 7 lines" in archival


def test_small_or_absent_blocks_leave_the_text_alone(spark):
    plain = ["```\nx\n```", "# Title\n\n- a\n- b\n" * 20, "", "<a>\n<b>\n<c>\nx"]
    df = texts(spark, *plain)
    assert bl.archive_blocks(df).count() == 0
    views = {r.id: r.working_view for r in bl.working_view(df, bl.archive_blocks(df)).collect()}
    assert views == {f"t{i}": t for i, t in enumerate(plain)}


def test_equal_blocks_keep_their_own_numbers_and_fences_win(spark):
    block = f"```\n{XML}{SCHEMA}\n```"
    df = texts(spark, f"{block}\nmid\n{block}\n")
    spans = bl.archive_blocks(df).orderBy("block_no").collect()
    assert [s.block_kind for s in spans] == ["fenced_code"] * 2 and spans[0].start_at < spans[1].start_at
    assert [s.speaker for s in spans] == [None, None]
    view = bl.working_view(df, bl.archive_blocks(df), mode="placeholder").first().working_view
    assert view.index("[ARCHIVED_BLOCK_1]") < view.index("mid") < view.index("[ARCHIVED_BLOCK_2]")


def test_later_kind_that_overlaps_is_dropped_even_when_earlier_in_text(spark):
    # The markup run starts before the schema and reaches into it.
    text = "<a>\n<b>\n<c>\n<d> {\n \"type\": \"object\",\n" + "<e>\n" * 8 + "}\n"
    assert [s.block_kind for s in bl.block_spans(texts(spark, text)).collect()] == ["json_schema_like"]


def test_split_by_message(spark):
    df = texts(spark, "intro\nUser : one\ntwo\nASSISTANT: three\nuser:\n \nassistant: four", "no marks")
    rows = [(r.id, r.turn_index, r.speaker, r.body) for r in bl.split_by_message(df).collect()]
    assert rows == [("t0", 0, "user", "one\ntwo"), ("t0", 1, "assistant", "three"), ("t0", 2, "assistant", "four")]


LONG = " ".join(f"word{i}" for i in range(40))


def test_turn_dedup(spark):
    near = LONG + " more"
    other = " ".join(f"term{i}" for i in range(40))
    cases = [
        f"user: q\n\nassistant: {LONG}\n\nassistant: {near}",
        f"user: q\n\nassistant: {LONG}\n\nassistant: {other}",
        f"user: {LONG}\n\nuser: {near}\n\nassistant: a",
        f"assistant: {LONG}\n\nassistant: {other}\n\nassistant: {near}\n\nassistant: {near}",
        f"assistant: {LONG}\n\nuser: x\n\nassistant: {LONG}",
        "",
    ]
    got = {r.id: r for r in sim.dedup_assistant_turns(texts(spark, *cases)).collect()}
    assert [got[f"t{i}"].dropped_turns for i in range(6)] == [1, 0, 0, 2, 0, 0]
    assert got["t0"].text == f"user: q\n\nassistant: {near}"
    assert got["t3"].text == f"assistant: {other}\n\nassistant: {near}"
    assert all(got[f"t{i}"].text == cases[i] for i in (1, 2, 4, 5))


def test_near_pairs_against_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 30))] for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
        rows.append((f"x{i % 2}", i, " ".join(words)))

    def sh(t):
        w = t.split()
        return {" ".join(w)} if len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {}
    for e in ("x0", "x1"):
        own = [sh(t) for g, _, t in rows if g == e]
        want[e] = sum(len(a & b) / len(a | b) >= 0.7 for i, a in enumerate(own) for b in own[i + 1 :])
    df = spark.createDataFrame(rows, "extract_id string, statement_index bigint, text string")
    got = {r.extract_id: r.n for r in sim.near_dup_pairs(df).groupBy("extract_id").agg(F.sum("pairs").alias("n")).collect()}
    assert got == want and min(want.values()) > 0


def verdicts(spark, *cases):
    rows = [(f"s{i}", raw, view) for i, (raw, view) in enumerate(cases)]
    df = spark.createDataFrame(rows, "segment_id string, raw string, working_view string")
    checked = st.validate_statements(st.read_model_output(df), ["segment_id"]).orderBy("segment_id").collect()
    return [list(r.reasons) for r in checked]


def answer(*statements, **extra):
    return json.dumps({"statements": [{"speaker": s, "text": t} for s, t in statements], **extra})


def test_validation_rules(spark):
    distinct = [("assistant", f"Item {i} covers topic{i} alpha{i} beta{i}") for i in range(10)]
    got = verdicts(
        spark,
        (answer(*[("user", f"{LONG} x{i}") for i in range(10)]), "x\n" * 80),
        (answer(*[("user", f"unique{i} a{i} b{i}") for i in range(100)]), "x\n" * 9 + "x"),
        (answer(), "y" * 300),
        (answer(("user", "a"), note=1), "x"),
        (answer(*distinct), "x\n" * 80),
        ("[1]", "x"),
        ('{"statements": 3}', "x"),
        (answer(("system", "a")), "x"),
        ("nope", "x"),
        ("```json\n" + answer(("user", "a")) + "\n```", "x"),
    )
    assert got[0][0].startswith("found 45 near-duplicate") and "4-gram" in got[0][1]
    assert got[1] == ["statement count 100 exceeds plausible max 40 for 10-line input"]
    assert got[2] == ["zero statements extracted from non-empty segment"]
    assert got[3] == ["unexpected keys in output: note"]
    assert got[4] == [] and got[9] == []
    assert got[5] == ["output is not a JSON object"] and got[6] == ["'statements' is not a list"]
    assert got[7] == ["invalid speaker in 1 statement(s)"] and got[8] == ["output is not JSON"]


SEGMENT = "segment_id string, conv_id string, segment_index bigint, segment_text string"


def test_model_ladder(spark):
    def factory():
        def model(prompt):
            if "slow" in prompt:
                raise TimeoutError("too slow")
            if "good" in prompt:
                return answer(("user", "good one"), ("assistant", "fine"))
            if "second" in prompt:
                return "garbage" if "block_kind=" not in prompt else answer(("user", "by description"))
            if "split" in prompt:
                return "garbage" if "assistant:" in prompt else answer(("nobody", prompt[:7]))
            return "{}"

        return model

    code = f"```\n{CODE}\n```"
    rows = [
        ("a", "c", 0, "user: good\n\nassistant: ok"), ("b", "c", 1, f"user: second\n{code}\n"),
        ("d", "c", 2, "user: split\n\nassistant: split two"), ("e", "c", 3, "user: slow"),
    ]
    extracts, statements = st.extract_with_model(spark.createDataFrame(rows, SEGMENT), factory, "{segment_text}")
    got = {r.segment_id: (r.attempt, r.status) for r in extracts.collect()}
    assert got == {"a": (1, "ok"), "b": (2, "ok"), "d": (3, "ok"), "e": (3, "partial")}
    said = {(r.statement_id, r.speaker, r.text) for r in statements.collect()}
    assert ("a_x_st0000", "user", "good one") in said and ("b_x_st0000", "user", "by description") in said
    assert {s for s in said if s[0].startswith("d_")} == {("d_x_st0000", "user", "split"), ("d_x_st0001", "assistant", "split t")}
    notes = {r.segment_id: list(r.warnings) for r in extracts.collect()}
    assert any("TimeoutError" in w for w in notes["e"]) and notes["a"] == []


def test_repeated_turns_stay_away_in_every_attempt(spark):
    """Message by message, too, the model never sees a reply that a later one repeats."""
    reply = " ".join(f"word{i}" for i in range(30))

    def factory():
        def model(prompt):
            return "garbage" if "user:" in prompt else answer(("nobody", prompt[:8]))

        return model

    rows = [("a", "c", 0, f"user: ask\n\nassistant: {reply}\n\nassistant: {reply}")]
    _, statements = st.extract_with_model(spark.createDataFrame(rows, SEGMENT), factory, "{segment_text}")
    assert [(r.speaker, r.text) for r in statements.orderBy("statement_index").collect()] == [("user", "ask"), ("assistant", "word0 wo")]


def test_odd_items_cost_themselves_only(spark):
    def factory():
        good = {"speaker": "user", "text": "t"}
        return lambda prompt: json.dumps({"fragments": [{"title": "A", "statements": [good, 7, {"text": 1}]}, {"title": "B"}, {"title": "C", "statements": []}]})

    members, _ = fr.fragments_with_model(spark.createDataFrame([("s_x", "s", "c", 0, "user", "t")], STATEMENT), factory, "{statements_text}")
    got = sorted((r.fragment_index, r.title, r.position_in_fragment, r.speaker, r.text) for r in members.collect() if r.text or r.title != "A")
    assert [g[:3] for g in got if g[1] != "A"] == [(1, "B", 0), (2, "C", 0)] and (0, "A", 0, "user", "t") in got
    assert members.where("title = 'A'").count() == 3


def test_fenced_summaries_are_read_and_pages_merged(spark):
    def factory():
        def model(prompt):
            inside = [line.split(": ")[1] for line in prompt.split("\n") if line.startswith("Part ")]
            own = prompt.split("---\n")[1].split("\n")[0]
            return "```json\n" + json.dumps({"summary": "+".join(inside) or own}) + "\n```"

        return model

    rows = [("x0", "x", 0, "a"), ("x1", "x", 1, "b")]
    got = sm.summarize_with_model(spark.createDataFrame(rows, SEGMENT), factory).orderBy("segment_index").collect()
    assert [(r.summary, r.error) for r in got] == [("a", None), ("Segment 0: a", None)]
    prompts = spark.createDataFrame([(f"u#{i}", "S", f"---BEGIN T---\np{i}\n---END T---") for i in range(5)] + [("v#0", "S", "---BEGIN T---\nq\n---END T---")], "id string, system string, user string")
    merged = {r.id: r.summary for r in sm.summarize_pages(prompts, factory, "S", page_rows=2).collect()}
    assert merged == {"u": "p0+p1+p2+p3+p4", "v": "q"}


STATEMENT = "extract_id string, segment_id string, conv_id string, statement_index bigint, speaker string, text string"


def test_batches_cover_all_statements_and_failures_stay_apart(spark):
    rows = [("s_x", "s", "c", i, "user", f"t{i}") for i in range(120)]
    df = spark.createDataFrame(rows, STATEMENT)
    sizes = {r.batch: r["count"] for r in fr.batch_statements(df).groupBy("batch").count().collect()}
    assert sizes == {0: 50, 1: 50, 2: 20}

    def factory():
        def model(prompt):
            if "t60" in prompt:
                raise TimeoutError("late")
            lines = prompt.split("\n")
            return "```json\n" + json.dumps({"fragments": [{"title": lines[0], "statements": [{"speaker": "user", "text": lines[0][6:]}]}]}) + "\n```"

        return model

    members, runs = fr.fragments_with_model(df, factory, "{statements_text}")
    assert [(r.fragment_index, r.text) for r in members.orderBy("fragment_index").collect()] == [(0, "t0"), (1, "t100")]
    run = runs.first()
    assert run.fragment_count == 2 and run.is_degraded and not run.is_partial
    assert run.warning == "; ".join(f"batch {i}: Model output required cleanup (code fences removed)" for i in (1, 3))


def test_fragments_split_at_ten_and_keep_order(spark):
    rows = [("s_x", "s", "c", i, "user", f"same words here {i}") for i in range(23)] + [("s_x", "s", "c", 23, "user", "Else entirely.")]
    grouped = fr.group_statements(spark.createDataFrame(rows, STATEMENT))
    frags = fr.assemble_fragments(grouped).orderBy("fragment_index").collect()
    assert [f.statement_count for f in frags] == [10, 10, 3, 1]
    assert frags[0].fragment_id == "s_x_f000" and frags[0].title == "same words here 0"
    assert frags[3].retrieval_text == "Else entirely.\n\nuser: Else entirely."
    links = fr.link_statements(grouped).collect()
    assert len(links) == 24 and len({(l.fragment_id, l.position_in_fragment) for l in links}) == 24


@pytest.mark.parametrize("window_rows", [2, 256])
def test_sequential_summaries_see_the_three_before(spark, window_rows):
    def factory():
        def model(prompt):
            seen = [line.split(": ")[1] for line in prompt.split("\n") if line.startswith("Segment ")]
            own = prompt.split("TRANSCRIPT---\n")[1].split("\n")[0]
            return json.dumps({"summary": own + "<" + "".join(s[0] for s in seen)})

        return model

    rows = [(f"{c}{i}", c, i, "abcdefg"[i]) for c in "xy" for i in range(7)]
    got = sm.summarize_with_model(spark.createDataFrame(rows, SEGMENT), factory, 3, window_rows).collect()
    want = {f"{c}{i}": "abcdefg"[i] + "<" + "abcdefg"[max(0, i - 3) : i] for c in "xy" for i in range(7)}
    assert {r.segment_id: r.summary for r in got} == want


def test_embedder_errors_become_rows(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def model(batch):
            calls.add(1)
            return [[] if "odd" in text else [1.0, 2.0] for text in batch]

        return model

    many = models.embed(texts(spark, *[f"t{i}" for i in range(50)]).coalesce(1), "text", factory).collect()
    assert all(r.vector == [1.0, 2.0] for r in many) and calls.value == 1

    got = {r.text: (r.vector, r.error) for r in models.embed(texts(spark, "ok", "", "odd"), "text", factory).collect()}
    assert got["ok"] == ([1.0, 2.0], None) and "empty text" in got[""][1] and "empty vector" in got["odd"][1]
    base = {r.text: r for r in models.embed(texts(spark, "one two two", "..."), "text", dim=8).collect()}
    assert abs(sum(x * x for x in base["one two two"].vector) - 1) < 1e-12 and base["..."].error == "empty text"


def test_model_summaries_from_prompts(spark):
    def factory():
        def model(prompt):
            if "bad" in prompt:
                return "no json"
            if "late" in prompt:
                raise TimeoutError("late")
            body = json.dumps({"summary": "S", "bullets": ["a", "b"], "confidence": 0.9, "lang": "en"})
            return f"```json\n{body}\n```" if "fenced" in prompt else body

        return model

    pages = spark.createDataFrame([("c", i, 0, t) for i, t in enumerate(["plain", "fenced", "bad", "late"])], "conv_id string, topic_index bigint, page bigint, member_lines string")
    got = {r.id: r for r in sm.summarize_prompts(sm.topic_prompts(pages, "Sum up."), factory).collect()}
    assert [got[f"c_t{i:03d}#0"].status for i in range(4)] == ["ok", "degraded", "partial", "skipped"]
    assert got["c_t000#0"].bullets == ["a", "b"] and got["c_t000#0"].lang == "en" and got["c_t002#0"].summary == ""
    assert got["c_t003#0"].warnings == ["TimeoutError: late"]


def test_near_copies_are_sought_by_shared_shingles_only(spark, capsys):
    said = ["a b c d e f g h i j k l", "a b c d e f g h i j k l m", "A b c d e f g h i j k l!", "one two three four five six", "n o p", "n o, p", "...", None, ""]
    rows = spark.createDataFrame([("x", i, t) for i, t in enumerate(said)] + [("y", 0, said[0])], "extract_id string, statement_index bigint, text string")
    pairs = {(r.a, r.b): (round(r.jaccard, 6), r.pairs) for r in sim.near_dup_pairs(rows).collect()}
    assert pairs == {(0, 0): (1.0, 1), (0, 1): (round(8 / 9, 6), 2), (4, 4): (1.0, 1)}
    classes = sim.shingle_classes(rows, ["extract_id"], "statement_index", "text")
    classes.explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 1
    # What no other class of the group has meets nobody, and is not handed on.
    left = sim._prefixes(classes, ["extract_id"], 0.7).collect()
    assert {r.first_at for r in left} == {0, 1} and all(r.extract_id == "x" for r in left)


def test_validation_joins_move_no_texts(spark, capsys):
    listed = [json.dumps({"statements": [{"speaker": "user", "text": f"{w} said so in all of the words that he had"} for w in "abcdef"]}), "[1]", "3", "null", "x"]
    rows = [(f"s{i}", a, raw, "view\n" * 60) for i, raw in enumerate(listed) for a in (1, 2)] + [(None, 1, listed[0], "v")]
    df = spark.createDataFrame(rows, "segment_id string, attempt int, raw string, working_view string")
    checked = st.validate_statements(st.read_model_output(df), ["segment_id", "attempt"])
    narrow = checked.select("segment_id", "attempt", "statement_count", "reasons")
    narrow.explain()
    plan = capsys.readouterr().out
    assert "schema_of_variant" not in plan and "working_view" not in plan
    got = {(r.segment_id, r.attempt): (r.statement_count, r.reasons) for r in narrow.collect()}
    near = ["found 15 near-duplicate statement pair(s)"]
    gram = ["4-gram 'all of the words' appears in 6/6 statements"]
    odd = [(0, [st.NOT_OBJECT]), (0, [st.NOT_OBJECT]), (0, [st.NOT_OBJECT]), (0, [st.NOT_JSON])]
    assert all(got["s0", a] == (6, near + gram) for a in (1, 2)) and all(got[f"s{i}", 2] == w for i, w in enumerate(odd, 1))
    assert got[None, 1] == (6, [])  # a null key meets nothing


def test_scores_of_common_and_rare_words(spark, monkeypatch):
    said = [("g0", 0, "the cat and the dog"), ("g0", 1, "the end"), ("g1", 0, "the cat"), ("g2", 0, "the bird flew"), ("g2", 1, "...")]
    rows = spark.createDataFrame(said, "g string, n int, text string")

    def scores():
        return sorted((r.g, r.n, r.score) for r in sm.sentence_scores(rows, ["g"], "n").collect())

    whole = scores()
    monkeypatch.setattr(sm, "COMMON_WORDS", 4)  # of nine uses of seven words: 'the' three times, 'cat' twice
    assert scores() == whole
    weight = {w: np.log(1 + 3 / n) for w, n in dict(the=3, cat=2, dog=1, end=1, bird=1, flew=1).items()} | {"and": np.log(4)}
    want = {("g0", 0): "the cat and dog", ("g0", 1): "the end", ("g1", 0): "the cat", ("g2", 0): "the bird flew"}
    assert whole == [(*k, pytest.approx(np.mean([weight[w] for w in t.split()]), abs=2e-6)) for k, t in sorted(want.items())]


def test_segment_rows_give_the_words_of_their_documents(spark, monkeypatch):
    said = ["user: The cat sat. The cat ran.\n\nassistant: A dog. The end!", "user: A cat? The dog.", "user: The sun.", ""]
    rows = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(said)], "segment_id string, segment_text string")
    given, real = [], sm.sentence_scores

    def scores(*args):
        given.append(args[-1])
        return real(*args)

    monkeypatch.setattr(sm, "sentence_scores", scores)
    got = sorted(sm.summarize_segments(rows).collect())
    assert got == sorted(sm.summarize(sm.segment_sentences(rows), ["segment_id"], "sentence_index").collect())
    # Ids that repeat: one document of several rows.
    twice = rows.unionByName(rows.withColumn("segment_text", F.concat("segment_text", F.lit(" More."))))
    for r in (sm.summarize_segments(twice), sm.summarize(sm.segment_sentences(twice), ["segment_id"], "sentence_index")):
        assert sorted(x.segment_id for x in r.collect()) == ["s0", "s1", "s2"]
    assert [g is None for g in given] == [False, True, True, True]
