"""Visibility, keys, retries, merge, trees, exports and segmentation."""

import itertools
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import messages as ms
from colloquy.operators import ordered
from colloquy.operators import segments as sg
from colloquy.operators import tree
from colloquy.session import CHECKPOINT_SETTING, shared_dir
from colloquy.sources import exports as ex
from colloquy.sources import files as fl

MESSAGE = "conv_id string, message_id string, speaker string, created_at timestamp, ordinal bigint, content string"


def chats(spark, conversations):
    rows = [
        (conv, f"{conv}_m{i}", speaker, None, i, content)
        for conv, turns in conversations.items()
        for i, (speaker, content) in enumerate(turns)
    ]
    return spark.createDataFrame(rows, MESSAGE)


def roles(spark, names):
    return chats(
        spark,
        {n or "empty": [("user" if r == "u" else "assistant", f"{r}{i}") for i, r in enumerate(n)] for n in names},
    )


def expected_segments(pattern):
    """Segments as position lists, and the tail, stepped through by hand."""
    segments, tail, i = [], None, 0
    while i < len(pattern):
        j = i + 1
        while j < len(pattern) and pattern[j] == "a":
            j += 1
        if pattern[i] == "a":
            segments.append(list(range(i, j)))
        elif j == i + 1:
            if j == len(pattern):
                tail = i
            else:
                segments.append([i])
        else:
            segments.append(list(range(i, min(j + 1, len(pattern)))))
        i = j
    return segments, tail


@pytest.mark.parametrize("chunk_rows", [2, ordered.CHUNK_ROWS])
def test_segments_match_hand_stepping_for_every_role_pattern(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(ordered.ordered_scan, "__defaults__", (*ordered.ordered_scan.__defaults__[:-1], chunk_rows))
    patterns = ["".join(p) for n in range(1, 8) for p in itertools.product("ua", repeat=n)]
    numbered = ms.assign_positions(roles(spark, patterns))
    found = {}
    for row in sg.segment_conversations(numbered).collect():
        found.setdefault(row.conv_id, {})[row.segment_index] = row
    tails = {row.conv_id: row.position for row in sg.pending_tails(numbered).collect()}
    for pattern in patterns:
        segments, tail = expected_segments(pattern)
        mine = [found.get(pattern, {})[i] for i in range(len(found.get(pattern, {})))]
        assert [[int(m.rsplit("m", 1)[1]) for m in s.message_ids] for s in mine] == segments, pattern
        assert [s.segment_id for s in mine] == [f"{pattern}_s{i:03d}" for i in range(len(segments))]
        assert tails.get(pattern) == tail, pattern


def test_segment_text_and_preview(spark):
    numbered = ms.assign_positions(
        chats(spark, {"c": [("user", " hi "), ("assistant", "yes\n"), ("user", "a\n" + "b" * 130)]})
    )
    assert sg.segment_conversations(numbered).first().segment_text == "user: hi\n\nassistant: yes\n\nuser: a\n" + "b" * 130
    tail = sg.pending_tails(numbered).first()
    assert tail.preview == ("a " + "b" * 118) + "…"


def test_manifest_pages_hold_all_segments_in_order(spark):
    numbered = ms.assign_positions(roles(spark, ["ua" * 7, "u"]))
    rows = sg.segment_manifest(numbered, sg.segment_conversations(numbered), sg.pending_tails(numbered), page_rows=3).collect()
    long = sorted((r for r in rows if r.conv_id == "ua" * 7), key=lambda r: r.page)
    assert [len(r.segment_ids) for r in long] == [3, 3, 1]
    assert sum((list(r.segment_ids) for r in long), []) == [f"{'ua' * 7}_s{i:03d}" for i in range(7)]
    (lone,) = [r for r in rows if r.conv_id == "u"]
    assert (lone.segment_count, lone.segment_ids, lone.tail_position) == (0, [], 0)


def test_ordered_scan_equals_one_window(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(-5, 5)) for g in "abc" for i in range(23)]
    df = spark.createDataFrame(rows, "g string, i bigint, x bigint")
    got = ordered.ordered_scan(
        df, ["g"], "i", sums={"s": F.col("x")}, maxes={"m": F.col("x")},
        previous={"p": F.col("x")}, following={"n": F.col("x")}, firsts={"f": F.col("x")}, chunk_rows=4,
    ).collect()
    by = {g: [x for h, _, x in rows if h == g] for g in "abc"}
    assert len(got) == len(rows)
    for r in got:
        xs, i = by[r.g], r.i
        assert r.s == sum(xs[: i + 1]) and r.m == max(xs[: i + 1]) and r.f == xs[0]
        assert r.p == (xs[i - 1] if i else None) and r.n == (xs[i + 1] if i + 1 < len(xs) else None)


def test_rolling_context_across_chunks(spark):
    rows = spark.createDataFrame([("c", i, f"t{i}") for i in range(10)], "conv_id string, segment_index bigint, summary string")
    chunked = ordered.with_earlier_rows(rows, ["conv_id"], "segment_index", 3, 4)
    assert chunked.where("not _extra").count() == 10
    got = {r.segment_index: r.context for r in sg.rolling_context(rows).collect()}
    assert got[0] == "" and got[2] == "Segment 0: t0\nSegment 1: t1"
    assert got[9] == "Segment 0: t6\nSegment 1: t7\nSegment 2: t8"


RAW = "conv_id string, role string, recipient string, content_type string, hidden boolean, content string"


@pytest.mark.parametrize(
    "change",
    [{"role": "tool"}, {"role": None}, {"recipient": "bio"}, {"content_type": "code"}, {"content_type": None}, {"hidden": True}, {"content": " \n"}, {"content": None}],
)
def test_each_visibility_rule_alone_hides(spark, change):
    shown = {"conv_id": "c", "role": "user", "recipient": None, "content_type": "text", "hidden": None, "content": "hi"}
    rows = spark.createDataFrame([tuple({**shown, **change}.values()), tuple(shown.values())], RAW)
    assert ms.visible_messages(rows).count() == 1


def test_retry_chain_collapses_to_the_last(spark):
    turns = [("user", "a  b"), ("user", " a b"), ("user", "a\nb "), ("assistant", "x"), ("assistant", "x"), ("user", "a b"), ("user", "c")]
    left = ms.collapse_retries(chats(spark, {"c": turns})).orderBy("ordinal").collect()
    assert [r.ordinal for r in left] == [2, 3, 4, 5, 6]


def test_merge_keeps_order_and_first_incoming(spark):
    schema = "conv_id string, message_id string, content string, position bigint"
    old = spark.createDataFrame([("c", "b", "old b", 0), ("c", "a", "old a", 1)], schema)
    new = spark.createDataFrame(
        [("c", "x", "first x", 0), ("c", "a", "new a", 1), ("c", "x", "second x", 2), ("c", "y", "y", 3), ("d", "z", "z", 0)], schema
    )
    got = ms.merge_messages(old, new).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.message_id, r.content, r.position) for r in got] == [
        ("c", "b", "old b", 0), ("c", "a", "old a", 1), ("c", "x", "first x", 2), ("c", "y", "y", 3), ("d", "z", "z", 0)
    ]
    again = ms.merge_messages(ms.merge_messages(old, new), new)
    assert again.count() == 5


def path_of(df, conv="c"):
    return [r.node_id for r in df.where(F.col("conv_id") == conv).orderBy("position").collect()]


NODE = "conv_id string, node_id string, parent_id string, map_position bigint, children array<string>"


def test_active_path_follows_the_older_branch_and_long_chains(spark):
    rows = [("c", "r", None, 0, ["a"]), ("c", "a", "r", 1, ["b1", "b2"]), ("c", "b1", "a", 2, []), ("c", "b2", "a", 3, [])]
    rows += [("d", f"n{i}", f"n{i - 1}" if i else "gone", i, []) for i in range(300)]
    nodes = spark.createDataFrame(rows, NODE)
    heads = spark.createDataFrame([("c", "b1"), ("d", "n299"), ("c", "nope")], "conv_id string, node_id string")
    path = tree.active_path(nodes, heads)
    assert path_of(path) == ["r", "a", "b1"]
    assert path_of(path, "d") == [f"n{i}" for i in range(300)]
    stats = {r.conv_id: r.off_path for r in tree.branch_stats(nodes, path).collect()}
    assert stats == {"c": 1, "d": 0}


def test_parent_cycle_ends_and_is_reported(spark):
    nodes = spark.createDataFrame([("c", "a", "b", 0, []), ("c", "b", "a", 1, []), ("d", "r", None, 0, [])], NODE)
    heads = spark.createDataFrame([("c", "a"), ("d", "r")], "conv_id string, node_id string")
    assert set(path_of(tree.active_path(nodes, heads))) == {"a", "b"}
    assert [r.conv_id for r in tree.cycles(nodes, heads).collect()] == ["c"]


def test_last_child_path_skips_unknown_children_and_stops_on_a_cycle(spark):
    rows = [
        ("c", "r2", None, 5, []), ("c", "r", None, 0, ["a", "b", "gone"]), ("c", "a", "r", 1, []), ("c", "b", "r", 2, ["e"]),
        ("c", "e", "b", 3, ["r"]),
    ]
    assert path_of(tree.last_child_path(spark.createDataFrame(rows, NODE))) == ["r", "b", "e"]


def export(head, **extra):
    def node(key, parent, children, **message):
        if message:
            message = {
                "id": message.get("id"), "author": {"role": message["role"]}, "create_time": message.get("t"),
                "content": {"content_type": "text", "parts": message["parts"]},
            }
        return {"id": key, "parent": parent, "children": children, "message": message or None}

    mapping = {
        "root": node("root", None, ["q"]),
        "q": node("q", "root", ["a1", "a2"], id="m-q", role="user", parts=["Hello ", {"image": 1}, "there"], t=1700000000.25),
        "a1": node("a1", "q", [], id=" ", role="assistant", parts=["old"], t=1700000001.0),
        "a2": node("a2", "q", [], id="m-a2", role="assistant", parts=["new"], t=None),
    }
    return {"title": "T", "mapping": mapping, "current_node": head, **extra}


def test_exports_from_files(spark, tmp_path):
    (tmp_path / "first.json").write_text(json.dumps(export("a1", conversation_id="c1")))
    (tmp_path / "second.json").write_text(json.dumps(export(None)))
    (tmp_path / "third.json").write_text(json.dumps(export("missing")))
    (tmp_path / "broken.json").write_text("{nope")
    (tmp_path / "list.json").write_text("[]")
    exports = ex.read_exports(spark, str(tmp_path))
    bad = {r.file_name: r.bad_reason for r in exports.collect() if r.bad_reason}
    assert bad == {"broken.json": "invalid JSON", "list.json": "not a JSON object"}
    rows = ex.export_messages(exports).orderBy("conv_id", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r.conv_id, []).append((r.message_id, r.speaker, r.content))
    assert got["second"] == got["third"] == [("m-q", "user", "Hello \nthere"), ("m-a2", "assistant", "new")]
    key, speaker, content = got["c1"][1]
    import hashlib

    digest = hashlib.sha256(b"c1|assistant|old|1700000001.0").hexdigest()[:16]
    assert (key, speaker, content) == (f"hash_{digest}", "assistant", "old")
    stamps = {r.message_id: r.t for r in ex.export_messages(exports).select("message_id", tx.iso(F.col("created_at")).alias("t")).collect()}
    assert stamps["m-q"] == "2023-11-14T22:13:20.250000Z" and stamps["m-a2"] is None
    header = {r.conv_id: r.title for r in ex.conversation_headers(exports).collect()}
    assert header == {"c1": "T", "second": "T", "third": "T"}
    prints = fl.fingerprint_files(spark, str(tmp_path), "raw_export").collect()
    assert {r.original_filename for r in prints} == {"first.json", "second.json", "third.json", "broken.json", "list.json"}
    assert all(r.sha256 == hashlib.sha256((tmp_path / r.original_filename).read_bytes()).hexdigest() for r in prints)


def test_exports_of_one_conversation_are_merged_in_import_order(spark, tmp_path):
    short = export("q", conversation_id="c", update_time=1.0)
    whole = export("a2", conversation_id="c", update_time=2.0)
    other = export("a2")
    for name, body in {"2.json": short, "1.json": whole, "0.json": whole, "x.json": other}.items():
        (tmp_path / name).write_text(json.dumps(body))
    exports = ex.read_exports(spark, str(tmp_path))
    rows = ex.export_messages(exports).where("conv_id = 'c'").orderBy("position").collect()
    assert [(r.message_id, r.position, r.segment_index) for r in rows] == [("m-q", 0, 0), ("m-a2", 1, 0)]
    first = ex.ingest(exports.where("file_name in ('2.json', 'x.json')"))
    tables = ex.ingest(exports, first)
    again = ex.ingest(exports, tables)
    flat = lambda t, name: sorted(map(repr, t[name].select(*sorted(t[name].columns)).collect()))
    for name in tables:
        assert flat(tables, name) == flat(again, name)
    # Three raw files: two of the four are the same under other names. Conversation c was
    # kept in two states, x in one.
    assert sorted(r.source_kind for r in tables["source_files"].collect()) == ["normalized"] * 3 + ["raw_export"] * 3
    assert tables["source_files"].select("sha256", "source_kind").distinct().count() == 6
    for r in tables["conversations"].collect():
        own = {(f.source_file_id, f.source_kind): f for f in tables["source_files"].collect()}
        raw, normal = own[r.raw_source_file_id, "raw_export"], own[r.normalized_source_file_id, "normalized"]
        assert raw.sha256 == hashlib.sha256((tmp_path / raw.original_filename).read_bytes()).hexdigest()
        assert raw.size_bytes == (tmp_path / raw.original_filename).stat().st_size and normal.size_bytes > 0
        assert str(r.conversation_date) == "2023-11-14 22:13:20.250000"
    assert tables["conversations"].count() == 2
    assert {r.conv_id: r.message_count for r in tables["conversations"].collect()} == {"c": 2, "x": 2}
    assert tables["segments"].count() == 2


def test_a_message_without_id_is_hashed_with_the_exports_own_id(spark, tmp_path):
    import hashlib

    (tmp_path / "name.json").write_text(json.dumps(export("a1")))
    rows = ex.export_messages(ex.read_exports(spark, str(tmp_path))).orderBy("position").collect()
    digest = hashlib.sha256(b"|assistant|old|1700000001.0").hexdigest()[:16]
    assert rows[1].conv_id == "name" and rows[1].message_id == f"hash_{digest}"


def test_repeated_edges_do_not_multiply(spark):
    nodes = spark.createDataFrame([("c", f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] * 3, "conv_id string, node_id string, parent_id string")
    heads = spark.createDataFrame([("c", "n39")], "conv_id string, node_id string")
    path = tree.active_path(nodes, heads).collect()
    assert sorted((r.position, r.node_id) for r in path) == [(i, f"n{i}") for i in range(40)]


def test_long_conversations_keep_their_pages(spark):
    chat = chats(spark, {"c": [("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(2500)]})
    numbered = ms.linear_messages(chat)
    segments = sg.segment_conversations(numbered)
    manifest = sg.segment_manifest(numbered, segments, sg.pending_tails(numbered)).orderBy("page").collect()
    assert [len(r.segment_ids) for r in manifest] == [1000, 250] and {r.segment_count for r in manifest} == {1250}
    pages = sg.transcript(numbered.withColumn("ts", F.lit(None).cast("string"))).orderBy("page").collect()
    assert [r.page for r in pages] == [0, 1, 2] and "\n\n".join(r.transcript for r in pages).count("[user]") == 1250


def test_chat_lists(spark, tmp_path):
    cases = {
        "good.json": [{"speaker": "u", "content": "hi", "ts": "t0"}, {"speaker": "a", "content": "yo"}],
        "empty.json": [], "object.json": {"a": 1}, "item.json": ["x"], "field.json": [{"speaker": "u"}],
    }
    for name, body in cases.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("[")
    messages, problems = fl.read_chat_lists(spark, str(tmp_path))
    assert {(r.file_name, r.problem, r.is_error) for r in problems.collect()} == {
        ("empty.json", "empty conversation", False), ("object.json", "not an array", True),
        ("item.json", "item is not an object", True), ("field.json", "item lacks speaker or content", True),
        ("bad.json", "invalid JSON", True),
    }
    assert [(r.speaker, r.content, r.ts) for r in messages.orderBy("position").collect()] == [("u", "hi", "t0"), ("a", "yo", None)]
    text = sg.transcript(messages).first().transcript
    assert text == "[u] (t0):\nhi\n\n[a]:\nyo"
    pages = sg.transcript(messages, page_rows=1).orderBy("page").collect()
    assert "\n\n".join(p.transcript for p in pages) == text


def test_text_expressions(spark):
    row = spark.createDataFrame([("it's a_b ", 1700000000.0, "x" * 161)], "a string, b double, c string").select(
        tx.strip(F.col("a")), tx.title_case(F.lit("c1_s000 it's über 3rd")), tx.float_text(F.col("b")),
        tx.preview(F.col("c"), 160, "..."), tx.file_stem(F.lit("/x/y.z.json")), tx.words(F.lit("Déjà vu_1, ok")),
    ).first()
    assert list(row) == ["it's a_b", "C1_S000 It'S Über 3Rd", "1700000000.0", "x" * 160 + "...", "y.z", ["déjà", "vu_1", "ok"]]


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get(CHECKPOINT_SETTING)


class Session:
    """Stands in for a session of another master."""

    def __init__(self, master):
        self.sparkContext, self.conf, self.set_to = self, self, {}
        self.master, self.set = master, self.set_to.__setitem__

    def get(self, key, default=None):
        return self.set_to.get(key, "/warehouse" if key == "spark.sql.warehouse.dir" else default)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_has_to_name_a_shared_folder(master):
    with pytest.raises(ValueError, match=CHECKPOINT_SETTING):
        shared_dir(Session(master))


def test_a_local_session_uses_a_folder_beside_its_warehouse():
    session = Session("local[2]")
    assert shared_dir(session) == shared_dir(session) == "/warehouse/_stages"


def test_stage_tables_are_written_once_for_an_input(spark, tmp_path):
    import shutil

    from colloquy.session import forget_stages, input_version, staged

    source, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.range(3)

    spark.range(5).write.parquet(source)
    version = input_version(spark.read.parquet(source))
    assert [staged(spark, version, "t", build).count() for _ in range(2)] == [3, 3] and len(built) == 1
    spark.range(5).write.mode("append").parquet(source)
    changed = input_version(spark.read.parquet(source))
    assert changed != version and staged(spark, changed, "t", build).count() == 3 and len(built) == 2
    paths = forget_stages(spark)
    assert len(paths) >= 2 and staged(spark, version, "t", build).count() == 3 and len(built) == 3
    (path,) = list(session_stages().values())
    shutil.rmtree(path)
    assert staged(spark, version, "t", build).count() == 3 and len(built) == 4


def session_stages():
    from colloquy import session

    return session._STAGES


def test_stream_of_exports_equals_the_batch(spark, tmp_path):
    """Files arrive over three runs; equal content is imported once, under whatever name."""
    from colloquy.session import new_path
    from colloquy.streaming.ingest import IngestStore, export_stream
    from colloquy.streaming.jobs import run_available

    folder, out = tmp_path / "in", new_path(spark, "ingested")
    folder.mkdir()
    store, seen = IngestStore(spark, out, 4), []
    held = store.ingest
    store.ingest = lambda files: seen.append(held(files))
    stream = export_stream(spark, str(folder), "*.json")
    bodies = [
        {"a.json": export("q", conversation_id="c", update_time=1.0), "b.json": export("a1"), "bad.json": None},
        {"sub_c.json": export("a2", conversation_id="c", update_time=2.0), "copy.json": export("q", conversation_id="c", update_time=1.0)},
        {"again.json": export("a2", conversation_id="c", update_time=2.0)},
    ]
    for part in bodies:
        for name, body in part.items():
            (folder / name).write_text("{nope" if body is None else json.dumps(body))
        run_available(stream, store.sink(), f"{out}/log")
    run_available(stream, store.sink(), f"{out}/log")
    # The copies and the last file bring nothing; a run without files reads none.
    assert seen == [2, 1, 0]
    first = ex.ingest(ex.read_exports(spark, [str(folder / n) for n in ("a.json", "b.json")]))
    want = ex.ingest(ex.read_exports(spark, str(folder / "sub_c.json")), first)
    got = store.tables()
    flat = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for name in want:
        assert flat(got[name]) == flat(want[name]), name


def test_packed_files_have_the_fingerprints_of_files(spark, tmp_path):
    texts = {f"{i}.txt": f"text {i} é\n" for i in range(30)}
    (tmp_path / "plain").mkdir()
    for name, value in texts.items():
        (tmp_path / "plain" / name).write_bytes(value.encode())
    rows = spark.createDataFrame(list(texts.items()), "path string, value string").coalesce(2)
    fl.pack_files(rows, str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("*.parquet"))) <= 2
    columns = ["source_file_id", "source_kind", "original_filename", "sha256", "size_bytes"]
    plain = fl.fingerprint_files(spark, str(tmp_path / "plain"), "normalized").select(*columns)
    packed = fl.fingerprint_files(spark, str(tmp_path / "packed"), "normalized", packed=True).select(*columns)
    assert sorted(packed.collect()) == sorted(plain.collect())


def test_stream_of_packed_exports_equals_the_batch(spark, tmp_path):
    """Files come as rows of tables; equal content is imported once, under whatever name."""
    from colloquy.session import new_path
    from colloquy.streaming.ingest import IngestStore, packed_stream
    from colloquy.streaming.jobs import run_available

    out, bodies = new_path(spark, "ingested"), [export("q", conversation_id=f"c{i}", update_time=1.0) for i in range(20)]
    store, seen = IngestStore(spark, out, 4), []
    held = store.ingest
    store.ingest = lambda files: seen.append(held(files))
    (tmp_path / "plain").mkdir()
    for version in (1, 2):
        rows = [(f"v{version}/{i}.json", json.dumps(body)) for i, body in enumerate(bodies)]
        fl.pack_files(spark.createDataFrame(rows, "path string, value string").coalesce(1), str(tmp_path / "in" / f"v{version}"))
        run_available(packed_stream(spark, str(tmp_path / "in")), store.sink(), f"{out}/log")
    assert seen == [20, 0]
    for i, body in enumerate(bodies):
        (tmp_path / "plain" / f"{i}.json").write_text(json.dumps(body))
    want, got = ex.ingest(ex.read_exports(spark, str(tmp_path / "plain"))), store.tables()
    flat = lambda df: sorted(map(repr, df.drop("storage_path", "raw_export_path").collect()))
    for name in want:
        assert flat(got[name]) == flat(want[name].select(*got[name].columns)), name
