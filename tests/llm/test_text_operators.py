"""Decontamination, licences, line de-duplication, order MinHash, packing, personal data."""

import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate as dc
from colloquy.llm import licenses, lines, packing, pii
from colloquy.llm import order_minhash as om
from colloquy.llm.common import words_of
from colloquy.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lowered(text))


def documents(spark, texts, schema=SCHEMA):
    rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def clashing(docs, names):
    """The same rows with further columns of the operators' own names."""
    return docs.select("*", *[F.lit("x").alias(n) for n in names if n not in docs.columns])


def prose(r, n):
    return " ".join("".join(r.choices("abcdefg", k=r.randint(1, 4))) for _ in range(n))


def test_words_are_those_of_the_pattern():
    texts = ["Ab c'é d", "", None, "x", "Ünder Z", "yz a", "a" * 5000 + " b", "..", "0Z9"]
    found = words_of(pa.array(texts, pa.string()))
    assert [found.text(i).decode() for i in range(len(found.begin))] == [w for t in texts for w in words(t)]
    assert list(np.diff(found.first)) == [len(words(t)) for t in texts]
    again = words_of(pa.array(["b", "z9", "Ab"]))
    assert again.hashes[2] == found.hashes[0]
    assert len(set(found.hashes.tolist())) == len(set(w for t in texts for w in words(t)))


# 1. Benchmark decontamination


def brute_hits(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for name, body in items:
        iw = words(body)
        size = min(window, len(iw))
        runs = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if size else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in runs:
                hit |= set(range(i, i + size))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("shortest", [1, 2, 7, 12])
def test_match_equals_brute_force(spark, shortest):
    r = random.Random(shortest)
    vocabulary = ["a", "b", "ab", "éa", "c9", "d"]
    run = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, run(r.randint(shortest, 25))) for i in range(12)] + [(90, None), (91, ""), (92, " .")]
    items.append((93, items[0][1]))
    texts = [None, "", "...", "a"]
    for _ in range(60):
        body = run(r.randint(1, 40))
        if r.random() < 0.6:
            body += r.choice((" ", "\n", "; ")) + r.choice(items[:12])[1].upper() + "!" + run(3)
        texts.append(body)
    texts += [texts[-1], "x" * 200_000 + " " + items[0][1]]
    docs = clashing(documents(spark, texts), ["key", "items", "spans", "n_hit"])
    found = {x["doc_id"]: x for x in dc.match(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        assert (found[i]["n_words"], found[i]["n_hit"], found[i]["items"]) == brute_hits(text, items)
        if text and len(text) < 1000:
            cut = " ".join(text[s["start"] : s["end"]] for s in found[i]["spans"])
            assert len(words(cut)) == found[i]["n_hit"]


def test_several_automata_and_an_empty_benchmark(spark, monkeypatch):
    r = random.Random(5)
    items = [(i, prose(r, 14)) for i in range(8)]
    docs = documents(spark, [prose(r, 5) + " " + body + " " + prose(r, 5) for _, body in items] + [prose(r, 30)])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, dc.match(docs, bench).select("doc_id", "n_hit").collect()))
    monkeypatch.setattr(dc, "INDEX_WORDS", 30)
    assert sorted(map(tuple, dc.match(docs, bench).select("doc_id", "n_hit").collect())) == whole
    assert [n for _, n in whole] == [14] * 8 + [0]
    # One item of many automata, texts that repeat, and items that share a text's words.
    long = prose(r, 200)
    texts = [long, " ".join(long.split()[25:60]), items[0][1] + " zz " + items[1][1], None, "", prose(r, 40)] * 2
    more = spark.createDataFrame(items + [(50, long), (51, None), (52, "a b"), (53, " ".join(long.split()[30:45]))], "item_id bigint, text string")
    docs = clashing(documents(spark, texts), ["key", "runs", "items", "doc"])
    parts = {x["doc_id"]: x for x in dc.match(docs, more).collect()}
    # None of them holds more states than its words allow, so the driver stays flat.
    states = [len(a.link) for a in dc.automata(more)]
    assert len(states) > 8 and max(states) <= 2 * 30 + 1
    cut = sorted(map(tuple, dc.decontaminate(docs, more, max_coverage=0.9).select("doc_id", "text", "runs").collect()), key=repr)
    monkeypatch.setattr(dc, "INDEX_WORDS", 10_000)
    one = {x["doc_id"]: x for x in dc.match(docs, more).collect()}
    assert parts == one and all((one[i]["n_words"], one[i]["n_hit"], one[i]["items"]) == brute_hits(t, [tuple(x) for x in more.collect()]) for i, t in enumerate(texts))
    assert cut == sorted(map(tuple, dc.decontaminate(docs, more, max_coverage=0.9).select("doc_id", "text", "runs").collect()), key=repr)
    assert {x["n_hit"] for x in dc.match(docs, bench.limit(0)).collect()} == {0}
    assert dc.match(docs.limit(0), bench).count() == 0


def test_decontaminate_cuts_spans_and_drops_covered_documents(spark):
    r = random.Random(6)
    item = prose(r, 20)
    texts = [prose(r, 60), "Start of it, " + prose(r, 40) + "\n" + item + ". tail", item, None, ""]
    docs = clashing(documents(spark, texts), ["key", "hit"])
    out = {x["doc_id"]: x for x in dc.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert set(out) == {0, 1, 3, 4} and out[0]["text"] == texts[0] and out[3]["text"] is None and out[4]["text"] == ""
    assert out[1]["text"] == texts[1].replace(item, "") and out[1]["hit"] == "x"


# 3. Licences


def test_licences_by_rules(spark):
    s = licenses.SENTENCES
    apache = f"{s['apache-notice']}\n{s['apache-copy']}\n\n{s['apache-unless']} {s['apache-see']}"
    bsd = f"{s['bsd-grant']}\n1. {s['bsd-source']}\n2. {s['bsd-binary']}\n"
    texts = [
        "some words\nReleased under the MIT License.\nmore",
        apache.replace(" governing ", "\n governing "),
        bsd,
        bsd + "3. " + s["bsd-names"],
        f"{s['mit-notice']} {s['mit-grant']}",
        f"{s['gpl-3-line']} Then. {s['cc-by-nc-line']}",
        "A licence of my own. No warranty at all.",
        None,
        "",
        "Licensed under the MIT License" + "!" * 100_000,
    ]
    out = {x["doc_id"]: x for x in licenses.licenses(clashing(documents(spark, texts), ["key", "sentences", "sequence"])).collect()}
    assert out[0]["licenses"] == ["MIT"] and out[0]["sentences"] == ["mit-line"]
    assert out[1]["licenses"] == ["Apache-2.0"]
    assert out[2]["licenses"] == ["BSD-2-Clause"] and out[3]["licenses"] == ["BSD-3-Clause"]
    assert out[4]["licenses"] == [] and out[4]["sentences"] == ["mit-notice"] + out[4]["sentences"][1:]
    assert out[5]["licenses"] == ["CC-BY-NC-4.0", "GPL-3.0"]
    assert all(out[i]["licenses"] == [] and out[i]["sentences"] == [] for i in (6, 7, 8))
    assert out[9]["licenses"] == ["MIT"]
    assert licenses.licenses(documents(spark, [])).count() == 0


def test_every_known_sentence_has_a_trigger_and_a_rule():
    rules = {x for _, rule in licenses.RULES for x in rule}
    assert rules == set(licenses.SENTENCES) and len(licenses.KNOWN) == len(licenses.SENTENCES)
    for sentence in licenses.SENTENCES.values():
        assert any(t in sentence.lower() for t in licenses.TRIGGERS)


def brute_sentences(text):
    """Known sentences between borders, by a walk over the words and what stands between them."""
    lines = [re.sub(r"^[ \t]*(#+|//+|/?\*+/?|;+|--+|%+|[-•]|\(?[0-9a-z]{1,2}\))([ \t]+|$)", "", x) for x in text.lower().split("\n")]
    pieces = re.split("([a-z0-9]+)", "\n".join(lines))
    words, gaps = pieces[1::2], pieces[::2]

    def kind(gap):
        if re.search(r"[.!?][ \t\r\n\f]|\n[ \t\r\f]*\n", gap):
            return 2
        return 1 if "\n" in gap or re.search(r":[ \t\r\f]", gap) else 0

    border = [2, *[kind(g) for g in gaps[1:-1]], 2]
    denied = ("not", "never", "nor", "neither", "without", "longer")
    known = sorted(((k.split(" "), name) for k, name in licenses.KNOWN.items()), key=lambda k: -len(k[0]))
    out, i = [], 0
    while i < len(words):
        begins = border[i] == 2 or border[i] and words[i - 1] not in denied
        fits = next(
            ((k, name) for k, name in known if begins and words[i : i + len(k)] == k and border[i + len(k)] and 2 not in border[i + 1 : i + len(k)]),
            None,
        )
        out += [fits[1]] if fits else []
        i += len(fits[0]) if fits else 1
    return out


def test_wrapped_and_commented_sentences_are_found(spark):
    s, r = licenses.SENTENCES, random.Random(31)

    def wrapped(text, mark, width):
        return "\n".join(f"{mark}{x}" for x in textwrap.wrap(text, width))

    apache = ["Copyright 2020 Me", f"{s['apache-notice']}", s["apache-copy"], s["apache-unless"] + " " + s["apache-see"]]
    texts = [f"\n{mark.strip()}\n".join(wrapped(x, mark, 70) for x in apache) for mark in ("# ", " * ", "// ", "", "-- ")]
    texts += [f"MIT License\n{wrapped(s['mit-grant'], '', 60)}\n\n{wrapped(s['mit-notice'], '', 60)}"]
    for _ in range(80):
        picked = [s[n] for n in r.sample(sorted(s), r.randint(1, 4))]
        parts = [wrapped(x, "", r.randint(20, 90)) for x in ["Some words", *picked]]
        between = [r.choice(("\n", "\n\n", " and ", ": ", ". ", " - ", "\n- ", "\n1) ", " not\n", " never ")) for _ in parts[1:]]
        body = parts[0] + "".join(g + x for g, x in zip(between, parts[1:]))
        mark = r.choice(("# ", "", "* "))
        texts.append("\n".join(mark + x for x in body.split("\n")))
    out = {x["doc_id"]: x for x in licenses.licenses(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert out[i]["sentences"] == brute_sentences(text), text
    assert all(out[i]["licenses"] == ["Apache-2.0"] for i in range(5)) and out[5]["licenses"] == ["MIT"]
    other = licenses.licenses(documents(spark, ["This work is licensed under the GNU General Public License, version 2.1 of mine"])).head()
    assert other["sentences"] == []


def test_what_is_said_of_a_licence_is_no_licence(spark):
    texts = [
        "This file is not licensed under the MIT License and must not be copied.",
        "This file is not\nlicensed under the MIT License.",
        "It was never Released under the MIT License.",
        "// It is no longer\n// licensed under the MIT License.",
        "We ask: is it Licensed under the MIT License",
        "Not all files count. Licensed under the MIT License.",
        "Licence: Licensed under the MIT License.",
        "# not\n#\n# Licensed under the MIT License.",
    ]
    out = {x["doc_id"]: x["licenses"] for x in licenses.licenses(documents(spark, texts)).collect()}
    assert [out[i] for i in range(8)] == [[]] * 5 + [["MIT"]] * 3


def test_wrapped_sentences_pass_the_prefilter(spark):
    texts = [s.replace(" ", gap) for gap in ("\n", "  ") for s in licenses.SENTENCES.values()]
    out = {x["doc_id"]: x["sentences"] for x in licenses.licenses(documents(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == [[name] for name in licenses.SENTENCES] * 2


# 8. Line de-duplication


def brute_lines(texts, least):
    split = [(t or "").split("\n") for t in texts]
    keys = [[lowered(x.strip(" \t\n\x0b\x0c\r")) for x in p] for p in split]
    seen = collections.Counter(k for p in keys for k in set(p) if k)
    return [(len(p), "\n".join(x for x, k in zip(p, ks) if seen[k] < least)) for p, ks in zip(split, keys)]


def test_lines_of_many_documents_go(spark):
    r = random.Random(8)
    pool = ["Menu", " menu\t", "MENU", "é", "É", "", "  ", "a\rb", "long " * 50]
    texts = ["\n".join(r.choices(pool + [prose(r, 3)], k=r.randint(0, 6))) for _ in range(60)]
    texts += [None, "", "Menu", "Menu", "\n", "x" * 300_000 + "\nMenu", "\n".join(f"l{i}" for i in range(40_000)) + "\nMenu"]
    texts += ["\n".join(f"l{i}" for i in range(5_000))] * 5
    docs = clashing(documents(spark, texts), ["doc", "kept", "hash", "gone"])
    out = lines.drop_frequent_lines(docs, 5)
    found = {x["doc"]["doc_id"]: (x["n_lines"], x["kept"]) for x in out.collect()}
    expected = brute_lines(texts, 5)
    assert [found[i] for i in range(len(texts))] == expected
    assert all(x["n_dropped"] == x["n_lines"] - (x["kept"].count("\n") + 1 if x["kept"] or x["n_lines"] > x["n_dropped"] else 0) for x in out.collect())
    assert lines.drop_frequent_lines(documents(spark, [])).count() == 0


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    rows = [(1, "a\nb", None, None, None)] * 3 + [(None, "a\nc", None, None, None)] * 2
    out = lines.drop_frequent_lines(spark.createDataFrame(rows, SCHEMA), 5).collect()
    assert sorted(x["kept"] for x in out) == ["b", "b", "b", "c", "c"]


def test_runs_are_compacted_and_find_what_is_new(spark):
    runs, seen = lines.LineRuns(spark, fanout=2), set()
    for batch in (["a\nb", "b"], ["b\nc"], [None, ""], ["c\nd\nA"]):
        fresh = lines.add_new_lines(runs, documents(spark, batch))
        new = {k for t in batch for k in lowered(t or "").split("\n") if k} - seen
        assert {x["hash"].hex() for x in fresh.collect()} == {hashlib.md5(k.encode()).hexdigest() for k in new}
        seen |= new
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    counts = {x["hash"].hex(): x["n_docs"] for x in runs.counts().collect()}
    assert counts == {hashlib.md5(k.encode()).hexdigest(): n for k, n in {"a": 2, "b": 3, "c": 2, "d": 1}.items()}


def test_a_batch_meets_the_runs_without_a_shuffle(spark):
    runs = lines.LineRuns(spark, fanout=9)
    for batch in (["a\nb"], ["b\nc"], ["d"]):
        lines.add_new_lines(runs, documents(spark, batch))
    some = spark.range(50).select(F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("hash")).groupBy("hash").agg(F.count("*").alias("n_docs"))
    counted = spark.table(runs._write(some, "batch"))
    plan = runs.unseen(counted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Sort [" not in plan
    # What later batches add is counted, and compaction keeps the runs apart from each other.
    assert sum(spark.table(n).count() for n in runs.runs()) == 4 and sum(spark.table(n).count() for n in runs.added) == 1


def test_lines_that_come_in_several_batches_have_one_count(spark):
    texts = [f"line {n}\nrow {i} of {n}" for n in range(40) for i in range(8 + n % 4)]
    out = lines.drop_frequent_lines(documents(spark, texts)).collect()
    assert {x["doc"]["doc_id"]: (x["n_lines"], x["kept"]) for x in out} == dict(enumerate(brute_lines(texts, 10)))
    runs = lines.LineRuns(spark)
    for batch in (["a\nb"], ["b\nc"], ["b\nc"], ["a\nb\nc"], ["b"]):
        lines.add_new_lines(runs, documents(spark, batch))
    assert sorted(x["n_docs"] for x in runs.counts().collect()) == [2, 3, 5]


# 6. Order MinHash


def edited(r, text, share):
    return " ".join(w if r.random() > share else prose(r, 1) + "x" for w in text.split())


def alike(a, b):
    """Longest common subsequence of labelled shingles by the plain quadratic table."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    row = [0] * (m + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], max(row[j], row[j - 1], left + (x == y))
    return row[m] / (n + m - row[m])


def brute_classes(texts):
    shingled = []
    for t in texts:
        w, seen = words(t), collections.Counter()
        own = []
        for i in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[i : i + 5])
            own.append((s, seen[s]))
            seen[s] += 1
        shingled.append(own)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        same = words(texts[i]) == words(texts[j]) if shingled[i] or shingled[j] else (texts[i] or "") == (texts[j] or "")
        if same or alike(shingled[i], shingled[j]) >= 0.8 - 1e-9:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_similarity_equals_the_quadratic_table():
    r = random.Random(11)
    for _ in range(60):
        text = prose(r, r.randint(1, 60))
        other = edited(r, text, 0.04) if r.random() < 0.8 else " ".join(r.sample(text.split(), len(text.split())))
        column = words_of(pa.array([text, other]))
        a, b = om._elements(column, 0), om._elements(column, 1)
        want = alike(a.tolist(), b.tolist())
        assert om.similarity(a, b) == pytest.approx(want if want >= 0.6 else 0.0)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(om, "BLOCK_ROWS", 4)  # several blocks a group
    r = random.Random(12)
    head = prose(r, 30)
    texts = [None, "", "", "!!", "one", "One!", "a b c d e", "a b c d e f", "z " * 40, "z " * 41, "z " * 90]
    for _ in range(6):
        base = prose(r, r.randint(20, 120))
        texts += [base, base.upper()] + [edited(r, base, 0.03) for _ in range(6)] + [edited(r, base, 0.2)]
    chain = prose(r, 100).split()
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 20, 4)]
    texts += [head + " " + prose(r, 8) for _ in range(12)]
    docs = clashing(documents(spark, texts), ["id", "bands", "same", "class_id"])
    found = {x["doc_id"]: x for x in om.near_duplicates(docs).collect()}
    expected = brute_classes(texts)
    assert [found[i]["class_id"] for i in range(len(texts))] == expected
    assert all(found[i]["kept"] == (expected[i] == i) for i in range(len(texts)))
    assert om.near_duplicates(documents(spark, [])).count() == 0


def test_repeated_ids_are_one_document_by_one_of_their_texts(spark):
    r = random.Random(17)
    a, b = prose(r, 60), prose(r, 60)
    rows = [(1, a), (2, a), (2, b), (3, b), (3, a), (4, edited(r, b, 0.02)), (5, edited(r, a, 0.02)), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    told = {i: min((t for k, t in rows if k == i), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for i in range(1, 6)}
    found = {x["doc_id"]: x["class_id"] for x in om.near_duplicates(docs).collect()}
    assert [found[i] for i in range(1, 6)] == [x + 1 for x in brute_classes([told[i] for i in range(1, 6)])]


def test_components_equal_brute_force(spark):
    r = random.Random(13)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    ends = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    out = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {x["node"]: x["component"] for x in out.collect()} == {x: root(x) for x in ends}
    assert out.count() == len(ends)


# 10. Packing


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")


def test_plans_use_every_piece_and_few_sequences():
    r = random.Random(14)
    for n in (0, 1, 7, 200, 20_000):
        counts = collections.Counter(r.choice((r.randint(1, 100), r.randint(1, 1024), 700, 1024)) for _ in range(n))
        made, back = packing.plan(counts), collections.Counter()
        for held, times in made:
            assert sum(held) <= 1024 and times > 0
            for length in held:
                back[length] += times
        assert back == counts
        assert sum(times for _, times in made) <= 1.03 * sum(l * c for l, c in counts.items()) / 1024 + 1 + counts[700] or n < 20_000


def test_pieces_and_places(spark, vocabulary):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    r = random.Random(15)
    texts = [None, "", "a", prose(r, 900), prose(r, 3000), "<|endoftext|> and so on", "日本語   \x1c ١٢ ǅ", "é" * 30, prose(r, 5), prose(r, 5)]
    texts += ["z" * 20_000, "it's I'll 123 !!  \n\n x"]
    docs = clashing(documents(spark, texts), ["piece", "key", "start"])
    out = packing.pack(packing.pieces(docs, vocabulary)).collect()
    by_doc = collections.defaultdict(list)
    for x in out:
        by_doc[x["doc_id"]].append(x)
    for i, text in enumerate(texts):
        ids = exact.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda x: x["piece"])
        assert [x["piece"] for x in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        at = 0
        for x in own:
            assert x["start"] == at and (x["length"] == 1024 or x["piece"] == 0)
            assert x["ids_crc32"] == zlib.crc32(np.array(ids[at : at + x["length"]], "<u4").tobytes())
            at += x["length"]
        assert at == len(ids)
    check_places(out)
    assert packing.pack(packing.pieces(documents(spark, []), vocabulary)).count() == 0


def check_places(rows):
    held = collections.defaultdict(list)
    for x in rows:
        held[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held)


def test_repeated_rows_get_places_of_their_own(spark):
    rows = spark.createDataFrame([(1, 0, 0, 300, 7)] * 50 + [(2, 0, 0, 1024, 9)] * 3, "doc_id int, piece int, start bigint, length bigint, ids_crc32 bigint")
    out = packing.pack(rows).collect()
    assert len(out) == 53 and check_places(out) == 17 + 3


# 9. Personal data


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.fixture(scope="module")
def judge():
    return pii.fit(*pii.made_examples(1500))


def test_base_spans_equal_the_patterns(spark, judge):
    r = random.Random(16)
    texts = ["".join(r.choices("a1.@-+ ()x9%_0\n5é", k=50)) for _ in range(400)]
    texts += [None, "", "ü x.1@b.co, 4111 1111 1111 1111 / 1.2.3.4 +1 (234) 567-8901"]
    out = {x["doc_id"]: x for x in pii.personal_data(clashing(documents(spark, texts), ["key", "base"]), judge).collect()}
    for i, text in enumerate(texts):
        want = [f"{k}:{s}:{e}" for k, s, e in brute_spans(text or "")]
        assert out[i]["base"] == want and set(want) <= set(out[i]["spans"])
    assert pii.personal_data(documents(spark, []), judge).count() == 0


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "+1" + "(" * 100_000, "1 " * 100_000, "1.2.3." * 30_000, "1.2.3." + "0" * 10_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_added_spans_are_likely_ones(judge):
    rows, labels = pii.made_examples(1500, seed=99)
    chosen = [judge.selects(x) for x in rows]
    right = sum(c and y for c, y in zip(chosen, labels))
    assert right >= 0.97 * sum(chosen) and right >= 0.7 * sum(labels)
    text = "write to jo.doe (at) mail (dot) example now, order 2024-10-12"
    found = pii.added(judge, text, pii.base_spans(text))
    assert [text[s:e] for _, s, e in found] == ["jo.doe (at) mail (dot) example"]


def brute_numbers(text):
    """Every stretch of whole digit groups, tried at all pairs of places."""
    out = set()
    for s, e in itertools.combinations(range(len(text) + 1), 2):
        body, before, after = text[s:e], text[s - 1 : s] if s else "", text[e : e + 1]
        if not re.fullmatch(r"\(?[0-9]+(?:(?:\)[ ./\-–_]{0,2}\(?|[ ./\-–_]{1,2}\(?|\()[0-9]+)*", body):
            continue
        if re.match("[0-9A-Za-z+]", before) or re.match("[0-9A-Za-z]", after):
            continue
        if before == "(" != body[0] and not (s > 1 and re.match("[0-9A-Za-z+]", text[s - 2])):
            continue  # the bracket belongs to it
        n = sum(c in "0123456789" for c in body)
        out |= {("card", s, e)} if 12 <= n <= 19 else set()
        out |= {("phone", s, e)} if 7 <= n <= 15 else set()
    return out


def test_every_run_of_digit_groups_is_proposed():
    r = random.Random(29)
    pieces = ["1", "22", "333", "4444", "55555", "1234567", " ", "-", ".", "/", "(", ")", "+", "x", " ", "-", "é"]
    for _ in range(600):
        text = "".join(r.choices(pieces, k=r.randint(3, 16)))
        found = list(pii._numbers(text))
        assert len(found) == len(set(found)) and set(found) == brute_numbers(text), text
    assert ("phone", 0, 23) in pii.candidates("1 2 3 4 5 6 7 8 9 0 1 2")


def test_neighbouring_numbers_are_found():
    judge = pii.fit(*pii.made_examples(pii.MADE_ROWS))
    card = "4111.1111.1111.1111"
    for text, kind, bodies in (
        ("call (555) 123-4567 (555) 123-9999 now", "phone", ["(555) 123-4567", "(555) 123-9999"]),
        ("call 555-123-4567 555-123-9999 now", "phone", ["555-123-4567", "555-123-9999"]),
        ("tel. 2024-05-01 555-123-4567", "phone", ["555-123-4567"]),
        (f"card: {card} 12/26 123", "card", [card]),
    ):
        places = [(kind, text.index(b), text.index(b) + len(b)) for b in bodies]
        assert set(places) <= set(pii.candidates(text))
        assert sorted(pii.added(judge, text, pii.base_spans(text))) == places, text


def test_parts_of_a_base_span_are_no_examples_of_it():
    text = "4111 1111 1111 1111 and +1 (234) 567-8901"
    told = pii._closest(pii.candidates(text), pii.base_spans(text))
    assert sorted(text[s:e] for _, s, e in told) == ["(234) 567-8901", "4111 1111 1111 1111"]


def test_training_takes_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(pii, "MADE_ROWS", 400)
    texts = [f"call +1 (234) 567-89{i:02d} or 4111 1111 1111 11{i:02d}" for i in range(40)] + [None, ""]
    rows, labels = pii.training_rows(documents(spark, texts), "doc_id", "text")
    assert set(labels) == {0, 1} and len(rows) <= pii.SAMPLE_ROWS
    assert pii.train(documents(spark, texts)).selects is not None


def test_packing_never_takes_more_than_best_fit_decreasing():
    import bisect
    from collections import Counter

    from colloquy.llm import packing

    def best_fit(lengths, size=1024):
        rooms, n = [], 0
        for length in sorted(lengths, reverse=True):
            i = bisect.bisect_left(rooms, length)
            room = rooms.pop(i) if i < len(rooms) else size
            n += room == size
            if room > length:
                bisect.insort(rooms, room - length)
        return n

    r = random.Random(41)
    cut = lambda x: min(1024, max(1, int(x)))
    draws = [
        lambda: r.randint(1, 1024), lambda: cut(r.expovariate(1 / 500)), lambda: cut(r.lognormvariate(5.5, 1)),
        lambda: r.randint(129, 512), lambda: r.randint(330, 345), lambda: r.choice([300, 400, 725, 1000, 1024]),
    ]
    for draw in draws:
        lengths = [draw() for _ in range(8000)]
        made, used = packing.plan(dict(Counter(lengths))), Counter()
        for sequence, n in made:
            assert sum(sequence) <= 1024
            for length in sequence:
                used[length] += n
        assert used == Counter(lengths) and sum(n for _, n in made) <= best_fit(lengths)


def test_packing_keeps_columns_of_any_name(spark):
    from colloquy.llm import packing

    r = random.Random(42)
    names = ["part", "low", "high", "per", "base", "at", "rank", "skipped", "row", "key", "offset"]
    rows = [(i, 0, 0, i, r.randint(1, 1024), *[f"{n}{i}" for n in names]) for i in range(500)]
    ddl = "doc_id bigint, piece int, start bigint, ids_crc32 bigint, length bigint, " + ", ".join(f"`{n}` string" for n in names)
    got = packing.pack(spark.createDataFrame(rows + rows[:3], ddl)).collect()
    assert len(got) == 503
    ends = {}
    for x in got:
        assert all(x[n] == f"{n}{x['doc_id']}" for n in names[:-1])
        ends.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for held in ends.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(ends) == list(range(len(ends)))


def plain_added(judge, text, base):
    """Every candidate scored by itself."""
    rows = [(span, pii.features(text, span)) for span in pii._apart(pii._candidates(text), base)]
    out, taken = [], set()
    for _, span in sorted(((-judge.probability(x), s) for s, x in rows if judge.selects(x)), key=lambda v: (round(v[0], 12), v[1][1], v[1])):
        if taken.isdisjoint(range(span[1], span[2])):
            taken.update(range(span[1], span[2]))
            out.append(span)
    return out


def test_number_tables_equal_single_candidates(judge):
    r = random.Random(51)
    pieces = ["1", "22", "333", "4444", "55555", "1234567", "2024", "19", "0", "00", " ", "-", ".", "/", "(", ")", "+", "x", " ", "- ", "é", "call ", "order ", "card: ", "\n", "_", "–"]
    for n in range(500):
        text = "".join(r.choices(pieces, k=r.randint(3, 60)))
        tables = list(pii.number_tables(text, r.choice((3, 7, 4096))))
        got = {(pii.KINDS[int(x[0])], int(b), int(e)): x.tolist() for begin, end, rows in tables for b, e, x in zip(begin, end, rows)}
        want = {span: list(map(float, pii.features(text, span))) for span in pii._numbers(text)}
        assert got == want, text
        if want:
            x = np.array(list(want.values()))
            assert np.allclose(judge.probabilities(x), [judge.probability(v) for v in want.values()], rtol=1e-12, atol=0)
        base = pii.base_spans(text)
        assert sorted(pii.added(judge, text, base)) == sorted(plain_added(judge, text, base))


def test_number_tables_of_any_length_take_linear_time(judge):
    import time

    r = random.Random(52)
    text = " ".join(str(r.randrange(10)) for _ in range(100_000))
    started = time.process_time()
    pii.added(judge, text, [])
    assert time.process_time() - started < 15
