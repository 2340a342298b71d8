"""Suffix runs, ranked search and whitening, each against a plain version."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from colloquy.llm import lexical_search as ls
from colloquy.llm import suffix_runs as sr
from colloquy.llm import whitening as wh
from colloquy.llm.catalog import ORACLES, QUERIES

# 11. Suffix runs


def plain_spans(texts):
    """Maximal covered runs of every text, from all its strings."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + sr.LENGTH] for t in raw for i in range(len(t) - sr.LENGTH + 1))
    out = []
    for t in raw:
        spans = []
        for i in range(len(t) - sr.LENGTH + 1):
            if seen[t[i : i + sr.LENGTH]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + sr.LENGTH
                else:
                    spans.append([i, i + sr.LENGTH])
        out.append(spans)
    return out


def plain_removal(texts):
    out = []
    for text, spans in zip(texts, plain_spans(texts)):
        raw, kept, at = (text or "").encode(), b"", 0
        for begin, end in spans:
            kept, at = kept + raw[at:begin], end
        kept += raw[at:]
        out.append((len(raw), len(raw) - len(kept), len(spans), kept))
    return out


@pytest.fixture()
def small_parts(monkeypatch):
    """Many targets, runs, blocks and batches, in the workers, too."""
    for name, value in {"TARGET_BYTES": 6_000, "RUN_RECORDS": 40, "BLOCK_RECORDS": 7, "BATCH_RECORDS": 8, "BUFFER_BYTES": 3_000}.items():
        monkeypatch.setattr(sr, name, value)
    cloudpickle.register_pickle_by_value(sr)
    yield
    cloudpickle.unregister_pickle_by_value(sr)


def prose(rng, n):
    return "".join(rng.choice("abcdefgh é\n") for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    shared = [prose(rng, n) for n in (395, 401, 430, 600, 1500)]
    texts = [None, "", "short", "a" * 399, "a" * 400, "a" * 2500, "ab" * 900, "xyz" * 200]
    texts += [prose(rng, rng.randint(0, 900)) + rng.choice(shared) + prose(rng, rng.randint(0, 900)) for _ in range(40)]
    # Two partners that share more on one side each, and overlapping repeats in one text.
    left, right = prose(rng, 300), prose(rng, 300)
    middle = prose(rng, 150)
    texts += [left + middle + right, left + middle + prose(rng, 300), prose(rng, 300) + middle + right]
    texts += [left[200:] + middle + right[:160] + prose(rng, 9), shared[3] + shared[3][100:] + shared[3][50:500]]
    texts += [texts[9]] * 3 + [shared[4][:700], shared[4][350:]]
    return texts


def test_removal_equals_all_strings(spark, small_parts):
    texts = odd_texts()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    # Column names of the operator's own, to clash with.
    docs = spark.createDataFrame(rows, "key int, text string, spans string").repartition(6)
    got = sr.remove_repeats(docs).select("doc.key", "doc.spans", "n_bytes", "n_removed", "n_spans", "kept").collect()
    want = plain_removal(texts)
    assert sorted((r[0], r[2], r[3], r[4], bytes(r[5])) for r in got) == sorted((i, *w) for i, w in enumerate(want))


def test_hot_passage_over_many_batches(spark, small_parts):
    """One passage in most texts, between text that differs, and near its edges as well."""
    rng = random.Random(6)
    passage = prose(rng, 470)
    texts = [prose(rng, 60) + rng.choice("pq") * rng.randint(0, 2) + passage[rng.randint(0, 3) :] + prose(rng, 60) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    got = {r["doc"]["doc_id"]: r for r in sr.remove_repeats(docs).collect()}
    for i, want in enumerate(plain_removal(texts)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == want


def test_texts_are_shuffled_once_with_their_rows(spark, capsys):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, prose(rng, 500)) for i in range(3)], "doc_id int, text string")
    sr.remove_repeats(docs).explain()
    cut_out = [line for line in capsys.readouterr().out.splitlines() if " AS t#" in line]
    assert cut_out and all("doc#" in line.split(" AS t#")[0].rsplit("[", 1)[1] for line in cut_out)


def test_no_text(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert sr.remove_repeats(docs).count() == 0


def test_equal_strings_have_equal_anchors():
    rng = random.Random(7)
    one = prose(rng, 900)
    texts = [prose(rng, 321) + one, prose(rng, 77) + one + "z"]
    places = []
    for text in texts:
        at = text.encode().index(one.encode())
        found = {}
        for _, place, suffix, left in sr.records_of(pa.array([text])):
            for k in range(len(left) + len(suffix) - sr.LENGTH + 1):
                found[place + k - at] = place + len(left) - at
        assert len(found) == len(text.encode()) - sr.LENGTH + 1
        places.append({p: a for p, a in found.items() if 0 <= p <= len(one.encode()) - sr.LENGTH})
    assert places[0] == places[1]


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(8)
    words = sorted(("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) * rng.randint(1, 9)).encode()[: sr.LENGTH] for _ in range(400))
    records = [(w, bytes([i % 250]) * 16, i, b"left" * (i % 3), i % 2) for i, w in enumerate(words)]
    for k in (1, 2, 3, 7):
        runs = [[] for _ in range(k)]
        for r in records:
            rng.choice(runs).append(r)
        coded = []
        for run in runs:
            run.sort()
            shared = sr.shared_prefixes([r[0] for r in run])
            coded.append(sr.decode([sr.encode(run[i : i + 5], shared[i : i + 5]) for i in range(0, len(run), 5)]))
        merged = list(sr.LoserTree(coded))
        assert [m[:5] for m in merged] == sorted(records)
        assert [m[5] for m in merged] == sr.shared_prefixes([m[0] for m in merged]).tolist()
    assert list(sr.LoserTree([])) == []


# 12. Ranked search


def plain_search(docs, items, top=10):
    words = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

    def terms(text):
        return words.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    held = [(doc_id, collections.Counter(terms(t))) for doc_id, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, counts, n in held:
            m = 25 + (75 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in terms(text) if counts[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:top])]
    return out


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ΔX", "né", "İI"]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 65), k=rng.choice([1, 5, 40, 300])))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "-- ??"), (None, "w1 w2 W3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (404, "hot " * 3000 + "w5")]
    docs += [(500 + i, "w1 w2 W3") for i in range(15)]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(15)] + [(20, None), (21, ""), (22, "absent"), (23, "w1 w2 w3"), (23, "hot hot")]
    return docs, items


def test_search_equals_scoring_all(spark):
    docs, items = corpus()
    found = ls.search(
        spark.createDataFrame([(*d, "c") for d in docs], "doc_id int, text string, key string").repartition(5),
        spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, rank int"),
        "doc_id",
    )
    got = found.select("item.item_id", "rank", "doc.doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_search(docs, items), key=repr)


def test_search_in_groups_and_with_a_kept_index(spark, monkeypatch):
    docs, items = corpus()
    left = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(ls, "GROUP_ITEMS", 4)
    found = ls.search(left, right, "doc_id", top=3, index=ls.durable(ls.build_index(left), "kept"))
    got = found.select("item.item_id", "rank", "doc.doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_search(docs, items, 3), key=repr)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    assert ls.search(none, some, "doc_id").count() == 0 and ls.search(some, none, "doc_id").count() == 0


def test_bounds_are_bounds_and_exclude(spark):
    docs, items = corpus()
    held = [(d, collections.Counter(ls.terms_of(t.encode()))) for d, t in docs if t and ls.terms_of(t.encode())]
    df = collections.Counter(t for _, c in held for t in c)
    queries = ls.Queries([t for _, t in items], dict(df), len(held), sum(sum(c.values()) for _, c in held))
    frame = spark.createDataFrame(docs, "doc_id int, text string").coalesce(1)
    by_key = {hashlib.md5(t.encode()).digest(): collections.Counter(ls.terms_of(t.encode())) for _, t in docs if t is not None}
    asked = excluded = 0
    for row in ls.build_index(frame).where("bits is not null").collect():
        lengths = np.frombuffer(row["lengths"], np.int64)
        bounds = queries.bounds(row["rows"], lengths, np.frombuffer(row["bits"], np.uint8).reshape(row["rows"], -1))
        for d, n in enumerate(lengths):
            counts = by_key[bytes(row["keys"][16 * d : 16 * d + 16])]
            for item in range(len(items)):
                score = queries.score(item, counts, queries.norm(int(n)))
                assert bounds[item, d] >= score
                asked, excluded = asked + 1, excluded + int(bounds[item, d] <= 2 * score)
    assert excluded > 0.8 * asked


# 13. Whitening


def test_components_equal_dense_ones():
    rng = np.random.default_rng(1)
    for d in (1, 2, 7, 40, 90):
        a = rng.normal(size=(2 * d + 3, d)) * np.exp(rng.normal(size=d))
        v = np.cov(a.T, bias=True).reshape(d, d)
        values, vectors = wh.components_of(v)
        want = np.linalg.eigvalsh(v)[::-1][: wh.COMPONENTS]
        assert np.allclose(values, want, rtol=1e-11) and np.allclose(v @ vectors, vectors * values, atol=1e-12 * want[0])
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)


def test_repeated_and_missing_eigenvalues():
    v = np.eye(50)
    v[:3, :3] *= 9
    values, vectors = wh.components_of(v)
    assert np.allclose(values, [9] * 3 + [1] * 29) and np.allclose(vectors.T @ vectors, np.eye(32), atol=1e-12)
    a = np.random.default_rng(2).normal(size=(6, 30))
    assert len(wh.components_of(np.cov(a.T, bias=True))[0]) == 5
    assert len(wh.components_of(np.zeros((4, 4)))[0]) == 0


def test_inertia_counts():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    spectrum, values = wh.Spectrum(a + a.T), np.linalg.eigvalsh(a + a.T)
    shifts = rng.normal(size=50) * 8
    assert spectrum.above(shifts).tolist() == [(values > s).sum() for s in shifts]


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "row int, v array<float>, n string").repartition(4)


def test_whitening_equals_dense(spark):
    rng = np.random.default_rng(4)
    good = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 900]).astype(np.float32).tolist(), "x") for i in range(200)]
    good += [(300, good[0][1], None)] * 3
    nan, inf = float("nan"), float("inf")
    bad = [(900, None, "x"), (901, [], "x"), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0], "x"), (903, [nan] * 6, "x"), (904, [inf] + [0.0] * 5, "x"), (905, [1.0], "x"), (906, [1e30] * 6, "x")]
    got = wh.whiten(vectors_table(spark, good + bad), "v").select("row.row", "row.n", "component", "whitened", "explained", "identity_error", "deviation").collect()
    x = np.floor(64 * np.array([g[1] for g in good])).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, q = np.linalg.eigh(c.T @ c / n)
    want = np.abs(c @ q[:, ::-1] / np.sqrt(values[::-1]))
    assert len(got) == n * 6 and max(r["identity_error"] for r in got) < 1e-9
    by_row = collections.defaultdict(list)
    for r in got:
        by_row[r["row"], r["component"]].append(r)
    for i, (row, _, _) in enumerate(good):
        for k in range(6):
            for r in by_row[row, k + 1]:
                assert abs(abs(r["whitened"]) - want[i, k]) < 1e-8 and r["deviation"] == ((n * x[i] - s) ** 2).sum()
                assert abs(r["explained"] - values[::-1][k] / values.sum()) < 1e-9


def test_whitening_of_little(spark):
    assert wh.whiten(vectors_table(spark, [(1, [1.0, 2.0], "x")]), "v").count() == 0
    assert wh.whiten(vectors_table(spark, []), "v").count() == 0
    two = wh.whiten(vectors_table(spark, [(1, [1.0, 2.0], "x"), (2, [1.0, 4.0], "x")]), "v").collect()
    assert sorted((r["row"]["row"], round(abs(r["whitened"]), 9), r["component"]) for r in two) == [(1, 1.0, 1), (2, 1.0, 1)]


def test_exact_deviation_beyond_a_long():
    big = np.array([[2**40, 3]], dtype=object)
    assert wh._deviations(big) == [None] and wh._deviations(np.array([[2**31, 1]])) == [2**62 + 1]


def test_registered():
    for name in ("op11_suffix_dedup", "op12_ranked_search", "op13_whitening"):
        assert name in QUERIES
    assert {"op11_suffix_dedup", "op12_ranked_search"} <= set(ORACLES)
