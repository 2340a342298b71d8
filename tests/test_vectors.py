"""Fitted term weights and the inverted-file index."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import vectors as vx
from colloquy.operators import idf, vector_index as vi
from colloquy.operators import retrieval as rt
from colloquy.session import new_path


def table(spark, key, rows):
    return spark.createDataFrame([(f"{key[0]}{i}", r.tolist()) for i, r in enumerate(rows)], f"{key} string, vector array<double>").repartition(4)


def recall(found, exact):
    return rt.recall(found, exact).first()["recall"]


def test_clustered_vectors_are_found_with_few_pairs(spark, tmp_path):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(60, 64))
    rows = middle[rng.integers(60, size=6000)] + 0.35 * rng.normal(size=(6000, 64))
    items, queries = table(spark, "item_id", rows), table(spark, "query_id", rows[:80] + 0.1 * rng.normal(size=(80, 64)))
    vi.build_index(items).save(str(tmp_path / "index"))
    index = vi.VectorIndex.load(spark, str(tmp_path / "index"))
    assert index.entries.count() == 6000
    share = vi.scored_share(index, queries)
    found = vi.search_index(index, queries, items)
    assert share <= 0.2 and recall(found, rt.search(queries, items)) >= 0.9
    print("clustered", share, recall(found, rt.search(queries, items)))


def test_random_vectors_need_more_probes(spark):
    """Without clusters the cells tell little: recall is bought with pairs."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 64))
    items, queries = table(spark, "item_id", rows), table(spark, "query_id", rng.normal(size=(40, 64)))
    index, exact = vi.build_index(items), rt.search(queries, items)
    cells = len(index.centres)
    few, many = (recall(vi.search_index(index, queries, items, probes=p, reranked=600), exact) for p in (cells // 10, cells))
    print("random", few, many, vi.scored_share(index, queries, cells // 10))
    assert many >= 0.9 > few


def test_odd_rows_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 100)
    rows = [(f"i{k:04d}", [1.0, 0.0, 0.0]) for k in range(1500)] + [("far", [0.0, 1.0, 0.0]), ("zero", [0.0, 0.0, 0.0])]
    rows += [("none", None), ("empty", []), (None, [1.0, 0.0, 0.0])]
    items = spark.createDataFrame(rows, "item_id string, vector array<double>")
    queries = spark.createDataFrame([("q", [0.0, 2.0, 0.0]), ("p", [1.0, 0.1, 0.0]), ("n", None)], "query_id string, vector array<double>")
    index = vi.build_index(items, cells=2)
    assert index.entries.count() == 1502
    got = vi.search_index(index, queries, items, k=3, probes=len(index.centres)).collect()
    assert [(r["item_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == "q"][0] == ("far", 1)
    assert len({r["item_id"] for r in got if r["query_id"] == "p"}) == 3 and {r["query_id"] for r in got} == {"p", "q"}
    nothing = vi.build_index(items.limit(0))
    assert vi.search_index(nothing, queries, items).count() == 0 and vi.scored_share(nothing, queries) == 0.0


def test_weights_are_fitted_once_and_kept(spark):
    texts = spark.createDataFrame([(1, "the cat"), (2, "the dog the"), (3, None), (4, ""), (5, "the")], "id int, text string")
    path = new_path(spark, "idf")
    assert idf.last_version(spark, path) is None
    assert idf.write_idf(idf.fit_idf(texts), path) == 1
    assert idf.write_idf(idf.fit_idf(texts.where("id = 1")), path) == 2
    weights = sorted(r["idf"] for r in idf.read_idf(spark, path, 1).collect())
    assert weights == pytest.approx([0.0, math.log(2), math.log(2)]) and idf.read_idf(spark, path).count() == 2
    rows = {r["id"]: r["vector"] for r in idf.embed_idf(texts, idf.read_idf(spark, path, 1)).collect()}
    assert rows[3] is None and rows[4] is None and not any(rows[5])
    # "the" is in all texts and weighs nothing, so only the other word shows.
    assert sorted(map(abs, rows[1]))[-2:] == [0.0, 1.0] and sorted(map(abs, rows[2]))[-2:] == [0.0, 1.0]
    unseen = idf.embed_idf(texts.select(F.lit("bird the").alias("text")).limit(1), idf.read_idf(spark, path, 1)).first()["vector"]
    assert sorted(map(abs, unseen))[-1] == pytest.approx(1.0)
    empty = idf.embed_idf(texts, idf.fit_idf(texts.limit(0)))
    assert empty.where("id = 1").first()["vector"] is not None


def test_hashed_vectors_equal_the_expression(spark):
    tokens = [["a", "b", "a", "é"], [], None, [""], [f"w{i % 700}" for i in range(5000)]] * 3
    table = spark.createDataFrame(list(enumerate(tokens)), "i int, t array<string>").coalesce(1)
    rows = table.select("t", vx.hashed_vectors(F.col("t"), 16).alias("v"), vx.hashed_terms(F.col("t"), 16).alias("u")).collect()
    assert len(rows) == 15 and all((r.v is None) == (not r.t) for r in rows)
    assert all(np.allclose(r.v, r.u) for r in rows if r.t)
