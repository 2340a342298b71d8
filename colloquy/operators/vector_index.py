"""Approximate nearest vectors by an inverted file with product-quantised residuals.

Vectors belong to the cell of their nearest centre. What a vector differs from its centre
by is kept as one code byte for each of a few subspaces. A query looks into the cells of
the nearest centres only, scores their codes by table look-ups, and the best of them are
scored exactly from the vectors. Centres and codebooks are fitted on a bounded sample;
every vector is in the index. Cells of any size are met in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from colloquy.functions import vectors as vx
from colloquy.operators.retrieval import SCORE_DIGITS, TOP_K
from colloquy.session import durable

#: Sampled vectors for fitting; the most cells; subspaces; codewords; entries of a block.
SAMPLE, MAX_CELLS, SUBSPACES, CODEWORDS, BLOCK = 20_000, 4_096, 16, 256, 20_000
#: Share of the cells a query looks into, and approximate hits that are scored exactly.
PROBED, RERANKED = 0.1, 200
ENTRIES = "item_id string, cell int, code binary"


def k_means(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``k`` centres (or as many as there are rows), by Lloyd's rounds from far-spread rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(rows)))
    # Each start is the farthest of a few random rows from those taken before it.
    centres = rows[rng.integers(len(rows))][None]
    near = ((rows - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        some = rng.integers(len(rows), size=8)
        centres = np.vstack([centres, rows[some[near[some].argmax()]]])
        near = np.minimum(near, ((rows - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        home = nearest(rows, centres)
        sums, size = np.zeros_like(centres), np.bincount(home, minlength=k)[:, None]
        np.add.at(sums, home, rows)
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), 4096):
        part = rows[i : i + 4096]
        out[i : i + 4096] = ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)
    return out


def _units(column: pa.Array) -> np.ndarray:
    rows = np.array(column.to_pylist(), float).reshape(len(column), -1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


@dataclass
class VectorIndex:
    """Centres (cells x dim), codebooks (subspaces x codewords x width) and the entries."""

    centres: np.ndarray
    books: np.ndarray
    entries: DataFrame

    def split(self, rows: np.ndarray) -> np.ndarray:
        """Rows by subspace; dimensions are filled up with zeros."""
        m, _, width = self.books.shape
        full = np.zeros((len(rows), m * width))
        full[:, : rows.shape[1]] = rows
        return full.reshape(len(rows), m, width)

    def coded(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = nearest(units, self.centres)
        parts = self.split(units - self.centres[home])
        return home, np.stack([nearest(parts[:, s], self.books[s]) for s in range(len(self.books))], 1).astype(np.uint8)

    def probed(self, units: np.ndarray, probes: int) -> np.ndarray:
        """The cells that each query looks into: those of the nearest centres."""
        far = (self.centres**2).sum(1) - 2 * units @ self.centres.T
        return np.argpartition(far, min(probes, far.shape[1]) - 1, axis=1)[:, :probes]

    def save(self, path: str) -> None:
        """Keep the index as tables: entries by cell, and the two small matrices."""
        spark = self.entries.sparkSession
        self.entries.write.parquet(f"{path}/entries")
        for name, array in (("centres", self.centres), ("books", self.books)):
            spark.createDataFrame([(list(array.shape), bytearray(array.astype(np.float64).tobytes()))], "shape array<int>, data binary").write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        def matrix(name: str) -> np.ndarray:
            row = spark.read.parquet(f"{path}/{name}").first()
            return np.frombuffer(bytes(row["data"])).reshape(row["shape"])

        return VectorIndex(matrix("centres"), matrix("books"), spark.read.schema(ENTRIES).parquet(f"{path}/entries"))


def build_index(items: DataFrame, cells: int | None = None, seed: int = 5) -> VectorIndex:
    """The index of ``items`` (item_id, vector). Rows without id or vector are left out."""
    stored = items.where("item_id is not null and vector is not null and size(vector) > 0").select("item_id", "vector")
    n = stored.count()
    if not n:
        return VectorIndex(np.zeros((0, 0)), np.zeros((0, 0, 0)), items.sparkSession.createDataFrame([], ENTRIES))
    # Rows of the smallest hashes: each task hands on at most the sample's size.
    sample = stored.orderBy(F.xxhash64("item_id", F.lit(seed))).limit(SAMPLE).toArrow()
    units = _units(sample.column("vector").combine_chunks())
    centres = k_means(units, min(MAX_CELLS, cells or max(1, int(n**0.5))), seed=seed)
    width = -(-units.shape[1] // min(SUBSPACES, units.shape[1]))
    m = -(-units.shape[1] // width)
    fitted = VectorIndex(centres, np.zeros((m, 1, width)), stored)
    parts = fitted.split(units - centres[nearest(units, centres)])
    books = [k_means(parts[:, s], CODEWORDS, 4, seed) for s in range(m)]
    fitted.books = np.stack([np.pad(b, ((0, CODEWORDS - len(b)), (0, 0)), mode="edge") for b in books])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, codes = coder.coded(_units(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["item_id", "cell", "code"]
                )

    coder = VectorIndex(fitted.centres, fitted.books, None)
    fitted.entries = durable(stored.mapInArrow(place, ENTRIES), "index-entries")
    return fitted


def probes_of(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """``query_id, unit, cell``: the cells each query looks into."""
    if not len(index.centres):
        return queries.sparkSession.createDataFrame([], "query_id string, unit array<double>, cell int")
    coder = VectorIndex(index.centres, index.books, None)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _units(batch.column(1))
                cells = coder.probed(units, probes)
                row = np.repeat(np.arange(len(units)), cells.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(list(units[row]), pa.list_(pa.float64())), pa.array(cells.ravel(), pa.int32())],
                    ["query_id", "unit", "cell"],
                )

    asked = queries.where("query_id is not null and vector is not null and size(vector) > 0").select("query_id", "vector")
    return asked.mapInArrow(probe, "query_id string, unit array<double>, cell int")


def search_index(
    index: VectorIndex, queries: DataFrame, items: DataFrame, k: int = TOP_K, probes: int | None = None, reranked: int = RERANKED
) -> DataFrame:
    """The k nearest items found for every query: query_id, item_id, score, rank.

    A cell's entries come in blocks of bounded size; its queries meet each of them. Of a
    block, and then of all, ``reranked`` hits a query go on to the exact scores.
    """
    probes = probes or max(1, round(PROBED * len(index.centres)))
    blocks = index.entries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = index.entries.join(blocks, "cell").select("item_id", "cell", "code", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int").alias("block"))
    numbers = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    right = probes_of(index, queries, probes).join(blocks, "cell").select("query_id", "unit", "cell", numbers)
    coder = VectorIndex(index.centres, index.books, None)

    def score(entries: pa.Table, asked: pa.Table) -> pa.Table:
        names = pa.schema([("query_id", pa.string()), ("item_id", pa.string()), ("near", pa.float64())])
        if not entries.num_rows or not asked.num_rows:
            return names.empty_table()
        codes = np.frombuffer(b"".join(entries.column("code").to_pylist()), np.uint8).reshape(entries.num_rows, -1)
        units = _units(asked.column("unit").combine_chunks())
        tables = np.einsum("qsw,scw->qsc", coder.split(units), coder.books)
        base = units @ coder.centres[entries.column("cell")[0].as_py()]
        found, ids = [], asked.column("query_id").to_pylist()
        for q in range(len(units)):
            near = base[q] + tables[q][np.arange(codes.shape[1]), codes].sum(1)
            best = np.argpartition(-near, min(reranked, len(near)) - 1)[:reranked]
            found.append(pa.table([pa.array([ids[q]] * len(best)), entries.column("item_id").take(pa.array(best)), pa.array(near[best])], schema=names))
        return pa.concat_tables(found)

    near = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(score, "query_id string, item_id string, near double")
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "item_id")
    kept = durable(near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= reranked).select("query_id", "item_id"), "near")
    vectors_of = items.select("item_id", vx.unit(F.col("vector")).alias("_i"))
    scored = (
        vectors_of.join(kept, "item_id").join(queries.select("query_id", vx.unit(F.col("vector")).alias("_q")), "query_id")
        .select("query_id", "item_id", F.round(vx.dot(F.col("_i"), F.col("_q")), SCORE_DIGITS).alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")


def scored_share(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> float:
    """The share of all (query, item) pairs whose codes a search scores."""
    probes = probes or max(1, round(PROBED * len(index.centres)))
    cells = index.entries.groupBy("cell").agg(F.count("*").alias("n"))
    seen = probes_of(index, queries, probes).select("cell").join(cells, "cell").agg(F.sum("n")).first()[0] or 0
    pairs = index.entries.count() * queries.where("query_id is not null and vector is not null and size(vector) > 0").count()
    return seen / pairs if pairs else 0.0
