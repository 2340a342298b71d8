"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from colloquy.llm import decontaminate, lines, order_minhash, packing, toxicity
from colloquy.llm.common import durable, prepared, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half."""
    scored = toxicity.toxicity(docs.select(*COLUMNS), table(prepared(spark), sf_dir, "labels"))
    return scored.where("score < 0.5").select("doc.*")


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold."""
    found = lines.drop_frequent_lines(docs.select(*COLUMNS))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept").cast("bigint")).otherwise(F.col("doc.n_chars"))
    changed = {"text": text, "n_chars": n_chars}
    return found.select(*[changed.get(c, F.col(f"doc.{c}")).alias(c) for c in COLUMNS])


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; rows without id are kept."""
    found = order_minhash.near_duplicates(docs)
    gone = durable(found.where("not kept").select("doc_id"), "copies")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def drop_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; mostly covered documents go."""
    clean = decontaminate.decontaminate(docs.select(*COLUMNS), table(prepared(spark), sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 1024 tokens."""
    found = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(durable(found, "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]
#: The classifier, the alignment and the packing cannot be stated in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``; stages are written in between."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
