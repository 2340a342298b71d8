"""Text vectors of hashed terms, weighted by how rare the terms are.

Weights are fitted once over a table of texts and kept as a versioned table; vectors are
then made in one pass. A term's weight is that of its hash slot, so the table has at most
``SLOTS`` rows whatever the vocabulary, and may be sent to every task.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions import text
from colloquy.functions.vectors import hashed_vectors

#: Slots that the frequencies of terms are counted in: four hex digits of a term's MD5.
SLOTS = 1 << 16
IDF = "slot int, texts bigint, idf double"


def fit_idf(texts: DataFrame, text_column: str = "text") -> DataFrame:
    """``slot, texts, idf``: in how many texts a slot occurs, and ln((all + 1) / (texts + 1)).

    All texts with a word count. Counts are summed in each task before they are shuffled.
    """
    slot = lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int")
    words = text.words(F.coalesce(text_column, F.lit("")))
    slots = texts.select(F.array_distinct(F.transform(words, slot)).alias("slots")).where(F.size("slots") > 0)
    total = slots.agg(F.count("*").alias("_all"))
    counts = slots.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("texts"))
    return counts.join(F.broadcast(total)).select("slot", "texts", F.log((F.col("_all") + 1) / (F.col("texts") + 1)).alias("idf"))


def write_idf(fitted: DataFrame, path: str) -> int:
    """Keep fitted weights as the next version below ``path``; returns its number."""
    version = (last_version(fitted.sparkSession, path) or 0) + 1
    fitted.select("slot", "texts", "idf").write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def last_version(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema(IDF + ", version int").parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_idf(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The weights of a version, the last one by default."""
    number = last_version(spark, path) if version is None else version
    return spark.read.schema(IDF).parquet(f"{path}/version={number}")


def embed_idf(texts: DataFrame, idf: DataFrame, text_column: str = "text", dim: int = 64) -> DataFrame:
    """``texts`` with ``vector``: signed sums of term weights by hash, of length one.

    A term that was in no fitted text weighs as much as one in a single text would. A
    text without words has no vector; one whose terms all weigh nothing has zeros.
    """
    known = idf.select("slot", "texts", "idf").toPandas()
    weights = np.full(SLOTS, known["idf"].max() if len(known) else 1.0)
    weights[known["slot"].to_numpy()] = known["idf"].to_numpy()
    words = text.words(F.coalesce(text_column, F.lit("")))
    return texts.withColumn("vector", hashed_vectors(words, dim, weights))
