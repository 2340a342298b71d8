"""Line de-duplication with levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, with the number of
documents that hold each line. Every batch of documents merge-anti-joins the runs: what
is new becomes a run of level 0, what is known adds to the counts. A level with
``fanout`` runs is compacted: they are merged into one run of the next level. Nothing is
ever updated in place.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructType

from colloquy.llm.common import durable, new_path, prepared, sha256_of, table

#: ASCII white space, stripped from both ends of a line's key.
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), _UPPER, _LOWER)


def distinct_line_hashes(text: Column) -> Column:
    """Hashes of the distinct lines of a text that have a key; a null text is empty.

    Keys are made distinct as strings, which Spark does by hashing; the hashes, being
    binary, it would compare with each other.
    """
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line_key)
    return F.transform(F.filter(F.array_distinct(keys), lambda k: k != ""), lambda k: F.unhex(F.md5(k)))


@pandas_udf(StructType().add("kept", StringType()).add("n_dropped", LongType()))
def without_lines(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Texts without the lines whose keys' hashes are ``gone``; null where there are none."""
    out = []
    for text, hashes in zip(texts, gone):
        if text is None or hashes is None:
            out.append((None, None))
            continue
        hashes, lines, kept = set(map(bytes, hashes)), text.split("\n"), []
        for line in lines:
            key = line.strip(SPACE).encode().lower()  # of bytes: A-Z only
            if not key or hashlib.md5(key).digest() not in hashes:
                kept.append(line)
        out.append(("\n".join(kept), len(lines) - len(kept)))
    return pd.DataFrame(out, columns=["kept", "n_dropped"])


@dataclass
class LineRuns:
    """The runs, by level, as bucketed tables in the shared folder, and what was added to them.

    A run is disjoint from all others: a batch's hashes that are in no run yet become its
    own run, those that are add to the counts (``added``). All tables are bucketed and
    sorted by hash alike, so a batch is merge-anti-joined bucket by bucket and a
    compaction is a union by bucket: no run is ever shuffled.
    """

    spark: SparkSession
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)
    added: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        # As many buckets as an aggregation has partitions: each bucket is then one file.
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # A bucket of one file is read in its order: joins then merge runs without sorting them.
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        # Spark 4.1 counts on a union of tables bucketed alike being bucketed, too, but runs
        # it as a plain one over columnar scans: a hash would have several sums.
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def _write(self, counts: DataFrame, kind: str) -> str:
        path = new_path(self.spark, f"line-{kind}")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        writer = counts.select("hash", "n_docs").write.format("parquet").option("path", path)
        writer.bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (with a ``hash``) that are in no run: a merge-anti-join."""
        for name in self.runs():
            batch = batch.join(self.spark.table(name).hint("merge"), "hash", "left_anti")
        return batch

    def add(self, batch: DataFrame) -> DataFrame:
        """Add ``batch(hash)``, which has each hash once for each document; returns the
        hashes that were new."""
        counted = batch.groupBy("hash").agg(F.count("*").alias("n_docs"))
        if self.runs():
            counted = self.spark.table(self._write(counted, "batch"))
            fresh = self._write(self.unseen(counted), "run")
            again = counted.join(self.spark.table(fresh).hint("merge"), "hash", "left_anti")
            self.added.append(self._write(again, "added"))
        else:
            fresh = self._write(counted, "run")
        self._place(fresh, 0)
        return self.spark.table(fresh).select("hash")

    def _place(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._place(self._write(self._union(names), f"run-{level + 1}"), level + 1)

    def _union(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(n) for n in names])

    def counts(self) -> DataFrame:
        """Documents by line: each run's, and what later batches added to them."""
        if not self.runs():
            return self.spark.createDataFrame([], "hash binary, n_docs bigint")
        if not self.added:
            return self._union(self.runs())
        more = self._union(self.added).groupBy("hash").agg(F.sum("n_docs").alias("more"))
        more = self.spark.table(self._write(more.withColumnRenamed("more", "n_docs"), "sums")).withColumnRenamed("n_docs", "more")
        total = (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs")
        each = [self.spark.table(n).join(more, "hash", "left").select("hash", total) for n in self.runs()]
        return reduce(DataFrame.unionByName, each)


def _documents(docs: DataFrame, text: str) -> DataFrame:
    """Distinct line hashes of each row, one row each: a row counts a line once."""
    return docs.select(F.explode(distinct_line_hashes(F.col(text).cast("string"))).alias("hash"))


def add_new_lines(runs: LineRuns, docs: DataFrame, text: str = "text") -> DataFrame:
    """Hashes of this batch's lines that no earlier batch has; the batch joins the runs."""
    return runs.add(_documents(docs, text))


def frequent_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", batches: int = 4) -> DataFrame:
    """Hashes of lines found in at least ``min_docs`` documents, counted through the runs."""
    spark = prepared(docs.sparkSession)
    path = new_path(spark, "line-hashes")
    dealt = docs.withColumn("__batch", F.pmod(F.xxhash64(text), F.lit(batches))).select("__batch", text)
    hashes = distinct_line_hashes(F.col(text).cast("string"))
    # One pass over the texts; a map task sums its own rows before anything is written.
    (
        dealt.select(F.col("__batch").alias("batch"), F.explode(hashes).alias("hash"))
        .write.partitionBy("batch").parquet(path)
    )
    stored = spark.read.schema("hash binary, batch int").parquet(path)
    runs = LineRuns(spark)
    for i in range(batches):
        runs.add(stored.where(F.col("batch") == i).select("hash"))
    return durable(runs.counts().where(F.col("n_docs") >= min_docs).select("hash"), "frequent-lines")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``kept``, ``n_lines`` and ``n_dropped``: lines of many documents go.

    Every row of ``docs`` is a document of its own, also where ids repeat or are null.
    Keys without code points are never dropped; a text all of whose lines go is empty.
    Names of other columns play no part: the result has one column ``doc`` with the row
    as it was, and the three new ones.
    """
    spark = prepared(docs.sparkSession)
    frequent = frequent_lines(docs, min_docs, text)
    # Rows are told apart by their content: equal rows lose equal lines.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    body = F.coalesce(F.col(f"doc.`{text}`").cast("string"), F.lit(""))
    ident = F.struct(F.col(f"doc.`{key}`"), F.unhex(F.md5(body)))
    lines = rows.select(ident.alias("ident"), F.explode(distinct_line_hashes(body)).alias("hash"))
    hits = durable(
        lines.join(frequent, "hash").groupBy("ident").agg(F.collect_set("hash").alias("gone")),
        "dropped-lines",
    )
    joined = rows.withColumn("ident", ident).join(hits, "ident", "left")
    # Only texts that lose lines go through Python, where a set of hashes is looked up.
    changed = joined.withColumn("cut", without_lines(F.when(F.col("gone").isNotNull(), body), F.col("gone")))
    return changed.select(
        "doc",
        F.coalesce("cut.kept", body).alias("kept"),
        F.size(F.split(body, "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce("cut.n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines before and after, and the digest of what stays, of every document."""
    docs = table(prepared(spark), sf_dir, "documents").select("doc_id", "text")
    found = drop_frequent_lines(docs)
    return found.select("doc.doc_id", "n_lines", "n_dropped", sha256_of(F.col("kept")).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
),
lines AS (SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON f.key = k.key GROUP BY doc_id, r
"""
