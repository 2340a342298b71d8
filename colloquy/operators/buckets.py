"""Stored tables in key buckets: an upsert or delete rewrites only what it touches.

A table is a folder of partitions ``bucket=k``, k being the hash of its placing column.
A change reads and overwrites the buckets of its own keys (dynamic partition overwrite);
the files of all others stay as they are. A bucket whose last row goes keeps a row that
is no row (``_live`` false), because Spark replaces only partitions that are written.

A change that fails midway has replaced some of its buckets and not others. Each bucket is
either old or new, and a change run again has the same result, so it is simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from colloquy.operators import tables as tb
from colloquy.session import durable

#: Buckets of a table; a cluster's tables take thousands. It must not change afterwards.
BUCKETS = 64

#: Which column places the rows of a table: that of the keys its changes come with.
PLACED_BY = {
    "source_files": "sha256",
    "conversations": "conv_id",
    "messages": "conv_id",
    "segments": "conv_id",
    "segment_summaries": "segment_id",
    "extracts": "extract_id",
    "statements": "extract_id",
    "fragments": "extract_id",
    "links": "fragment_id",
    "vectors": "fragment_id",
    "topics": "conv_id",
    "topic_segments": "topic_id",
    "jobs": "job_id",
}


class BucketTable:
    """One stored table, placed by the hash of ``column``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, column: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.column, self.buckets = spark, path, schema, column, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.column), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        held = StructType([*self.schema.fields, StructField("_live", BooleanType()), StructField("bucket", IntegerType())])
        try:
            return self.spark.read.schema(held).parquet(self.path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], held)  # nothing was stored yet

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: the scan then opens only their folders."""
        stored = self._stored().where("_live")
        if buckets is not None:
            stored = stored.where(F.col("bucket").isin(list(buckets)))
        return stored.select(*self.schema.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys; at most ``buckets`` numbers, whatever the number of keys."""
        return sorted(r["bucket"] for r in self._placed(keys.select(self.column)).select("bucket").distinct().collect())

    def change(self, keys: DataFrame, after: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by what ``after`` makes of their rows; returns them.

        New rows must have their placing column among ``keys``.
        """
        buckets = self.touched(keys)
        if not buckets:
            return buckets
        rows = self._placed(after(self.read(buckets)).select(*self.schema.names)).withColumn("_live", F.lit(True))
        rows = durable(rows.select(*self.schema.names, "_live", "bucket"), "change")
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        full = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        emptied = [(b,) for b in buckets if b not in set(full)]
        gone = self.spark.createDataFrame(emptied, "bucket int").select(*blank, F.lit(False).alias("_live"), "bucket")
        # Rows of a bucket are brought together where that makes sense by size; large ones are split.
        rows.unionByName(gone).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return buckets

    def upsert(self, batch: DataFrame, keys: list[str], arrival: str = "arrival") -> list[int]:
        """The last row of each key replaces the stored one."""
        batch = durable(batch, "batch")
        return self.change(batch, lambda stored: tb.upsert(stored, batch, keys, arrival))

    def insert_ignore(self, batch: DataFrame, keys: list[list[str]], arrival: str = "arrival") -> list[int]:
        """Rows whose keys are not stored. Every key must hold the placing column."""
        if any(self.column not in key for key in keys):
            raise ValueError(f"a key without {self.column} may clash with rows of other buckets")
        batch = durable(batch, "batch")
        return self.change(batch, lambda stored: stored.unionByName(tb.insert_ignore(stored, batch, keys, arrival).select(*stored.columns)))

    def replace(self, rows: DataFrame, keys: DataFrame) -> list[int]:
        """All rows of the given placing keys go, ``rows`` come; their keys are replaced, too."""
        rows = durable(rows.select(*self.schema.names), "rows")
        gone = durable(keys.select(self.column).unionByName(rows.select(self.column)).distinct(), "keys")
        return self.change(gone, lambda stored: tb.delete_keys(stored, gone, self.column).unionByName(rows))

    def delete(self, gone: DataFrame) -> list[int]:
        """Remove the rows of the given placing keys."""
        gone = durable(gone.select(self.column).distinct(), "keys")
        return self.change(gone, lambda stored: tb.delete_keys(stored, gone, self.column))


class Store:
    """The stage tables in buckets under one folder, and the changes that cascade."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, StructType], buckets: int = BUCKETS):
        self.tables = {
            name: BucketTable(spark, f"{path}/{name}", schema, PLACED_BY[name], buckets) for name, schema in schemas.items()
        }

    @classmethod
    def of(cls, spark: SparkSession, path: str, frames: dict[str, DataFrame], buckets: int = BUCKETS) -> Store:
        """A store that holds the given tables."""
        store = cls(spark, path, {name: df.schema for name, df in frames.items()}, buckets)
        for name, df in frames.items():
            store[name].replace(df, df)
        return store

    def __getitem__(self, name: str) -> BucketTable:
        return self.tables[name]

    def set_embedding(self, vectors: DataFrame) -> list[int]:
        """Point id, time and model of vectors (with their fragment's extract_id)."""
        vectors = durable(vectors, "vectors")
        return self["fragments"].change(vectors, lambda stored: tb.set_embedding(stored, vectors.drop("extract_id")))

    def delete_extracts(self, gone: DataFrame, statements: bool = True) -> DataFrame:
        """Remove extracts with their statements, fragments, links and vectors; returns the
        ids of the points to purge. Without ``statements`` only the fragments go."""
        gone = durable(gone.select("extract_id").distinct(), "gone")
        fragments = self["fragments"]
        lost = durable(fragments.read(fragments.touched(gone)).join(gone, "extract_id", "left_semi").select("fragment_id", "point_id"), "lost")
        for name in ("links", "vectors"):
            if name in self.tables:
                self[name].delete(lost)
        for name in ("fragments", "statements", "extracts") if statements else ("fragments",):
            self[name].delete(gone)
        return lost.where("point_id is not null").select("point_id")

    def delete_segments(self, gone: DataFrame) -> None:
        """Remove segments (conv_id, segment_id) and their summaries."""
        gone = durable(gone.select("conv_id", "segment_id").distinct(), "gone")
        self["segments"].change(gone, lambda stored: stored.join(gone, ["conv_id", "segment_id"], "left_anti"))
        if "segment_summaries" in self.tables:
            self["segment_summaries"].delete(gone)

    def delete_topics(self, conversations: DataFrame) -> None:
        """Remove the topics of conversations with their segment rows."""
        gone = durable(conversations.select("conv_id").distinct(), "gone")
        topics = self["topics"]
        lost = durable(topics.read(topics.touched(gone)).join(gone, "conv_id", "left_semi").select("topic_id"), "lost")
        self["topic_segments"].delete(lost)
        topics.delete(gone)
