"""Exports as a stream of files, kept in a bucketed store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from colloquy.operators.buckets import BUCKETS, BucketTable, Store
from colloquy.session import durable
from colloquy.sources import exports as ex
from colloquy.sources.files import PACKED

FILE = "path string, modificationTime timestamp, length bigint, content binary"
MANIFEST = "sha256 string, conv_id string, path string"


def export_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files below ``folder``, with their bytes."""
    files = (
        spark.readStream.format("binaryFile").schema(FILE)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    )
    return ex.file_contents(files)


def packed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New rows of the tables of packed files directly below ``folder``."""
    files = spark.readStream.schema(PACKED).parquet(f"{folder}/*")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


class IngestStore:
    """The tables of an ingest in buckets, and a manifest of the files that went in."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.store = Store(spark, path, {name: StructType.fromDDL(ddl) for name, ddl in ex.INGESTED.items()}, buckets)
        self.manifest = BucketTable(spark, f"{path}/manifest", StructType.fromDDL(MANIFEST), "sha256", buckets)

    def tables(self) -> dict[str, DataFrame]:
        return {name: table.read() for name, table in self.store.tables.items()}

    def new_files(self, files: DataFrame) -> DataFrame:
        """``sha256, conv_id, path`` of files whose content has not gone into that
        conversation yet; of equal files in one batch the first path."""
        found = ex.parse_exports(files).where("bad_reason is null").select("sha256", "conv_id", "path")
        first = durable(found.groupBy("sha256", "conv_id").agg(F.min("path").alias("path")), "fingerprints")
        known = self.manifest.read(self.manifest.touched(first)).select("sha256", "conv_id")
        return first.join(known, ["sha256", "conv_id"], "left_anti")

    def ingest(self, files: DataFrame) -> int:
        """Import files (path, file_name, content); returns how many of them were new.

        Only the buckets of the conversations that come in are read and written. The
        manifest is written last: an import that fails is done again, with the same result.
        """
        files = durable(files.select("path", "file_name", "content"), "arrived")
        new = durable(self.new_files(files), "new-files")
        n = new.count()
        if not n:
            return 0
        exports = ex.parse_exports(files.join(new.select("path"), "path", "left_semi"))
        touched = durable(new.select("conv_id").distinct(), "touched")
        messages = self.store["messages"]
        fresh = ex.imported(exports, messages.read(messages.touched(touched)))
        for name in ("messages", "segments", "conversations"):
            self.store[name].replace(fresh[name], touched)
        arrived = fresh["source_files"].withColumn("arrival", F.coalesce("storage_path", F.lit("")))
        self.store["source_files"].insert_ignore(arrived, [ex.FILE_KEY])
        self.manifest.insert_ignore(new.withColumn("arrival", F.col("path")), [["sha256", "conv_id"]])
        return n

    def sink(self) -> Callable[[DataFrame, int], None]:
        def each(batch: DataFrame, batch_id: int) -> None:
            self.ingest(batch)

        return each
