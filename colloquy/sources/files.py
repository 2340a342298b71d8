"""File fingerprints, chat lists and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.operators.tables import in_range

SEGMENT_SUMMARY_KIND = "ai_chat_segment"


#: Small files kept as rows of a table: a file of a few bytes costs a folder, a commit and a
#: listing of its own, which for many of them takes longer than the work on their contents.
PACKED = "path string, content binary"


def pack_files(files: DataFrame, path: str) -> None:
    """Write files (path, and value as text) as one table of paths and UTF-8 bytes."""
    files.select("path", F.col("value").cast("binary").alias("content")).write.parquet(path)


def fingerprint_files(spark: SparkSession, paths: str | list[str], kind: str, packed: bool = False) -> DataFrame:
    """source_files rows: SHA-256, size, name and path. Keyed by (sha256, kind).

    ``packed`` files are rows of the tables at ``paths``, as ``pack_files`` writes them.
    """
    if packed:
        reading = spark.read.schema(PACKED).parquet(*([paths] if isinstance(paths, str) else paths))
        files = reading.withColumn("length", F.octet_length("content").cast("bigint"))
    else:
        files = spark.read.format("binaryFile").load(paths)
    return files.select(
        F.sha2("content", 256).alias("source_file_id"),
        F.lit(kind).alias("source_kind"),
        F.element_at(F.split("path", "/"), -1).alias("original_filename"),
        F.col("path").alias("storage_path"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size_bytes"),
        F.current_timestamp().alias("ingested_at"),
        F.current_timestamp().alias("created_at"),
    )


def read_chat_lists(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(messages, problems) of files that hold a JSON array of turns each."""
    files = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), "value"
    )
    return parse_chat_lists(files)


def parse_chat_lists(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check and flatten file contents (file_name, value).

    A file with any error gives no messages. An empty array is a warning only.
    """
    whole = F.col("_whole")
    parsed = files.withColumn("_whole", F.try_parse_json("value")).withColumn(
        "_items", F.try_variant_get("_whole", "$", "array<variant>")
    )
    is_object = lambda i: F.schema_of_variant(i).startswith("OBJECT")
    has = lambda i, name: F.array_contains(
        F.map_keys(F.try_variant_get(i, "$", "map<string,variant>")), name
    )
    checked = parsed.withColumn(
        "problem",
        F.when(whole.isNull(), "invalid JSON")
        .when(~F.schema_of_variant(whole).startswith("ARRAY"), "not an array")
        .when(F.exists("_items", lambda i: ~is_object(i)), "item is not an object")
        .when(F.exists("_items", lambda i: ~(has(i, "speaker") & has(i, "content"))), "item lacks speaker or content")
        .when(F.size("_items") == 0, "empty conversation"),
    )
    problems = checked.where("problem is not null").select(
        "file_name", "problem", (F.col("problem") != "empty conversation").alias("is_error")
    )
    messages = (
        checked.where("problem is null")
        .select("file_name", F.posexplode("_items").alias("position", "_m"))
        .select(
            F.col("file_name").alias("conv_id"),
            F.col("position").cast("bigint").alias("position"),
            F.try_variant_get("_m", "$.speaker", "string").alias("speaker"),
            F.try_variant_get("_m", "$.content", "string").alias("content"),
            F.try_variant_get("_m", "$.ts", "string").alias("ts"),
        )
    )
    return messages, problems


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a stage table as Parquet."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_readable(reports: DataFrame, path: str) -> None:
    """Write the readable form: one text record per row."""
    reports.select("report").write.mode("overwrite").text(path, lineSep="\n\n")


def read_stage(
    spark: SparkSession,
    path: str,
    conversations: DataFrame | None = None,
    first: int = 0,
    last: int | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Rows of an earlier stage, cut to a segment range that reaches the scan.

    ``kind`` keeps one ``source_kind``, as topics do. Sorting is left to the reader
    of the result: rows carry ``segment_index``.
    """
    rows = spark.read.parquet(path).where(in_range(F.col("segment_index"), first, last))
    if kind is not None:
        rows = rows.where(F.col("source_kind") == kind)
    if conversations is not None:
        rows = rows.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    return rows
