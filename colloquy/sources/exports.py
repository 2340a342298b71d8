"""Reading raw chat exports: one JSON object per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from colloquy import schemas
from colloquy.functions import text as tx
from colloquy.operators import messages as ms
from colloquy.operators import segments as sg
from colloquy.operators import tree
from colloquy.session import durable

PLATFORM = "chatgpt"


def read_exports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file; unreadable files have ``bad_reason`` and no export."""
    return parse_exports(file_contents(spark.read.format("binaryFile").load(paths)))


def file_contents(files: DataFrame) -> DataFrame:
    """``path, file_name, content`` of a binary file source, streaming or not."""
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), "content"
    )


def parse_exports(files: DataFrame) -> DataFrame:
    """Parse files (path, file_name and content, or value as text). Map entries keep file
    order. ``sha256`` and ``size_bytes`` are those of the file's bytes."""
    if "content" in files.columns:
        text = F.make_valid_utf8(F.col("content").cast("string"))
        files = files.select("path", "file_name", text.alias("value"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size_bytes"))
    else:
        raw = F.col("value").cast("binary")
        files = files.select("path", "file_name", "value", F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("bigint").alias("size_bytes"))
    whole = F.try_parse_json("value")
    bad = F.when(whole.isNull(), "invalid JSON").when(
        ~F.schema_of_variant(whole).startswith("OBJECT"), "not a JSON object"
    )
    parsed = F.from_json("value", schemas.EXPORT)
    return (
        files.withColumn("bad_reason", bad)
        .withColumn("export", F.when(F.col("bad_reason").isNull(), parsed))
        .withColumn(
            "conv_id",
            F.when(
                F.col("bad_reason").isNull(),
                F.coalesce("export.conversation_id", tx.file_stem(F.col("file_name"))),
            ),
        )
        .drop("value")
    )


def export_nodes(exports: DataFrame) -> DataFrame:
    """Tree nodes with the fields of their message, one row per map entry.

    A tree belongs to one file: ``conv_id`` is the file's path here, as one conversation
    may have several exports. ``hashed_id`` is what a missing message id is hashed with:
    the export's own conversation id, empty where it has none.
    """
    entries = exports.where("bad_reason is null").select(
        F.col("path").alias("conv_id"),
        F.coalesce("export.conversation_id", F.lit("")).alias("hashed_id"),
        F.posexplode(F.map_entries("export.mapping")).alias("map_position", "_e")
    )
    message = F.col("_e.value.message")
    return entries.select(
        "conv_id",
        "hashed_id",
        F.col("_e.key").alias("node_id"),
        F.col("_e.value.parent").alias("parent_id"),
        F.col("map_position").cast("bigint").alias("map_position"),
        F.coalesce("_e.value.children", F.array().cast("array<string>")).alias("children"),
        message.isNotNull().alias("has_message"),
        message["id"].alias("raw_id"),
        message["author"]["role"].alias("role"),
        message["recipient"].alias("recipient"),
        message["content"]["content_type"].alias("content_type"),
        message["metadata"]["is_visually_hidden_from_conversation"].alias("hidden"),
        message["create_time"].alias("create_time"),
        ms.message_text(message["content"]["parts"]).alias("content"),
    )


def export_heads(exports: DataFrame) -> DataFrame:
    return exports.where("export.current_node is not null").select(
        F.col("path").alias("conv_id"), F.col("export.current_node").alias("node_id")
    )


def _file_messages(exports: DataFrame) -> DataFrame:
    """Linear, visible messages of every file, ``conv_id`` being its path.

    The JSON is parsed once, into a node table; the walk then reads its ids only.
    """
    nodes = durable(export_nodes(exports), "nodes")
    links = nodes.select("conv_id", "node_id", "parent_id", "map_position", "children")
    path = tree.conversation_paths(links, export_heads(exports))
    placed = nodes.where("has_message").join(path, ["conv_id", "node_id"]).withColumn(
        "ordinal", F.col("position")
    )
    keyed = ms.with_message_key(ms.visible_messages(placed), "hashed_id").select(
        "conv_id",
        "message_id",
        F.col("role").alias("speaker"),
        tx.epoch_to_timestamp(F.col("create_time")).alias("created_at"),
        "ordinal",
        "content",
    )
    return ms.linear_messages(keyed)


def import_order(exports: DataFrame) -> DataFrame:
    """``path, conv_id, import_rank``: a conversation's exports from oldest to newest.

    Age is the update time, then the path; an export without a time comes first.
    """
    oldest = Window.partitionBy("conv_id").orderBy(F.col("export.update_time").asc_nulls_first(), "path")
    return exports.where("bad_reason is null").select(
        "path", "conv_id", (F.row_number().over(oldest).cast("bigint") - 1).alias("import_rank")
    )


def export_messages(exports: DataFrame) -> DataFrame:
    """Linear, visible, numbered messages of every conversation.

    Each file is walked by itself. A conversation with several exports keeps the
    messages of its oldest one in their order, then takes what each later one adds;
    the first copy of a message id within a conversation wins.
    """
    ranked = import_order(exports)
    columns = ["message_id", "speaker", "created_at", "content"]
    rows = _file_messages(exports).withColumnRenamed("conv_id", "path").join(ranked, "path")
    order = (F.col("import_rank") * ms.NEW_SIDE + F.col("position")).alias("ordinal")
    row = F.struct("ordinal", *columns[1:])
    first = (
        rows.select("conv_id", *columns, order)
        .groupBy("conv_id", "message_id").agg(F.min_by(row, "ordinal").alias("_row"))
        .select("conv_id", "message_id", "_row.*")
    )
    return ms.assign_positions(durable(first, "imported"))


#: The tables of an ingest.
INGESTED = {
    "source_files": "source_file_id string, source_kind string, original_filename string, storage_path string, "
    "sha256 string, size_bytes bigint, conv_id string",
    "conversations": "conv_id string, title string, source_platform string, source_file string, raw_export_path string, "
    "created_at timestamp, updated_at timestamp, raw_source_file_id string, normalized_source_file_id string, "
    "conversation_date timestamp, message_count bigint",
    "messages": "conv_id string, message_id string, speaker string, created_at timestamp, content string, position bigint",
    "segments": "segment_id string, conv_id string, segment_index bigint, start_position bigint, end_position bigint, "
    "message_ids array<string>, conversation_date timestamp, segment_text string",
}
FILE_KEY = ["sha256", "source_kind"]


def normalized_sources(messages: DataFrame) -> DataFrame:
    """A source for the normalised messages of each conversation: their digest and size.

    The digest is one of a sum over messages, so a conversation of any length is summed
    before its rows meet. The same messages at the same places give the same digest.
    """
    print_ = F.xxhash64("position", "message_id", "speaker", "created_at", "content").cast("decimal(38,0)")
    other = F.xxhash64("content", "message_id", "position").cast("decimal(38,0)")
    sums = messages.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.sum(print_).alias("a"), F.sum(other).alias("b"),
        F.sum(F.octet_length(F.coalesce("content", F.lit("")))).alias("size_bytes"),
    )
    digest = F.sha2(F.concat_ws("|", F.lit("normalized"), "conv_id", *[F.col(c).cast("string") for c in ("n", "a", "b")]), 256)
    return sums.select(
        digest.alias("source_file_id"), F.lit("normalized").alias("source_kind"),
        F.concat("conv_id", F.lit(".json")).alias("original_filename"), F.lit(None).cast("string").alias("storage_path"),
        digest.alias("sha256"), F.col("size_bytes").cast("bigint").alias("size_bytes"), "conv_id",
    )


def imported(exports: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """New rows of an import: source files, and all rows of the conversations it touches.

    ``known`` holds the messages so far. They stay as they are, new ones are added behind.
    """
    headers = import_order(exports).join(conversation_headers(exports).withColumnRenamed("raw_export_path", "path"), ["path", "conv_id"])
    headers = durable(headers.withColumnRenamed("path", "raw_export_path"), "headers")
    newest = headers.groupBy("conv_id").agg(F.max_by(F.struct(*[c for c in headers.columns if c not in ("conv_id", "import_rank")]), "import_rank").alias("_h"))
    incoming = durable(export_messages(exports).select("conv_id", "message_id", "speaker", "created_at", "content", "position"), "incoming")
    if known is None:
        messages = incoming
    else:
        again = known.join(newest.select("conv_id"), "conv_id", "left_semi").select(*incoming.columns)
        messages = durable(ms.merge_messages(again, incoming).select(*incoming.columns), "merged")
    numbered = ms.assign_positions(messages.withColumn("ordinal", F.col("position")).drop("position"))
    segments = durable(sg.segment_conversations(numbered), "segments")
    normalized = durable(normalized_sources(messages), "normalized")
    # A file that comes under several names is one source.
    raw = headers.groupBy("sha256").agg(F.min(F.struct("raw_export_path", "source_file", "size_bytes", "conv_id")).alias("_f")).select(
        F.col("sha256").alias("source_file_id"), F.lit("raw_export").alias("source_kind"), F.col("_f.source_file").alias("original_filename"),
        F.col("_f.raw_export_path").alias("storage_path"), "sha256", "_f.size_bytes", "_f.conv_id",
    )
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"))
    conversations = (
        newest.select("conv_id", "_h.*").withColumnRenamed("sha256", "raw_source_file_id")
        .join(normalized.select("conv_id", F.col("source_file_id").alias("normalized_source_file_id")), "conv_id", "left")
        .join(segments.where("segment_index = 0").select("conv_id", "conversation_date"), "conv_id", "left")
        .join(counts, "conv_id", "left").fillna(0, ["message_count"])
    )
    fresh = {"source_files": raw.unionByName(normalized), "conversations": conversations, "messages": messages, "segments": segments}
    return {name: df.select(*T.StructType.fromDDL(INGESTED[name]).names) for name, df in fresh.items()}


def ingest(exports: DataFrame, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables after importing ``exports``: source_files, conversations, messages, segments.

    ``stored`` are the tables so far. Known messages stay as they are, new ones are
    added behind them; headers and segments of the conversations that came in are
    replaced, all others are not touched. Source files are kept by (sha256, kind), the
    first one stays. Importing the same files again changes nothing.
    """
    fresh = imported(exports, None if stored is None else stored["messages"])
    if stored is None:
        return fresh
    touched = durable(fresh["conversations"].select("conv_id"), "touched")
    after = {}
    for name, df in fresh.items():
        rows = stored[name].select(*df.columns)
        if name == "source_files":
            after[name] = rows.unionByName(df.join(rows.select(*FILE_KEY), FILE_KEY, "left_anti").select(*df.columns))
        else:
            after[name] = rows.join(touched, "conv_id", "left_anti").unionByName(df)
    return after


def conversation_headers(exports: DataFrame) -> DataFrame:
    """Title, platform, times and provenance of every export."""
    def at(seconds: str) -> Column:
        return tx.epoch_to_timestamp(F.col(f"export.{seconds}"))

    return exports.where("bad_reason is null").select(
        "conv_id",
        F.coalesce("export.title", F.lit("")).alias("title"),
        F.lit(PLATFORM).alias("source_platform"),
        F.col("file_name").alias("source_file"),
        F.col("path").alias("raw_export_path"),
        "sha256",
        "size_bytes",
        at("create_time").alias("created_at"),
        at("update_time").alias("updated_at"),
    )
