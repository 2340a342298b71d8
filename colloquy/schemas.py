"""Schemas, keys and references of the stage tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Table:
    """A stage table: columns, unique keys (the first is primary), references."""

    name: str
    ddl: str
    keys: tuple[tuple[str, ...], ...]
    references: tuple[tuple[str, str, str], ...] = ()
    cascades: frozenset[str] = field(default_factory=frozenset)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


_SUMMARY = (
    "summary string, bullets array<string>, action_items array<string>, lang string, status string, "
    "warnings array<string>, provider string, model string, latency_ms bigint, created_at timestamp"
)

TABLES = {
    t.name: t
    for t in (
        Table(
            "source_files",
            "source_file_id string, source_kind string, original_filename string, storage_path string, "
            "sha256 string, size_bytes bigint, ingested_at timestamp, created_at timestamp",
            (("sha256", "source_kind"),),
        ),
        Table(
            "conversations",
            "conv_id string, raw_source_file_id string, normalized_source_file_id string, title string, "
            "conversation_date timestamp, source_platform string, message_count bigint, "
            "imported_at timestamp, created_at timestamp",
            (("conv_id",),),
            (
                ("raw_source_file_id", "source_files", "source_file_id"),
                ("normalized_source_file_id", "source_files", "source_file_id"),
            ),
        ),
        Table(
            "segments",
            "segment_id string, conv_id string, segment_index bigint, start_position bigint, "
            "end_position bigint, message_ids array<string>, conversation_date timestamp, "
            "segment_text string, created_at timestamp",
            (("segment_id",), ("conv_id", "segment_index")),
            (("conv_id", "conversations", "conv_id"),),
        ),
        Table(
            "segment_summaries",
            "segment_summary_id string, segment_id string, " + _SUMMARY,
            (("segment_summary_id",), ("segment_id",)),
            (("segment_id", "segments", "segment_id"),),
        ),
        Table(
            "extracts",
            "extract_id string, segment_id string, segment_index bigint, conv_id string, provider string, "
            "model string, prompt_version string, status string, warnings array<string>, "
            "latency_ms bigint, created_at timestamp",
            (("extract_id",), ("segment_id",)),
            (("segment_id", "segments", "segment_id"), ("conv_id", "conversations", "conv_id")),
        ),
        Table(
            "extract_statements",
            "statement_id string, extract_id string, statement_index bigint, speaker string, text string",
            (("statement_id",), ("extract_id", "statement_index")),
            (("extract_id", "extracts", "extract_id"),),
            frozenset({"extracts"}),
        ),
        Table(
            "fragments",
            "fragment_id string, extract_id string, fragment_index bigint, title string, "
            "retrieval_text string, status string, point_id string, embedded_at timestamp, "
            "embedding_model string, created_at timestamp",
            (("fragment_id",), ("extract_id", "fragment_index")),
            (("extract_id", "extracts", "extract_id"),),
        ),
        Table(
            "fragment_statement_links",
            "fragment_id string, statement_id string, position_in_fragment bigint",
            (("fragment_id", "statement_id"), ("fragment_id", "position_in_fragment")),
            (
                ("fragment_id", "fragments", "fragment_id"),
                ("statement_id", "extract_statements", "statement_id"),
            ),
            frozenset({"fragments"}),
        ),
        Table(
            "topic_summaries",
            "topic_id string, conv_id string, topic_index bigint, topic_segment_range string, " + _SUMMARY,
            (("topic_id",), ("conv_id", "topic_index")),
            (("conv_id", "conversations", "conv_id"),),
        ),
        Table(
            "topic_segments",
            "topic_id string, segment_id string, position bigint",
            (("topic_id", "segment_id"),),
            (("topic_id", "topic_summaries", "topic_id"), ("segment_id", "segments", "segment_id")),
            frozenset({"topic_summaries"}),
        ),
        Table(
            "jobs",
            "job_id string, job_type string, status string, input_metadata string, result string, "
            "error string, created_at timestamp, started_at timestamp, finished_at timestamp",
            (("job_id",),),
        ),
    )
}

# The states of a job.
JOB_STATUSES = ("pending", "running", "succeeded", "failed")

MESSAGE = (
    "struct<id:string,author:struct<role:string,name:string>,create_time:double,"
    "content:struct<content_type:string,parts:array<variant>>,recipient:string,"
    "metadata:struct<is_visually_hidden_from_conversation:boolean>>"
)
EXPORT = (
    "struct<conversation_id:string,title:string,create_time:double,update_time:double,"
    "current_node:string,mapping:map<string,struct<id:string,parent:string,children:array<string>,"
    f"message:{MESSAGE}>>>"
)
