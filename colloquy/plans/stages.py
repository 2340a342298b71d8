"""The stages put together: from turns to indexed fragments, as lazy plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions import ids
from colloquy.operators import fragments as fr
from colloquy.operators import messages as ms
from colloquy.operators import models
from colloquy.operators import segments as sg
from colloquy.operators import statements as st
from colloquy.operators import summaries as sm
from colloquy.session import configure, input_version, staged
from colloquy.sources.messages import read_messages

VECTOR_SIZE = 64


@dataclass
class KnowledgeBase:
    """Stage tables derived from the turns of ``conversations``.

    Messages, segments, statements, grouped statements, fragment vectors and summaries are written
    as stage tables when first asked for in a session, once for each version of the input:
    later stages and queries read the columns they need instead of deriving them again.
    All else is lazy.
    """

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        configure(self.spark)

    @cached_property
    def version(self) -> tuple:
        return input_version(self.spark.read.parquet(f"{self.sf_dir}/conversations.parquet"))

    def _stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return staged(self.spark, self.version, name, build)

    @cached_property
    def turns(self) -> DataFrame:
        return read_messages(self.spark, self.sf_dir)

    @cached_property
    def messages(self) -> DataFrame:
        """Visible messages without retries, numbered. A turn has text alone."""
        shown = ms.visible_messages(
            self.turns.withColumnRenamed("speaker", "role")
            .withColumn("recipient", F.lit(None).cast("string"))
            .withColumn("content_type", F.lit(ms.TEXT_CONTENT))
            .withColumn("hidden", F.lit(False))
        )
        linear = shown.withColumnRenamed("role", "speaker").select(*self.turns.columns)
        return self._stage("messages", lambda: ms.linear_messages(linear))

    @cached_property
    def segments(self) -> DataFrame:
        return self._stage("segments", lambda: sg.segment_conversations(self.messages))

    @cached_property
    def tails(self) -> DataFrame:
        return sg.pending_tails(self.messages)

    @cached_property
    def conversations(self) -> DataFrame:
        """Dimension rows with file ids derived from the conversation id."""
        headers = self.messages.select("conv_id").distinct().select(
            "conv_id",
            F.concat(F.lit("Conversation "), F.substr(F.col("conv_id"), F.lit(2))).alias("title"),
            F.lit("chatgpt").alias("source_platform"),
            F.sha2(F.concat(F.lit("raw:"), "conv_id"), 256).alias("raw_source_file_id"),
            F.sha2(F.concat(F.lit("normalized:"), "conv_id"), 256).alias("normalized_source_file_id"),
        )
        return sg.conversations_dim(self.messages, self.segments, headers)

    @cached_property
    def sources(self) -> DataFrame:
        kinds = F.explode(
            F.array(
                F.struct(F.lit("raw_export").alias("source_kind"), F.col("raw_source_file_id").alias("source_file_id")),
                F.struct(F.lit("normalized").alias("source_kind"), F.col("normalized_source_file_id").alias("source_file_id")),
            )
        )
        return self.conversations.select(kinds.alias("_f"), "conversation_date").select(
            "_f.source_file_id",
            "_f.source_kind",
            F.concat(F.substring("_f.source_file_id", 1, 8), F.lit(".json")).alias("original_filename"),
            F.col("conversation_date").alias("created_at"),
        )

    @cached_property
    def extracts(self) -> DataFrame:
        return st.build_extracts(self.segments)

    @cached_property
    def statements(self) -> DataFrame:
        return self._stage("statements", lambda: st.extract_statements(self.segments))

    @cached_property
    def grouped(self) -> DataFrame:
        return self._stage("grouped", lambda: fr.group_statements(self.statements))

    @cached_property
    def fragments(self) -> DataFrame:
        return fr.assemble_fragments(self.grouped)

    @cached_property
    def links(self) -> DataFrame:
        return fr.link_statements(self.grouped)

    @cached_property
    def indexed(self) -> DataFrame:
        """Fragments with their vector."""
        return self._stage("indexed", lambda: models.embed(self.fragments, "retrieval_text", dim=VECTOR_SIZE))

    @cached_property
    def summaries(self) -> DataFrame:
        return self._stage("summaries", lambda: sm.summarize_segments(self.segments))

    @cached_property
    def questions(self) -> DataFrame:
        """Questions nobody has answered yet: the pending tails, embedded."""
        asked = self.tails.select(F.col("message_id").alias("query_id"), F.col("content").alias("text"))
        return models.embed(asked, "text", dim=VECTOR_SIZE).drop("error")

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "conversations": self.conversations,
            "segments": self.segments,
            "extracts": self.extracts,
            "statements": self.statements,
            "fragments": self.fragments,
            "links": self.links,
        }

    @cached_property
    def stored(self) -> dict[str, DataFrame]:
        """The same tables under their schema names, with link keys as columns."""
        t = self.tables
        return {
            "conversations": t["conversations"],
            "segments": t["segments"],
            "extracts": t["extracts"],
            "extract_statements": t["statements"],
            "fragments": t["fragments"],
            "fragment_statement_links": t["links"],
            "source_files": self.sources.withColumn("sha256", F.col("source_file_id")),
        }
