"""Reading linear chat turns from a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Turns carry no time of their own: an hour per conversation, a minute per turn.
FIRST_EPOCH = 1704067200


def read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of ``conversations`` as normalized messages, system turns included."""
    return normalize_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def normalize_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows, batch or stream, as normalized messages."""
    epoch = F.lit(FIRST_EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return turns.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conv_id"),
        F.format_string("c%d_m%04d", "conv_id", "turn").alias("message_id"),
        F.col("role").alias("speaker"),
        F.timestamp_seconds(epoch).alias("created_at"),
        F.col("turn").cast("bigint").alias("ordinal"),
        F.col("text").alias("content"),
    )
