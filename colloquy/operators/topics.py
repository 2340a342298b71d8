"""Topic boundaries from the similarity of consecutive vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.functions import ids, vectors
from colloquy.operators.ordered import ordered_scan
from colloquy.session import durable

DEFAULT_THRESHOLD = 0.55
PAGE_ROWS = 1000


def topic_boundaries(rows: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Cosine to the segment before, and the running topic number.

    Rows need conv_id, segment_id, segment_index and vector. A similarity below the
    threshold opens a topic. Adds previous_segment_id, similarity (null for the
    first segment), topic_index and position in the topic.
    """
    neighbours = ordered_scan(
        rows,
        ["conv_id"],
        "segment_index",
        sums={"_rank": F.lit(1)},
        previous={"_before": F.col("vector"), "previous_segment_id": F.col("segment_id")},
    )
    # Similarities are written once: the second scan reads numbers, not vectors.
    compared = durable(
        neighbours.withColumn(
            "similarity",
            F.when(
                F.col("previous_segment_id").isNotNull(),
                vectors.cosine(F.col("_before"), F.col("vector")),
            ),
        ).drop("_before", "vector"),
        "similarities",
    )
    opens = F.coalesce((F.col("similarity") < threshold).cast("bigint"), F.lit(0))
    # The rank at which the current topic began is a running maximum.
    begins = F.when((F.col("similarity") < threshold) | F.col("similarity").isNull(), F.col("_rank"))
    return (
        ordered_scan(
            compared, ["conv_id"], "segment_index", sums={"topic_index": opens}, maxes={"_began": begins}
        )
        .withColumn("position", (F.col("_rank") - F.col("_began")).cast("bigint"))
        .drop("_rank", "_began")
    )


def topic_segments(bounded: DataFrame) -> DataFrame:
    return bounded.select(
        ids.topic_id(F.col("conv_id"), F.col("topic_index")).alias("topic_id"), "segment_id", "position"
    )


def topic_plan(bounded: DataFrame) -> DataFrame:
    """First and last segment, size and range label of every topic."""
    return (
        bounded.groupBy("conv_id", "topic_index")
        .agg(
            F.min_by("segment_id", "segment_index").alias("first_segment_id"),
            F.max_by("segment_id", "segment_index").alias("last_segment_id"),
            F.count("*").alias("segment_count"),
        )
        .withColumn("topic_id", ids.topic_id(F.col("conv_id"), F.col("topic_index")))
        .withColumn("segment_range", F.concat_ws("-", "first_segment_id", "last_segment_id"))
    )


def similarity_report(bounded: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Pairs, extremes, mean, boundaries and topics of every conversation."""
    return bounded.groupBy("conv_id").agg(
        F.count("similarity").alias("pairs"),
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.avg("similarity").alias("mean_similarity"),
        F.count_if(F.col("similarity") < threshold).alias("boundaries"),
        (F.max("topic_index") + 1).alias("topics"),
    )


def boundary_labels(bounded: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The report's list of boundaries, one row each: it may be long."""
    return bounded.where(F.col("similarity") < threshold).select(
        "conv_id",
        F.col("previous_segment_id").alias("after_segment_id"),
        F.format_string("after %s (%.2f)", "previous_segment_id", "similarity").alias("label"),
    )


def topic_member_lines(members: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``Segment i: summary`` lines of a topic, in pages of ``page_rows`` members."""
    line = F.concat(F.lit("Segment "), F.col("position").cast("string"), F.lit(": "), F.col("summary"))
    return (
        members.groupBy("conv_id", "topic_index", F.floor(F.col("position") / page_rows).alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("position", line.alias("_line")))).alias("_lines"))
        .select("conv_id", "topic_index", "page", F.array_join(F.transform("_lines", lambda l: l["_line"]), "\n").alias("member_lines"))
    )
