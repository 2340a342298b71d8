"""Linearising conversation trees by pointer doubling.

A walk of n steps takes ⌈log₂ n⌉ rounds of equal-key joins. Nodes whose walk has
ended leave the jump table, so short conversations cost nothing in later rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.operators.ordered import ordered_scan
from colloquy.session import durable

ROUNDS_PER_CUT = 6


def _walk(steps: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """All nodes reached from ``starts`` along ``steps`` with their first distance.

    ``steps``: conv_id, node_id, next_id. ``longest`` bounds the rounds, so a cycle
    ends; a node met twice keeps its first distance.
    """
    reached = starts.select("conv_id", "node_id", F.lit(0).cast("bigint").alias("distance"))
    # One row per node: repeated edges would multiply in every round.
    single = steps.where("next_id is not null").groupBy("conv_id", "node_id").agg(F.min("next_id").alias("next_id"))
    jumps = durable(single, "jumps")
    stride, rounds = 1, 0
    while stride < longest:
        hop = jumps.withColumnRenamed("next_id", "_to")
        here = F.struct("node_id", "distance")
        there = F.struct(F.col("_to").alias("node_id"), (F.col("distance") + stride).alias("distance"))
        # One reference to the nodes reached so far, so the plan grows by one join.
        reached = (
            reached.join(hop, ["conv_id", "node_id"], "left")
            .select("conv_id", F.explode(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("_n"))
            .select("conv_id", "_n.node_id", "_n.distance")
        )
        stride, rounds = stride * 2, rounds + 1
        if rounds % ROUNDS_PER_CUT == 0:
            reached = durable(_nearest(reached), "reached")
        if stride < longest:
            ahead = jumps.select("conv_id", F.col("node_id").alias("_to"), F.col("next_id").alias("_next"))
            jumps = durable(
                hop.join(ahead, ["conv_id", "_to"]).select("conv_id", "node_id", F.col("_next").alias("next_id")),
                "jumps",
            )
            if jumps.isEmpty():
                break
    return _nearest(reached)


def _nearest(reached: DataFrame) -> DataFrame:
    return reached.groupBy("conv_id", "node_id").agg(F.min("distance").alias("distance"))


def _longest(nodes: DataFrame) -> int:
    """Node count of the largest conversation: no walk has more steps."""
    counts = nodes.groupBy("conv_id").agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def _positions(path: DataFrame, order: str) -> DataFrame:
    return ordered_scan(path, ["conv_id"], order, sums={"_rank": F.lit(1)}).select(
        "conv_id", "node_id", (F.col("_rank") - 1).cast("bigint").alias("position")
    )


def active_path(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """Root-to-head path of every conversation: conv_id, node_id, position.

    ``nodes``: conv_id, node_id, parent_id. ``heads``: conv_id, node_id; heads that
    are not nodes are ignored. The walk stops at a parent that is not a node.
    """
    known = nodes.select("conv_id", F.col("node_id").alias("parent_id"))
    steps = nodes.select("conv_id", "node_id", "parent_id").join(known, ["conv_id", "parent_id"], "left_semi")
    present = heads.select("conv_id", "node_id").join(nodes.select("conv_id", "node_id"), ["conv_id", "node_id"], "left_semi")
    reached = _walk(steps.select("conv_id", "node_id", F.col("parent_id").alias("next_id")), present, _longest(nodes))
    # Far ancestors come first. Path steps are gap-free, so negative ones chunk well.
    return _positions(reached.withColumn("_order", -F.col("distance")), "_order")


def last_child_path(nodes: DataFrame) -> DataFrame:
    """Fallback path: first parentless node in map order, then each last child.

    ``nodes``: conv_id, node_id, parent_id, map_position, children. Children that
    are not nodes are passed over; a cycle ends the walk.
    """
    known = nodes.select("conv_id", F.col("node_id").alias("child_id"))
    children = nodes.select("conv_id", "node_id", F.posexplode("children").alias("_n", "child_id"))
    steps = (
        children.join(known, ["conv_id", "child_id"], "left_semi")
        .groupBy("conv_id", "node_id")
        .agg(F.max_by("child_id", "_n").alias("next_id"))
    )
    roots = (
        nodes.where("parent_id is null")
        .groupBy("conv_id")
        .agg(F.min_by("node_id", "map_position").alias("node_id"))
    )
    return _positions(_walk(steps, roots, _longest(nodes)), "distance")


def conversation_paths(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """The active path where the head is a node, the fallback elsewhere."""
    present = heads.join(nodes.select("conv_id", "node_id"), ["conv_id", "node_id"], "left_semi")
    headless = nodes.join(present.select("conv_id"), "conv_id", "left_anti")
    return active_path(nodes, present).unionByName(last_child_path(headless))


def branch_stats(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """Nodes on and off the path per conversation."""
    totals = nodes.groupBy("conv_id").agg(F.count("*").alias("nodes"))
    on_path = path.groupBy("conv_id").agg(F.count("*").alias("on_path"))
    return totals.join(on_path, "conv_id", "left").select(
        "conv_id",
        "nodes",
        F.coalesce("on_path", F.lit(0)).alias("on_path"),
        (F.col("nodes") - F.coalesce("on_path", F.lit(0))).alias("off_path"),
    )


def cycles(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """Conversations whose parent walk never reaches a node without a known parent."""
    path = active_path(nodes, heads).select("conv_id", "node_id")
    known = nodes.select("conv_id", F.col("node_id").alias("parent_id"))
    ends = nodes.join(known, ["conv_id", "parent_id"], "left_anti").select("conv_id", "node_id")
    ended = path.join(ends, ["conv_id", "node_id"], "left_semi").select("conv_id").distinct()
    return path.select("conv_id").distinct().join(ended, "conv_id", "left_anti")
