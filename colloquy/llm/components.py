"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from colloquy.llm.common import durable


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and sum of hashes as the write itself saw them."""
    seen = Observation()
    out = durable(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "edges")
    return out, (seen.get["n"], seen.get["s"])


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``: ``(node, component)``.

    Nodes are compared by ``<``; rows with a null end and loops count for nothing;
    nodes without an edge are not in the result. Large-star and small-star rounds
    alternate until nothing changes; their number grows with the logarithm of the
    nodes. Each round is written to the shared folder, so a lost executor costs one
    round. Minima are aggregated before the shuffle, and the join with a hot node's
    neighbours is an equi-join, which adaptive execution splits.
    """
    now, before = _written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = (
            both.join(_nearest(both), "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        ).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = _nearest(down)
        small = (
            down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(low.select("u", "m"))
            .distinct()
        )
        now, after = _written(small)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
