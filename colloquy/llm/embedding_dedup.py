"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Only vectors of one label are compared. Equal vectors of a label are one class from the
start. Each class belongs to the cell of its nearest centre; cells are fitted on a
bounded sample, all vectors are assigned. A vector within distance d of another one
(d^2 = 2 - 2 cos) that lies beyond the plane between two centres is itself at most d
from that plane. So a vector is compared in its own cell, and as a guest in every cell
whose plane is that near: no link is lost, however poor the cells are.

A cell is cut into blocks of bounded size, and a task holds two blocks at a time: their
product yields for each vector how many it is linked to, and enough links to connect
what is connected, never a list of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from colloquy.llm.common import durable, prepared, table
from colloquy.llm.components import components

NEAR = 0.98
#: Sampled vectors that centres are fitted on, centres of all labels together, vectors
#: that a cell is meant to have, and vectors of a block.
SAMPLE_ROWS, MAX_CENTRES, CELL_ROWS, BLOCK_ROWS = 20_000, 1_024, 4_000, 1_024
#: Rounding of the products of two unit vectors in double precision stays far below this.
SLACK = 1e-7


def unit_vectors(found: DataFrame, vector: str) -> DataFrame:
    """Rows of ``found`` with a ``unit`` vector of doubles; null where there is none."""
    d = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.array_max(F.transform(d, F.abs))
    # Divide by the largest component first: squares of huge or tiny numbers stay finite.
    scaled = F.transform(d, lambda x: x / F.col("__top"))
    norm = F.sqrt(F.aggregate("__scaled", F.lit(0.0), lambda a, x: a + x * x))
    good = F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)) & (F.size(vector) > 0)
    return (
        found.withColumn("__top", F.when(good, top))
        .withColumn("__scaled", F.when(F.col("__top") > 0, scaled))
        .withColumn("__norm", norm)
        .withColumn("unit", F.transform("__scaled", lambda x: x / F.col("__norm")))
        .drop("__top", "__scaled", "__norm")
    )


def fit_centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means: centres are means of their vectors, of length one."""
    k = max(1, min(k, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return np.unique(centres, axis=0)


def _cells(vectors: np.ndarray, centres: np.ndarray, near: float) -> tuple[np.ndarray, list[list[int]]]:
    """Cell of each vector, and the other cells in which it is a guest."""
    if len(centres) == 1:
        return np.zeros(len(vectors), int), [[] for _ in vectors]
    dots = vectors @ centres.T
    home = dots.argmax(1)
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    beyond = dots[np.arange(len(dots)), home][:, None] - dots
    reach = np.sqrt(2 - 2 * near) + SLACK
    close = beyond <= reach * apart[home] + SLACK
    close[np.arange(len(dots)), home] = False
    return home, [np.flatnonzero(row).tolist() for row in close]


def _centres(classes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Centres of each label and width, from a bounded sample over all of them."""
    sample = (
        classes.select("label", F.size("unit").alias("width"), "unit", "id")
        .orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    )
    largest = (
        classes.groupBy("label", F.size("unit").alias("width")).count()
        .orderBy(F.desc("count"), "label", "width").limit(MAX_CENTRES).collect()
    )
    total = {(r["label"], r["width"]): r["count"] for r in largest}
    room = max(1, MAX_CENTRES // max(1, len(total)))
    return {
        key: fit_centres(np.stack(part["unit"].to_numpy()), min(room, -(-total[key] // CELL_ROWS)))
        for key, part in sample.groupby(["label", "width"]) if key in total
    }


def _local_links(near: np.ndarray, a: list, b: list) -> list[tuple]:
    """Links that connect what ``near`` connects: each to the first of its group."""
    rows, columns = np.nonzero(near)
    label = np.arange(len(a) + len(b))
    while True:
        m = np.minimum(label[rows], label[len(a) + columns])
        new = label.copy()
        np.minimum.at(new, rows, m)
        np.minimum.at(new, len(a) + columns, m)
        if (new == label).all():
            break
        label = new
    ids, out = [*a, *b], []
    for i in np.flatnonzero(label != np.arange(len(label))):
        if ids[i] != ids[label[i]]:
            out.append((ids[i], ids[label[i]]))
    return out


def _name_of(rows: DataFrame, label: str) -> F.Column:
    """A label of any type as text; equal labels, such as 0.0 and -0.0, have equal texts."""
    plain = F.col(label)
    fraction = rows.select(plain).schema[0].dataType.typeName() in ("float", "double")
    return (plain + F.lit(0.0) if fraction else plain).cast("string")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", near: float = NEAR) -> DataFrame:
    """One row per id: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors are linked if their labels, of any type, are equal and not null and their cosine is at
    least ``near``. Null, zero and empty vectors, and those with null or non-finite
    components, link with nothing; nor do vectors of different widths. Ids are taken to
    be unique: a repeated id stands for each of its rows; rows with a null id go.
    Other columns play no part.
    """
    spark = prepared(vectors.sparkSession)
    rows = unit_vectors(
        vectors.select(F.col(key).alias("id"), _name_of(vectors, label).alias("label"), F.col(vector).alias("vector")).where("id is not null"),
        "vector",
    )
    rows = durable(rows.withColumn("same", F.when(F.col("unit").isNotNull() & F.col("label").isNotNull(), F.sha2(F.to_json("vector").cast("binary"), 256))).drop("vector"), "units")
    able = rows.where("same is not null")
    classes = durable(able.groupBy("label", "same").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("unit").alias("unit")), "vector-classes")
    shared = spark.sparkContext.broadcast(_centres(classes))
    default = {"home": 0, "guests": []}

    @pandas_udf("home int, guests array<int>")
    def assign(labels: pd.Series, units: pd.Series) -> pd.DataFrame:
        out = [default] * len(labels)
        groups: dict[tuple, list[int]] = {}
        for i, (l, u) in enumerate(zip(labels, units)):
            groups.setdefault((l, len(u)), []).append(i)
        for name, at in groups.items():
            if name in shared.value:
                home, guests = _cells(np.stack([units[i] for i in at]), shared.value[name], near)
                for i, h, g in zip(at, home, guests):
                    out[i] = {"home": int(h), "guests": g}
        return pd.DataFrame(out)

    placed = classes.withColumn("cell", assign("label", "unit")).select(
        "label", F.size("unit").alias("width"), "id", "n", "unit", F.col("cell.home").alias("home"), F.col("cell.guests").alias("guests")
    )
    placed = durable(placed, "cells")
    # Rows of a cell, and so its blocks: counted before any row is moved.
    blocks = placed.groupBy("label", "width", F.col("home").alias("cell")).agg(
        F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")
    )
    cell = ["label", "width", "cell"]
    own = placed.withColumnRenamed("home", "cell").join(blocks, cell).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # A pair of blocks is one task's work: (block, other) with block <= other. Members
    # go to every pair of their block; guests meet every block of the cell they visit.
    member = own.select(
        *cell, "id", "n", "unit", F.lit(False).alias("guest"), "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        *cell, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "guest", "block", "id", "n", "unit"
    )
    visits = placed.select("label", "width", F.explode("guests").alias("cell"), "id", "n", "unit").join(blocks, cell)
    # Guests are dealt over blocks of their own, negative ones, of about a block's size.
    guest_blocks = visits.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("guest_blocks"))
    guests = (
        visits.join(guest_blocks, cell)
        .withColumn("block", -1 - F.pmod(F.xxhash64("id"), F.col("guest_blocks")).cast("int"))
        .select(*cell, F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("guest"), "block", "id", "n", "unit")
    )
    # Members a guest block meets: their block once more for each guest block.
    hosts = (
        own.join(guest_blocks, cell)
        .select(*cell, F.explode(F.sequence(-F.col("guest_blocks"), F.lit(-1))).alias("i"), F.col("block").alias("j"), F.lit(False).alias("guest"), "block", "id", "n", "unit")
    )
    work = member.union(guests).union(hosts)
    kind = rows.schema["id"].dataType.simpleString()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iat[0], part["j"].iat[0]
        left, right = (part[part["block"] == i], part[part["block"] == j]) if i != j else (part, part)
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "links": [], "other": []})
        close = np.stack(left["unit"].to_numpy()) @ np.stack(right["unit"].to_numpy()).T >= near
        if i == j:
            np.fill_diagonal(close, False)
        a, b = left["id"].tolist(), right["id"].tolist()
        counts = [(x, c, None) for x, c in zip(a, close @ right["n"].to_numpy()) if c]
        if i >= 0 and i != j:
            counts += [(x, c, None) for x, c in zip(b, close.T @ left["n"].to_numpy()) if c]
        links = [(x, 0, y) for x, y in _local_links(close, a, b)]
        return pd.DataFrame(counts + links, columns=["id", "links", "other"]).astype({"other": "object"})

    found = durable(work.groupBy(*cell, "i", "j").applyInPandas(compare, f"id {kind}, links bigint, other {kind}"), "vector-links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    ends = (
        classes.select("label", "same", "id", "n").join(linked, "id", "left")
        .join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    return (
        rows.select("id", "label", "same").join(ends, ["label", "same"], "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(key) == F.col("component_id"))
    )


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_duplicates(table(prepared(spark), sf_dir, "embeddings"))
