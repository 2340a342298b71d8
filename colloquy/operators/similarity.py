"""Near-duplicate and drift operators on shingle sets.

Equal sets are folded into one class first. Classes are then compared only where
they share one of their rarest shingles: two sets with J >= t always share one of
the first |x| - ceil(t|x|) + 1 shingles in a common order (prefix filtering), so the
result is exact while a group is never paired with itself as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import text as tx
from colloquy.session import durable

# Thresholds of the drift rules.
NEAR_DUPLICATE = 0.70
SHINGLE_WORDS = 5
MAX_NEAR_DUPLICATE_PAIRS = 5
GRAM_WORDS = 4
MIN_STATEMENTS_FOR_GRAM = 6
MIN_GRAM_STATEMENTS = 5


def hashed_shingles(text: Column) -> Column:
    """Sorted 64-bit hashes of a text's shingles: a set is moved and compared as numbers.

    Sets are only compared inside one group, where a collision is out of reach. The
    words of a shingle are hashed one after the other; a shorter text is one shingle.
    """

    def hashes(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE_WORDS, F.lit(0)))
        return F.when(
            F.size(w) > 0,
            F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE_WORDS)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(F.array_distinct(tx.let(tx.words(text), hashes)))


def shingle_classes(rows: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """One row per distinct shingle set of a group: its size, first and last row."""
    # A filter on the shingles would compute them once more.
    return (
        rows.where(tx.has_words(F.col(text)))
        .select(
            *group,
            F.col(order).alias("_at"),
            hashed_shingles(F.col(text)).alias("shingles"),
        )
        .groupBy(*group, "shingles")
        .agg(
            F.count("*").alias("members"),
            F.min("_at").alias("first_at"),
            F.max("_at").alias("last_at"),
        )
    )


def _prefixes(classes: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """The rarest shingles of each class, enough of them to meet any near copy.

    Any order shared by all classes is exact; rare ones first give few candidates. The
    rarest are those of one class alone: they meet nobody, so they are only counted.
    """
    terms = classes.select(*group, "first_at", F.size("shingles").alias("_size"), F.explode("shingles").alias("_term"))
    own = Window.partitionBy(*group, "first_at")
    shared = (
        terms.withColumn("_uses", F.count("*").over(Window.partitionBy(*group, "_term")))
        .where("_uses > 1")
        .withColumn("_rank", F.row_number().over(own.orderBy("_uses", "_term")))
        .withColumn("_rank", F.col("_rank") + F.col("_size") - F.count("*").over(own))
    )
    keep = F.col("_size") - F.ceil(F.lit(threshold) * F.col("_size") - 1e-9) + 1
    return shared.where(F.col("_rank") <= keep).select(*group, "first_at", "_size", "_term")


def near_duplicate_classes(
    classes: DataFrame, group: list[str], threshold: float = NEAR_DUPLICATE
) -> DataFrame:
    """Pairs of different classes with J >= ``threshold``: (group, a, b, jaccard)."""
    left = durable(_prefixes(classes, group, threshold), "prefixes")
    right = left.withColumnsRenamed({"first_at": "_b", "_size": "_b_size"})
    smaller, larger = F.least("_size", "_b_size"), F.greatest("_size", "_b_size")
    candidates = (
        left.join(right, [*group, "_term"])
        .where((F.col("first_at") < F.col("_b")) & (smaller >= F.lit(threshold) * larger - 1e-9))
        .select(*group, F.col("first_at").alias("_a"), "_b")
        .distinct()
    )
    sides = classes.select(*group, "first_at", "shingles")
    return (
        candidates.join(sides.withColumnsRenamed({"first_at": "_a", "shingles": "_sa"}), [*group, "_a"])
        .join(sides.withColumnsRenamed({"first_at": "_b", "shingles": "_sb"}), [*group, "_b"])
        .withColumn("jaccard", tx.jaccard(F.col("_sa"), F.col("_sb")))
        .where(F.col("jaccard") >= threshold)
        .select(*group, F.col("_a").alias("a"), F.col("_b").alias("b"), "jaccard")
    )


def near_dup_pairs(
    statements: DataFrame, group: str = "extract_id", order: str = "statement_index", text: str = "text"
) -> DataFrame:
    """Near-duplicate statements of an extract, by class of equal shingle sets.

    ``pairs`` is how many statement pairs a row stands for: equal copies of one
    class (a = b), or all pairs across two near classes. The sum is the pair count.
    """
    classes = durable(shingle_classes(statements, [group], order, text), "classes")
    counted = classes.select(group, "first_at", "members")
    within = counted.where("members > 1").select(
        group,
        F.col("first_at").alias("a"),
        F.col("first_at").alias("b"),
        F.lit(1.0).alias("jaccard"),
        F.expr("members * (members - 1) div 2").alias("pairs"),
    )
    across = (
        near_duplicate_classes(classes, [group])
        .join(counted.withColumnsRenamed({"first_at": "a", "members": "_na"}), [group, "a"])
        .join(counted.withColumnsRenamed({"first_at": "b", "members": "_nb"}), [group, "b"])
        .select(group, "a", "b", "jaccard", (F.col("_na") * F.col("_nb")).alias("pairs"))
    )
    return within.unionByName(across)


def dominant_ngram(
    statements: DataFrame, group: str = "extract_id", text: str = "text"
) -> DataFrame:
    """The 4-gram found in most statements of an extract, and whether it is drift."""
    lowered = tx.words(F.col(text))
    grams = (
        statements.select(group, F.explode(tx.ngrams(lowered, GRAM_WORDS)).alias("gram"))
        .groupBy(group, "gram")
        .agg(F.count("*").alias("statements_with"))
        .groupBy(group)
        .agg(F.min(F.struct((-F.col("statements_with")).alias("_n"), "gram")).alias("_top"))
    )
    totals = statements.groupBy(group).agg(F.count("*").alias("statement_count"))
    limit = F.greatest(F.lit(MIN_GRAM_STATEMENTS), F.floor(F.col("statement_count") / 2))
    return (
        totals.join(grams, group)
        .withColumn("statements_with", -F.col("_top._n"))
        .select(
            group,
            F.col("_top.gram").alias("gram"),
            "statements_with",
            "statement_count",
            (
                (F.col("statement_count") >= MIN_STATEMENTS_FOR_GRAM)
                & (F.col("statements_with") >= limit)
            ).alias("is_drift"),
        )
    )


def near_duplicate_turns(turns: DataFrame, key: str = "id") -> DataFrame:
    """(key, turn_index) of assistant turns that a later turn of their run repeats.

    Rows as from ``split_by_message``. A run is a stretch of assistant turns; one
    run is part of one segment text. Of equal turns all but the last go at once,
    so only the last of each class is compared further.
    """
    order = Window.partitionBy(key).orderBy("turn_index")
    runs = durable(_assistant_runs(turns, key, order), "runs")
    group = [key, "_run"]
    same = Window.partitionBy(*group, "_shingles")
    copies = (
        runs.withColumn("_last", F.max("turn_index").over(same))
        .where(F.col("turn_index") < F.col("_last"))
        .select(key, "turn_index")
    )
    last_ones = runs.groupBy(*group, F.col("_shingles").alias("shingles")).agg(
        F.max("turn_index").alias("first_at")
    )
    near = near_duplicate_classes(last_ones, group).select(key, F.col("a").alias("turn_index"))
    return copies.unionByName(near).distinct()


def _assistant_runs(turns: DataFrame, key: str, order) -> DataFrame:
    """Turns of assistant runs of two or more, with their shingles."""
    return (
        turns.withColumn("_run", F.sum(F.when(F.col("speaker") != "assistant", 1).otherwise(0)).over(order))
        .where("speaker = 'assistant'")
        .withColumn("_run_size", F.count("*").over(Window.partitionBy(key, "_run")))
        .where(F.col("_run_size") > 1)
        .where(tx.has_words(F.col("body")))
        .select(
            key,
            "_run",
            "turn_index",
            hashed_shingles(F.col("body")).alias("_shingles"),
        )
    )


def dedup_assistant_turns(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Drop repeated assistant turns and render the rest again.

    Adds ``dropped_turns``. A text that loses nothing is returned as it was.
    """
    from colloquy.operators.blocks import message_array

    # Most texts have no two assistant turns in a row: they never leave their row.
    speakers = F.array_join(F.transform("_turns", lambda m: m["speaker"]), ",")
    turns = (
        texts.select(key, message_array(F.col(text)).alias("_turns"))
        .where(speakers.contains("assistant,assistant"))
        .select(key, F.posexplode("_turns").alias("turn_index", "_m"))
        .select(key, "turn_index", "_m.speaker", "_m.body")
    )
    dropped = (
        near_duplicate_turns(turns, key)
        .groupBy(key)
        .agg(F.collect_set("turn_index").alias("_gone"))
    )
    rendered = F.array_join(
        F.transform(
            F.filter(message_array(F.col(text)), lambda m, i: ~F.array_contains("_gone", i)),
            lambda m: F.concat(m["speaker"], F.lit(": "), m["body"]),
        ),
        "\n\n",
    )
    return texts.join(dropped, key, "left").select(
        *[c for c in texts.columns if c != text],
        F.when(F.col("_gone").isNull(), F.col(text)).otherwise(rendered).alias(text),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("dropped_turns"),
    )
