"""Counterfactual-regularised toxicity classifier.

A logistic model over hashed words and word beginnings. For each training text that
mentions an identity group, a second text is made in which each such term is swapped for
the next one of its list; the loss adds the squared difference of both scores. So the
terms themselves cannot carry a score, and neutral mentions of a group stay neutral.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from colloquy.llm.common import Words, durable, hash_of, prepared, slices, table, words_of

#: Labelled rows of each label that a model is fitted on: those of the smallest hash of their id.
SAMPLE_ROWS = 3_000
#: Slots that features are hashed to, and the bytes of a word's beginnings.
SLOTS_BITS = 18
HEADS = (4, 5, 6)
#: A feature is used where its likelihood-ratio statistic between the labels is as large.
EVIDENCE = 11.0
STEPS, RATE, RIDGE = 200, 0.3, 1e-4
#: Weight of the squared difference between a text's score and its counterfactual's.
SWAP_WEIGHT = 4.0

#: Identity terms. Each list is swapped within itself, in this order.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "elderly"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


def identity_slots() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the identity terms, sorted, and of what each is swapped for."""
    pairs = sorted((hash_of(a.encode()), b) for terms in IDENTITY_TERMS for a, b in zip(terms, terms[1:] + terms[:1]))
    return np.array([a for a, _ in pairs], np.uint64), np.array([hash_of(b.encode()) for _, b in pairs], np.uint64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)


def features(words: Words) -> list[np.ndarray]:
    """For each kind of feature the slot of every word; -1 where it has none."""
    out = [_slot(words.hashes)]
    for length in HEADS:
        h = words.heads(length)
        out.append(np.where(h == 0, -1, _slot(h)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Score of each text: the evidence of its distinct features, squashed.

        Words add up by their largest kinds, each slot of a text once, so length does
        not matter. An empty or null text gets the bias alone.
        """
        words = words_of(column)
        text = np.repeat(np.arange(len(column)), np.diff(words.first))
        total = np.full(len(column), self.bias)
        for slots in features(words):
            w = np.where(slots < 0, 0.0, self.weights[slots])
            live = np.flatnonzero(w)
            key = np.unique(text[live] * (1 << SLOTS_BITS) + slots[live])
            total += np.bincount(key >> SLOTS_BITS, self.weights[key & ((1 << SLOTS_BITS) - 1)], len(column))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def design(column: pa.Array, swap: bool) -> list[np.ndarray]:
    """Distinct slots of each text; with ``swap`` those of its counterfactual."""
    words = words_of(column)
    rows = np.repeat(np.arange(len(column)), np.diff(words.first))
    kinds = features(words)
    if swap:
        known, other = identity_slots()
        at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
        same = known[at] == words.hashes
        kinds[0] = np.where(same, _slot(other[at]), kinds[0])
        # The beginnings of a swapped word go too; no text keeps a trace of the term.
        kinds[1:] = [np.where(same, -1, k) for k in kinds[1:]]
    keys = np.unique(np.concatenate([rows[k >= 0] * (1 << SLOTS_BITS) + k[k >= 0] for k in kinds]))
    bounds = np.searchsorted(keys, np.arange(len(column) + 1) * (1 << SLOTS_BITS))
    return [(keys[i:j] & ((1 << SLOTS_BITS) - 1)).astype(np.int32) for i, j in zip(bounds[:-1], bounds[1:])]


def _evidence(rows: np.ndarray, slots: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """G statistic of each slot: how unlike the labels are in whether they have it."""
    have = np.array([np.bincount(slots[y[rows] == k], minlength=size) for k in (0, 1)], float)
    return _statistic(have, np.array([len(y) - y.sum(), y.sum()]))


def _statistic(have: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.zeros(have.shape[1])
    share = (have[0] + have[1]) / total.sum()
    for k in (0, 1):
        for seen, expected in ((have[k], share * total[k]), (total[k] - have[k], (1 - share) * total[k])):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(seen > 0, 2 * seen * np.log(seen / expected), 0)
    return out


def fit(texts: list[str], labels: list[int], swap_weight: float = SWAP_WEIGHT) -> Model:
    """``fit_slots`` on texts."""
    column = pa.array(texts, pa.string())
    return fit_slots(design(column, False), design(column, True), labels, swap_weight)


def fit_slots(
    plain: list[np.ndarray], swapped: list[np.ndarray], labels: list[int], swap_weight: float = SWAP_WEIGHT
) -> Model:
    """Fit in the driver on the slots of labelled texts; both classes weigh the same.

    Features of too little evidence are left out. Without both labels the model
    is a constant: the share of label 1, or 0 if there are no texts.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return constant(y)
    rows = np.repeat(np.arange(len(plain), dtype=np.int32), [len(x) for x in plain])
    used = np.flatnonzero(_evidence(rows, np.concatenate(plain), y, 1 << SLOTS_BITS) >= EVIDENCE)
    return fit_columns([narrow(x, used) for x in plain], [narrow(x, used) for x in swapped], labels, used, swap_weight)


def constant(y: np.ndarray) -> Model:
    share = y.mean() if len(y) else 0.0
    return Model(np.zeros(1 << SLOTS_BITS), float(np.clip(np.log((share + 1e-4) / (1 - share + 1e-4)), -9, 9)))


def narrow(slots: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The places in ``used`` (sorted) of those slots that are there."""
    at = np.searchsorted(used, slots)
    at[at == len(used)] = 0
    return at[used[at] == slots].astype(np.int32) if len(used) else np.zeros(0, np.int32)


def fit_columns(
    plain: list[np.ndarray], swapped: list[np.ndarray], labels: list[int], used: np.ndarray, swap_weight: float = SWAP_WEIGHT
) -> Model:
    """The fit itself, on the columns of the slots ``used`` that each text has."""
    y = np.array(labels, float)
    rows_of = lambda columns: (np.repeat(np.arange(len(columns), dtype=np.int32), [len(x) for x in columns]), np.concatenate(columns))
    (r, c), (rs, cs) = rows_of(plain), rows_of(swapped)
    n, d = len(y), len(used)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    def squash(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    changed = np.zeros(n, bool)
    both = np.bincount(np.concatenate([r, rs]), minlength=n)
    changed[:] = np.bincount(r, weights=c + 1.0, minlength=n) != np.bincount(rs, weights=cs + 1.0, minlength=n)
    swaps = changed & (both > 0)
    for step in range(1, STEPS + 1):
        p = squash(np.bincount(r, w[c], n) + b)
        q = squash(np.bincount(rs, w[cs], n) + b)
        error = balance * (p - y)
        apart = np.where(swaps, swap_weight * (p - q) / max(1, swaps.sum()), 0.0)
        push, pull = error + apart * p * (1 - p), -apart * q * (1 - q)
        grad = np.bincount(c, push[r], d) + np.bincount(cs, pull[rs], d) + RIDGE * w
        full = np.append(grad, push.sum() + pull.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (STEPS + 1))
        w = w - move[:-1]
        b -= move[-1]
    weights = np.zeros(1 << SLOTS_BITS)
    weights[used] = w
    return Model(weights, float(b))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents of each label, none of them held out.

    The rows are those whose ids hash smallest. Rows without label or id are not used;
    an id with both labels counts as 1.
    """
    usable = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    )
    # A share of each label by hash first, with room to spare: what is ordered then has
    # about ``rows`` rows, however many labels there are.
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    lowest = [
        usable.where((F.col("toxic") == label) & (drawn < (1.5 * rows + 100) / count)).orderBy(drawn, "doc_id").limit(rows)
        for label, count in sorted(counts.items())
    ]
    if not lowest:
        return constant(np.zeros(0))
    chosen = durable(reduce(DataFrame.unionByName, lowest).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "sample")
    # At most 2 * rows ids are broadcast; texts stay where they are. Of several texts of an
    # id the one of the least digest counts, so there are no more texts than ids.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    least = F.min(F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text", "toxic")).alias("one")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            both = [pa.array(design(batch.column(0), swap), pa.list_(pa.int32())) for swap in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *both], names=["key", "toxic", "plain", "swapped"])

    keyed = found.groupBy("doc_id").agg(least).select("one.text", F.xxhash64("doc_id", "one.text").alias("key"), "one.toxic")
    design_rows = durable(keyed.mapInArrow(slots, "key bigint, toxic int, plain array<int>, swapped array<int>"), "slots")
    # Evidence is counted on Spark: the driver sees two counts a slot, then the few slots
    # of each text that have evidence.
    totals = design_rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, toxic = totals[0], totals[1] or 0
    if toxic in (0, n):
        return constant(np.repeat([0.0, 1.0], [n - toxic, toxic]))
    per_slot = design_rows.select(F.explode("plain").alias("slot"), "toxic").groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    seen = per_slot.toArrow()
    have = np.zeros((2, 1 << SLOTS_BITS))
    at = seen.column("slot").to_numpy()
    have[1, at] = seen.column("t").to_numpy()
    have[0, at] = seen.column("n").to_numpy() - have[1, at]
    used = np.flatnonzero(_statistic(have, np.array([n - toxic, toxic], float)) >= EVIDENCE)

    def evident(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [pa.array([narrow(np.array(x, np.int64), used) for x in batch.column(c).to_pylist()], pa.list_(pa.int32())) for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *both], names=["key", "toxic", "plain", "swapped"])

    data = design_rows.mapInArrow(evident, design_rows.schema).toArrow().sort_by("key")
    return fit_columns(_lists(data.column("plain")), _lists(data.column("swapped")), data.column("toxic").to_pylist(), used)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Lists of integers as views of one array: the driver holds four bytes a number."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        offsets = chunk.offsets.to_numpy()
        if len(chunk):
            values = chunk.values.to_numpy()[offsets[0] : offsets[-1]]
            out += np.split(values, offsets[1:-1] - offsets[0])
    return out


def scorer(spark, model: Model):
    """A column function ``text -> score``; the model (2 MB) is sent to each executor once."""
    shared = prepared(spark).sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            column = pa.array(part, pa.large_string(), from_pandas=True)
            out = np.empty(len(column))
            for i in range(0, len(column), 128):
                out[i : i + 128] = shared.value.scores(column.slice(i, 128))
            yield pd.Series(out)

    return lambda text: score(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` as one column ``doc``, with its ``score``; nothing but the text is read.

    Every row keeps its score, repeated rows the same one; null and empty texts get the
    model's bias. Names of other columns play no part.
    """
    prepared(docs.sparkSession)
    model = train(docs, labels)
    score = scorer(docs.sparkSession, model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.withColumn("score", score(F.col("doc.text")))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, and whether its id was held out of training."""
    docs = table(prepared(spark), sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "doc.doc_id",
        held_out(F.col("doc.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
