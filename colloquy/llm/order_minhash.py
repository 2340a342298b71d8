"""Near-duplicate documents by order MinHash and banded alignment.

Texts are sequences of 5-word shingles, each labelled with its occurrence number, so that
a shingle that repeats is several different elements. One sketch of order MinHash takes
the ``ORDER`` elements that a random hash puts first and keeps them in text order; two
texts share it with a probability that falls with their edit distance, also where they
hold the same shingles in another order. ``ROWS`` sketches make a band; texts with an
equal band are candidates.

A candidate pair is verified exactly: with A the longest common subsequence of labelled
shingles, similarity is A / (n + m - A), at least 0.8. An alignment further than
(n + m) / 9 off the diagonal cannot reach 0.8; the band is that of 0.6, which the last step needs.
1 - similarity is a metric, which is what spares comparisons inside a group.

No group is ever expanded into pairs. Equal word sequences are one class from the start.
The texts of a band are compared with the smallest of them, its hub. A text just outside
the hub's reach (distance up to 0.4) can still be near one that is inside, as far as the
triangle inequality allows; where the links found so far leave both apart, these are
compared in blocks of bounded size: a task compares two blocks in place and yields links
only, enough to join what is to be joined. Groups that the links connect by then need no
more work; in the others, the texts that are not near the hub, mostly not alike at all,
are compared with each other in such blocks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import Words, durable, mixed, prepared, slices, table, words_of
from colloquy.llm.components import components

SHINGLE = 5
NEAR = 0.8
#: Elements of a sketch, sketches of a band, and bands. At similarity 0.8 two sketches
#: agree with about 0.64, so a pair is missed with (1 - 0.64^2)^24, or 3 in a million.
ORDER, ROWS, BANDS = 2, 2, 24
#: Texts of a block.
BLOCK_ROWS = 128
_SEEDS = np.random.default_rng(6).integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; one for a shorter text, none without words."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = out * np.uint64(0xA24BAED4963EE407) + words[i : i + n]
    return mixed(out)


def labelled(shingled: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence numbers mixed in, so that none repeats."""
    order = np.argsort(shingled, kind="stable")
    s = shingled[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    if new.all():
        return shingled
    at = np.arange(len(s))
    number = np.empty(len(s), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(number == 0, shingled, mixed(shingled + number * np.uint64(0x9FB21C651E98DF25)))


def bands(elements: np.ndarray) -> list[int]:
    """One hash for each band of order sketches; none if there are too few elements."""
    if len(elements) < 4:  # 0.8 cannot be reached but by an equal text
        return []
    sketches = np.empty((ROWS * BANDS, ORDER), np.uint64)
    step = max(1, (1 << 18) // len(elements))
    for i in range(0, len(_SEEDS), step):
        h = elements[None, :] * _SEEDS[i : i + step, None]
        h ^= h >> np.uint64(32)
        first = h.argmin(1)
        rows = np.arange(len(h))
        h[rows, first] = np.uint64(2**64 - 1)
        second = h.argmin(1)
        places = np.sort(np.stack([first, second], 1), 1)
        sketches[i : i + step] = elements[places]
    out = np.zeros(BANDS, np.uint64)
    for part in sketches.reshape(BANDS, ROWS * ORDER).T:
        out = mixed(out * np.uint64(0xA24BAED4963EE407) + part)
    return mixed(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two texts by their labelled shingles; 0 if below what matters.

    Elements of a text are distinct, so the longest common subsequence is the longest
    rising run of matched places. Distances over 0.4 need no exact value: 0 is returned.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < 0.6 * max(n, m):
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    place = order[at]
    same = b[place] == a
    # Similarity s needs A = s (n + m) / (1 + s), so n + m - 2 A places are unmatched.
    far = (n + m) * (1 - 0.6) / (1 + 0.6)
    same &= np.abs(place - np.arange(n)) <= far
    run = place[same]
    if len(run) < 0.6 / 1.6 * (n + m) - 1e-9:
        return 0.0
    if (run[1:] > run[:-1]).all():
        common = len(run)
    else:
        tails: list[int] = []
        for x in run.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    found = common / (n + m - common)
    return found if found >= 0.6 else 0.0


def _elements(words: Words, i: int) -> np.ndarray:
    return labelled(shingles(words.hashes[words.first[i] : words.first[i + 1]]))


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, mark (of the text), same (of the word sequence), n (shingles), bands`` of every row with an id.

    Texts without words are told apart by their characters, null being empty.
    """
    found = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = words_of(batch.column(1))
            marks, same, sizes, found_bands = [], [], [], []
            for i in range(batch.num_rows):
                own = words.hashes[words.first[i] : words.first[i + 1]]
                raw = words.data[words.offsets[i] : words.offsets[i + 1]]
                marks.append(hashlib.md5(raw).hexdigest())
                same.append(hashlib.blake2b((own if len(own) else raw).tobytes(), digest_size=16).digest())
                elements = labelled(shingles(own))
                sizes.append(len(elements))
                found_bands.append(bands(elements))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.string()), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found_bands, pa.list_(pa.int64()))],
                names=["id", "mark", "same", "n", "bands"],
            )

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, mark string, same binary, n bigint, bands array<bigint>")


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Distance of each pair ``(a, b)``: 1 where it is over 0.4. ``texts`` has ``id, text``.

    Both joins are equi-joins on ids; the second leaves the rows sorted by ``a``, whose
    elements are made once for a run of rows.
    """
    left = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, 3), 2):
            hubs, words = words_of(batch.column(2)), words_of(batch.column(3))
            out, last = [], None
            for i, a in enumerate(batch.column(0).to_pylist()):
                if not i or a != last:
                    last, kept = a, _elements(hubs, i)
                out.append(1.0 - similarity(kept, _elements(words, i)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "d"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, d double")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per id: ``key``, ``n_shingles``, ``class_id``, ``kept``.

    ``class_id`` is the smallest id reachable by links; ``kept`` marks that document.
    Ids are taken to be unique: rows that repeat an id are one document, told by the
    text of smallest md5; rows with a null id are left out. Null texts are empty;
    texts without words are near nothing but their equals. Other columns play no part.
    """
    spark = prepared(docs.sparkSession)
    signed = durable(sketch(docs, key, text), "sketches")
    signed = signed.groupBy("id").agg(F.min(F.struct("mark", "same", "n", "bands")).alias("s")).select("id", "s.*")
    copies = durable(signed.groupBy("same").agg(F.min(F.struct("id", "n", "bands")).alias("s")).select("same", "s.*"), "classes")
    bucketed = copies.select(F.explode("bands").alias("bucket"), "id", "n")
    # Only buckets of two texts or more; the count is aggregated before its shuffle.
    shared = bucketed.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = durable(bucketed.join(shared, "bucket").select("bucket", "id", "n"), "members")
    wanted = members.select("id").distinct()
    texts = durable(
        docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        .join(wanted, "id").groupBy("id").agg(F.min_by("text", F.md5("text")).alias("text")),
        "candidates",
    )
    roots = copies.select("same", F.col("id").alias("class_id"))
    if not members.isEmpty():
        classes = _linked(members, texts)
        joined = copies.select("same", "id").join(classes.withColumnRenamed("node", "id"), "id", "left")
        roots = joined.select("same", F.coalesce("component", "id").alias("class_id"))
    return (
        signed.select("id", "same", "n").join(roots, "same")
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
    )


def _linked(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Classes ``(node, component)`` of the texts that are near another of their bucket."""
    hubs = members.groupBy("bucket").agg(F.min("id").alias("hub"))
    rest = members.join(hubs, "bucket").where("id <> hub")
    found = durable(_compare(rest.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), texts), "compared")
    near = F.col("d") <= 1 - NEAR + 1e-9
    known = durable(rest.join(found.withColumnsRenamed({"a": "hub", "b": "id"}), ["hub", "id"]), "known")
    links = found.where(near).select("a", "b")
    classes = durable(components(links), "near-classes")
    more = _outside(known, classes, texts)
    if not more.isEmpty():
        links = durable(links.union(more), "links")
        classes = durable(components(links), "near-classes")
    more = _rest(_apart(known.where(~near).select("bucket", "id"), classes), texts)
    if not more.isEmpty():
        classes = durable(components(links.union(more)), "near-classes")
    return classes


def _apart(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the groups that hold two classes or more, with their ``class``."""
    named = members.join(classes.withColumnRenamed("node", "id"), "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("class")
    )
    named = durable(named, "members")
    several = named.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    return durable(named.join(several.select("bucket"), "bucket"), "members")


def _common(elements: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of some texts share."""
    owner = np.repeat(np.arange(len(elements)), [len(e) for e in elements])
    _, column, counts = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[column]
    owner, column = owner[column >= 0], column[column >= 0]
    out = np.zeros((len(elements), len(elements)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        held = np.zeros((len(elements), 4096), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        out += held @ held.T
    return out


def _block_links(part: pd.DataFrame, allowed: np.ndarray) -> pd.DataFrame:
    """Links among the allowed pairs of a block's texts that join what is apart."""
    words = words_of(pa.array(part["text"]))
    elements = [_elements(words, k) for k in range(len(part))]
    size = np.array([len(e) for e in elements])
    group, ids, out = part["class"].to_numpy().copy(), part["id"].tolist(), []
    allowed = allowed & (group[:, None] != group[None, :])
    enough = _common(elements) >= NEAR / (1 + NEAR) * (size[:, None] + size[None, :]) - 1e-3
    for x, y in np.argwhere(np.triu(allowed & enough, 1)):
        if group[x] != group[y] and similarity(elements[x], elements[y]) >= NEAR - 1e-9:
            out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
            # One link connects both classes here; the others follow from it.
            group[group == group[y]] = group[x]
    return pd.DataFrame(out, columns=["a", "b"]) if out else pd.DataFrame({"a": part["id"][:0], "b": part["id"][:0]})


def _rest(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of a group that are in different classes so far."""
    blocks = members.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    dealt = (
        members.join(blocks, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "class")
        .join(texts, "id")
    )
    kind = members.schema["id"].dataType.simpleString()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        block = part["block"].to_numpy()
        return _block_links(part, (part["i"].iat[0] == part["j"].iat[0]) | (block[:, None] != block[None, :]))

    return durable(dealt.groupBy("bucket", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}"), "links")


def _outside(known: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between texts just outside a hub's reach and those inside it, if any.

    ``known`` has the distances of texts from hubs. The texts around a hub are taken
    together over all bands, so a pair is compared once for each hub.
    """
    around = durable(
        known.where("d < 1").select("hub", "id", "d").distinct()
        .join(classes.withColumnRenamed("node", "id"), "id", "left")
        .select("hub", "id", "d", F.coalesce("component", "id").alias("class"))
        .withColumn("inner", F.col("d") <= 1 - NEAR + 1e-9),
        "around",
    )
    # Outside texts of another class than the hub's, which is that of all inside.
    own = classes.select(F.col("node").alias("hub"), F.col("component").alias("hub_class"))
    rim = durable(around.where("not inner").join(own, "hub").where("class <> hub_class").drop("hub_class"), "rim")
    inside = around.where("inner").join(rim.select("hub").distinct(), "hub")
    size = lambda x, name: x.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias(name))
    sizes = size(rim, "rims").join(size(inside, "insides"), "hub")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["hub", "i", "j", "id", "d", "class", "inner"]
    dealt = (
        rim.join(sizes, "hub").withColumn("i", deal("rims")).withColumn("j", every("insides")).select(*columns)
        .union(inside.join(sizes, "hub").withColumn("j", deal("insides")).withColumn("i", every("rims")).select(*columns))
        .join(texts, "id")
    )
    kind = around.schema["id"].dataType.simpleString()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        inner, d = part["inner"].to_numpy(), part["d"].to_numpy()
        reach = np.abs(d[:, None] - d[None, :]) <= 1 - NEAR + 1e-9
        return _block_links(part, reach & (inner[:, None] != inner[None, :]))

    return durable(dealt.groupBy("hub", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}"), "links")


def op6_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return near_duplicates(table(prepared(spark), sf_dir, "documents"))
