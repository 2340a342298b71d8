"""Packing of token sequences by linear grouping.

Lengths are the only thing the plan needs, and there are at most ``size`` of them, so
the plan is made from a table of counts by length, whatever the number of documents:

1. lengths above ``size / SMALL`` are cut into groups of equal cardinality, and each is
   rounded up to the largest of its group;
2. configurations over these few sizes are chosen: the fullest one that holds the
   largest size left (a bounded knapsack), as often as the counts allow, again and again;
3. the slots of each group are handed to its actual lengths, so sequences get back what
   the rounding took;
4. small lengths, largest first, go where they fit best.

Every step works on runs of equal sequences, never on single documents. Documents then
find their places by their rank within their length, which is counted in parts.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from colloquy.llm.common import durable, prepared, slices, table

#: Numbers of groups of large lengths that are tried, and the share of a sequence up to
#: which a length is small.
GROUPS = (64, 128, 256, 1024)
SMALL = 8
#: Rows of one length are ranked in parts: so many at least, and the rows of a part.
RANK_PARTS, PART_ROWS = 64, 200_000
#: Rows of a plan up to which it is broadcast; it depends on the counts by length alone.
PLAN_ROWS = 1 << 19
END_TOKEN = 2
# Text for which both tokenizer libraries are known to cut words alike.
_PLAIN = re.compile(r"[^\n\r\t -~¡-ɏ‐-‧€]")


def rank_encoder(path: str):
    """``text -> ids`` for a byte-level vocabulary file of the tokenizers library.

    The vocabulary's ids are its merge order, so tiktoken gives the same ids from it,
    several times faster. Texts with other characters than plain ones, or with a
    special token's text, are encoded by tokenizers itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _PLAIN.search(text) or any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of every document: ``key, piece, start, length, ids_crc32``.

    A null text is empty and has the end token only. A document longer than ``size``
    is cut so that its first piece takes what is left over; no other is cut.
    """
    prepared(docs.sparkSession)
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(vocabulary)
        for batch in slices(batches, 1):
            keys, rows = [], []
            for k, body in enumerate(batch.column(1)):
                ids = encode(body.as_py() or "")
                ids.append(END_TOKEN)
                raw, n = np.array(ids, "<u4"), len(ids)
                at = 0
                for piece in range(-(-n // size)):
                    length = (n - 1) % size + 1 if piece == 0 else size
                    rows.append((piece, at, length, zlib.crc32(raw[at : at + length].tobytes())))
                    at += length
                keys += [k] * -(-n // size)
            columns = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keys, pa.int64())),
                    pa.array(columns[:, 0], pa.int32()),
                    *(pa.array(columns[:, i], pa.int64()) for i in (1, 2, 3)),
                ],
                names=["key", "piece", "start", "length", "ids_crc32"],
            )

    kind = found.schema["key"].dataType.simpleString()
    out = found.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return out.withColumnRenamed("key", key)


def _groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths, largest first, in groups of about equal numbers of pieces."""
    total, out, held = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        if not out or held >= len(out) * total / groups:
            out.append([])
        out[-1].append(length)
        held += counts[length]
    return out


def _fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How often each size goes into ``room``, within ``left``, so that it is fullest."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    used = np.zeros((len(sizes), room + 1), np.int16)
    for i, (s, n) in enumerate(zip(sizes, left)):
        new = reach.copy()
        for copies in range(1, min(n, room // s) + 1):
            add = np.zeros_like(reach)
            add[copies * s :] = reach[: room + 1 - copies * s]
            add &= ~new
            used[i, add] = copies
            new |= add
        reach = new
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    picked = [0] * len(sizes)
    for j in range(i, -1, -1):
        picked[j] = int(used[j, at])
        at -= picked[j] * sizes[j]
    return picked


def configurations(sizes: list[int], counts: list[int], room: int) -> list[tuple[list[int], int]]:
    """(how often each size, how many sequences) so that all counts are used up."""
    left, out = list(counts), []
    while any(left):
        first = next(i for i, n in enumerate(left) if n)
        left[first] -= 1
        picked = _fullest(sizes[first:], left[first:], room - sizes[first])
        left[first] += 1
        used = [0] * first + picked
        used[first] += 1
        times = min(n // u for n, u in zip(left, used) if u)
        left = [n - times * u for n, u in zip(left, used)]
        out.append((used, times))
    return out


def _hand_out(slots: list[int], times: int, queues: dict[int, list[list[int]]]) -> Iterator[tuple[list[int], int]]:
    """Sequences with actual lengths in their slots, as runs of equal ones."""
    while times:
        taken, fronts = [], defaultdict(int)
        for g in slots:
            # The k-th slot of a group in one sequence takes from the k-th of as many shares.
            taken.append((g, fronts[g]))
            fronts[g] += 1
        lengths, run = [], times
        for g, share in taken:
            n = fronts[g]
            queue = queues[g]
            length, count = queue[-1]
            lengths.append(length)
            run = min(run, max(1, count // n))
        if run == 1:
            lengths = []
            for g, _ in taken:
                queue = queues[g]
                lengths.append(queue[-1][0])
                queue[-1][1] -= 1
                if not queue[-1][1]:
                    queue.pop()
        else:
            for (g, _), length in zip(taken, lengths):
                queues[g][-1][1] -= run
            for g in fronts:
                if not queues[g][-1][1]:
                    queues[g].pop()
        yield lengths, run
        times -= run


def plan(counts: dict[int, int], size: int = 1024, groups: tuple[int, ...] = GROUPS) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences), using every count up.

    ``counts`` has how many pieces there are of each length from 1 to ``size``. No number
    of groups is best for all distributions: each of ``groups`` is tried, then all lengths
    by best fit alone (0 groups), and the plan of the fewest sequences is taken.
    """
    made = (grouped_plan(counts, size, n) for n in (*groups, 0))
    return min(made, key=lambda p: sum(n for _, n in p))


def grouped_plan(counts: dict[int, int], size: int, groups: int) -> list[tuple[list[int], int]]:
    """The plan of one number of groups; without groups every length counts as small."""
    bins: dict[tuple[int, ...], int] = defaultdict(int)
    large = {l: n for l, n in counts.items() if n and size // SMALL < l < size} if groups else {}
    if counts.get(size):
        bins[(size,)] = counts[size]
    grouped = _groups(large, groups)
    sizes = [g[0] for g in grouped]
    queues = {i: [[l, large[l]] for l in sorted(g)] for i, g in enumerate(grouped)}
    for used, times in configurations(sizes, [sum(large[l] for l in g) for g in grouped], size):
        slots = [i for i, u in enumerate(used) for _ in range(u)]
        for lengths, run in _hand_out(slots, times, queues):
            bins[tuple(lengths)] += run
    rooms: dict[int, list[list]] = defaultdict(list)
    for lengths, n in bins.items():
        rooms[size - sum(lengths)].append([lengths, n])
    for length in sorted((l for l in counts if l < size and l not in large), reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in range(length, size + 1) if rooms.get(r)), None)
            if room is None:
                fit = size // length
                rooms[size].append([(), -(-left // fit)])
                continue
            lengths, n = rooms[room].pop()
            # A run of equal sequences gets as many as fit into each; with groups, evenly.
            even = groups and room < size
            each = min(room // length, max(1, left // n) if even else left)
            some = min(n, left // each)
            rooms[room - each * length].append([lengths + (length,) * each, some])
            if n > some:
                rooms[room].append([lengths, n - some])
            left -= each * some
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for held in rooms.values():
        for lengths, n in held:
            if lengths and n:
                out[lengths] += n
    return [(list(lengths), n) for lengths, n in out.items()]


def places(made: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank, per sequence, first sequence, offset) of a plan."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for lengths, n in made:
        at, same = 0, defaultdict(int)
        for length in lengths:
            same[length] += 1
        for length in dict.fromkeys(lengths):
            k = same[length]
            rows.append((length, ranks[length], ranks[length] + k * n - 1, k, sequence, at))
            ranks[length] += k * n
            at += k * length
        sequence += n
    return rows


PLAN = "length bigint, low bigint, high bigint, per bigint, base bigint, at bigint"


def pack(found: DataFrame, size: int = 1024, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``found`` (rows with a ``length``) with ``sequence_id`` and ``offset``.

    All rows keep; lengths lie between 1 and ``size``. Sequences are gapless from 0 and
    never longer than ``size``. The driver sees counts by length only. Rows of a length are
    ranked in parts of bounded size, whose sums a window over the parts carries on. Whole
    rows are carried in one struct, so other columns may have any names, but those of the
    result, which are replaced.
    """
    spark = found.sparkSession
    kept = [c for c in found.columns if c not in ("sequence_id", "offset")]
    parts = max(RANK_PARTS, found.count() // PART_ROWS)
    salted = found.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("length").cast("bigint").alias("length"),
        F.struct(*[F.col(f"`{c}`") for c in order]).alias("key"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(parts)).alias("part"),
    )
    tally = durable(salted.groupBy("length", "part").count(), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = places(plan(counts, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skipped"))
    where = spark.createDataFrame(rows, PLAN)
    within = Window.partitionBy("length", "part").orderBy("key")
    ranked = (
        salted.withColumn("rank", F.row_number().over(within).cast("bigint") - 1)
        .join(starts, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("skipped"))
    )
    slot = F.col("rank") - F.col("low")
    return (
        ranked.join(F.broadcast(where) if len(rows) <= PLAN_ROWS else where, "length")
        .where("rank between low and high")
        .withColumn("sequence", F.col("base") + F.floor(slot / F.col("per")).cast("bigint"))
        .withColumn("place", F.col("at") + slot % F.col("per") * F.col("length"))
        .select("row.*", F.col("sequence").alias("sequence_id"), F.col("place").alias("offset"))
    )


def op10_pack(spark, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    import public_tokenizers

    docs = table(prepared(spark), sf_dir, "documents")
    return pack(durable(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))
