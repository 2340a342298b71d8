"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A string of ``LENGTH`` bytes is repeated if it starts at two places of all texts. Its
anchor is the leftmost of its grams of least hash; equal strings have equal anchors at
equal places, so it is enough to sort the suffixes that start at anchors, one in about
185 bytes. A record is such a suffix, as long as any string with this anchor reaches,
with the bytes before it back to the first string with this anchor.

* Each task sorts its suffixes into runs. Equal records of a run become one, marked as
  repeated. A run is cut at splitters (places are part of their order, so also equal
  suffixes are dealt evenly) and goes front-coded: of each suffix only what it does not
  share with the one before it.
* A target merges its runs with a loser tree that knows for each head how much it shares
  with the last suffix taken. Two heads are told apart by these numbers, or compared
  from there on: no prefix is compared twice, and the result comes with its common
  prefix lengths.
* A string that starts d bytes before its anchor is repeated if a record with the same d
  bytes on the left is in the interval of suffixes that share LENGTH - d bytes. Intervals
  follow from the common prefix lengths, left bytes are compared as 64-bit hashes.

Merged suffixes are looked at in batches, cut where neighbours share less than a gram.
A group that is too large for one batch is cut anyway, as are targets; strings whose
interval reaches such a cut, and that have no partner on their side, are counted by hash
(128 bits) in a ``groupBy``. So no task ever holds a group, however many rows share it.

The splitters are taken from a sample of rows, they only steer how even the targets are;
there are at most ``MAX_TARGETS``, which bounds what is sent to the tasks to 14 MB. Above
that many targets of ``TARGET_BYTES`` targets grow, and a task must hold its compressed
runs (about as many bytes as its share of the texts).

Rows: null and empty texts have no bytes. Equal rows are as many texts, and so repeat each
other if long enough. Texts are known by a digest, so rows need no ids, and they are
carried in a struct, so any column names may occur. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import bytes_of, durable, mixed, prepared, sha256_of, slices, table

LENGTH, GRAM = 400, 32
#: Places that the first gram of a string can have before its anchor.
REACH = LENGTH - GRAM
#: Bytes of text meant for one target, the most targets, sampled suffixes for each.
TARGET_BYTES, MAX_TARGETS, SAMPLED = 1 << 23, 1 << 15, 16
#: Records of a run, of a front-coded block of it, and of a batch of merged suffixes.
RUN_RECORDS, BLOCK_RECORDS, BATCH_RECORDS = 32_000, 1_000, 4_096
#: Bytes of a buffer that is searched for anchors; places in it take 24 bits.
BUFFER_BYTES = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)

_GRAM_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


# Anchors


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams of ``data``, put together from halves."""
    h, size, base = _GRAM_BYTE[data], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        size, base = size * 2, base * base % 2**64
    return mixed(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchored(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: (piece, first string, last string, anchor), as
    places in ``data``, whose pieces ``begin:end`` lie side by side."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < LENGTH:
        return none
    grams = (gram_hashes(data) & ~_PLACE) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    anchor = (_least(grams, REACH + 1) & _PLACE).astype(np.int64)
    piece = np.repeat(np.arange(len(begin)), end - begin)[: len(anchor)]
    string = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= end[piece])
    if not len(string):
        return none
    anchor, piece = anchor[string], piece[string]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1
    return piece[first], string[first], string[last], anchor[first]


def records_of(column: pa.Array) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(row, first string's place, suffix, bytes before it) of every anchor of the texts."""
    data, offsets = bytes_of(column)
    pieces = []
    for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        # A huge text is cut so that every string lies in exactly one piece.
        for at in range(low, max(low + 1, high - LENGTH + 1), BUFFER_BYTES):
            pieces.append((row, at, min(high, at + BUFFER_BYTES + LENGTH - 1)))
    i = 0
    while i < len(pieces):
        low, k = pieces[i][1], i + 1
        while k < len(pieces) and pieces[k][1] == pieces[k - 1][2] and pieces[k][2] - low <= BUFFER_BYTES:
            k += 1
        group, i = pieces[i:k], k
        part = data[low : group[-1][2]]
        ends = np.array([g[2] for g in group]) - low
        found = anchored(part, np.array([g[1] for g in group]) - low, ends)
        raw = part.tobytes()
        for piece, first, last, anchor in zip(*[f.tolist() for f in found]):
            row = group[piece][0]
            yield row, low + first - int(offsets[row]), raw[anchor : last + LENGTH], raw[first:anchor]


# Front-coded runs


def shared_prefixes(strings: list[bytes]) -> np.ndarray:
    """How many bytes each string shares with the one before it."""
    if not strings:
        return np.zeros(0, np.int64)
    size = np.array([len(s) for s in strings])
    wide = np.frombuffer(b"".join(s.ljust(LENGTH, b"\0") for s in strings), np.uint8).reshape(-1, LENGTH)
    differ = wide[1:] != wide[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), LENGTH)
    return np.concatenate([[0], np.minimum(shared, np.minimum(size[1:], size[:-1]))])


def encode(records: list[tuple], shared: np.ndarray) -> bytes:
    """A block of sorted records (suffix, text key, place, left, repeated)."""
    numbers = np.array([[len(r[0]) - s, s, len(r[3]), r[4]] for r, s in zip(records, shared)], np.uint16)
    raw = b"".join(
        [
            np.uint32(len(records)).tobytes(),
            numbers.T.tobytes(),
            np.array([r[2] for r in records], np.int64).tobytes(),
            *[r[1] for r in records],
            *[r[0][s:] for r, s in zip(records, shared.tolist())],
            *[r[3] for r in records],
        ]
    )
    return np.uint64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def decode(blocks: list[bytes]) -> Iterator[tuple]:
    """(suffix, text key, place, left, repeated, shared with the one before) of a run."""
    suffix = b""
    for block in blocks:
        raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)
        n = int.from_bytes(raw[:4], "little")
        rests, shareds, lefts, marks = np.frombuffer(raw, np.uint16, 4 * n, 4).reshape(4, n).tolist()
        places = np.frombuffer(raw, np.int64, n, 4 + 8 * n).tolist()
        keys, at = 4 + 16 * n, 4 + 32 * n
        left_at = at + sum(rests)
        for i in range(n):
            suffix = suffix[: shareds[i]] + raw[at : at + rests[i]]
            yield suffix, raw[keys + 16 * i : keys + 16 * i + 16], places[i], raw[left_at : left_at + lefts[i]], marks[i], shareds[i]
            at += rests[i]
            left_at += lefts[i]


class LoserTree:
    """Merges runs of (suffix, key, place, left, repeated, shared) into one.

    ``shared`` of a result is what it shares with the result before it. Every head that
    lost to the last result knows how much it shares with it, so of two heads the one
    that shares more is less, and equal ones are compared only from there on.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.shared = [0] * len(runs)
        self.losers = [0] * len(runs)
        winners = [0] * len(runs) + list(range(len(runs)))
        for node in range(len(runs) - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if len(runs) > 1 else 0

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(less, greater) of two runs' heads; the greater one's ``shared`` is then with the less."""
        x, y = self.heads[i], self.heads[j]
        if x is None or y is None:
            return (i, j) if y is None else (j, i)
        if self.shared[i] != self.shared[j]:
            return (i, j) if self.shared[i] > self.shared[j] else (j, i)
        a, b, at = x[0], y[0], self.shared[i]
        end = min(len(a), len(b))
        while at < end:
            p, q = a[at : at + 64], b[at : at + 64]
            if p != q:
                n = min(len(p), len(q))
                unlike = int.from_bytes(p[:n], "big") ^ int.from_bytes(q[:n], "big")
                at += n - (unlike.bit_length() + 7) // 8
                break
            at += len(p)
        less = a[at : at + 1] < b[at : at + 1] if a[at : at + 1] != b[at : at + 1] else x[1:3] <= y[1:3]
        first, second = (i, j) if less else (j, i)
        self.shared[second] = at
        return first, second

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            w = self.winner
            yield (*self.heads[w][:5], self.shared[w])
            self.heads[w] = following = next(self.runs[w], None)
            self.shared[w] = following[5] if following is not None else 0
            node = (w + len(self.runs)) // 2
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node //= 2
            self.winner = w


# Repeated strings among merged suffixes


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def _step(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    h = (h ^ (byte.astype(np.uint64) + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def repeated_strings(batch: list[tuple], before: int, after: int) -> tuple[set, list[tuple]]:
    """(spans, open strings) of merged records.

    ``before`` and ``after`` are what the first and the last record share with their
    neighbours outside of the batch. A span (key, begin, end) is covered by repeated
    strings; an open string (hash, hash, key, place, times) may have its partner there,
    and has no key where it is known to be repeated.
    """
    shared = np.array([before, *[r[5] for r in batch[1:]]], np.int64)
    around = np.maximum(shared, np.append(shared[1:], after))
    kept = np.flatnonzero(around >= GRAM)
    if not len(kept):
        return set(), []
    shared = shared[kept]
    shared[1:][np.diff(kept) > 1] = 0
    rows = [batch[i] for i in kept]
    before = before if kept[0] == 0 else 0
    after = after if kept[-1] == len(batch) - 1 else 0
    high = np.array([len(r[3]) for r in rows])
    low = LENGTH - np.array([len(r[0]) for r in rows])
    known = np.array([r[4] for r in rows], bool)
    left = _padded([r[3][::-1] for r in rows], REACH)
    # Records that any interval connects with one of the two cuts.
    first_cut = int(np.argmax(np.append(shared[1:] < GRAM, True))) + 1 if before >= GRAM else 0
    last_cut = len(rows) - int(np.argmax(np.append(shared[::-1] < GRAM, True))) - 1 if after >= GRAM else len(rows)
    last_cut = max(0, last_cut)
    at_cut = np.flatnonzero((np.arange(len(rows)) < first_cut) | (np.arange(len(rows)) >= last_cut))
    right_hash = np.zeros((len(at_cut), REACH + 1), np.uint64)
    if len(at_cut):
        right, h = _padded([rows[i][0] for i in at_cut], LENGTH), np.full(len(at_cut), 7, np.uint64)
        for size in range(1, LENGTH + 1):
            h = _step(h, right[:, size - 1])
            if size >= GRAM:
                right_hash[:, LENGTH - size] = h
    row_at_cut = np.full(len(rows), -1)
    row_at_cut[at_cut] = np.arange(len(at_cut))

    found = np.zeros((len(rows), REACH + 1), bool)
    opened: list[tuple] = []
    h = np.full(len(rows), 3, np.uint64)
    for d in range(REACH + 1):
        if d:
            h = _step(h, left[:, d - 1])
        here = np.flatnonzero((low <= d) & (d <= high))
        if not len(here):
            continue
        interval = np.cumsum(shared < LENGTH - d)
        value = mixed(h[here] + interval[here].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        twice = np.zeros(len(here), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        found[here, d] = twice
        if len(at_cut):
            opens = np.zeros(len(here), bool)
            if before >= LENGTH - d:
                opens |= interval[here] == interval[0]
            if after >= LENGTH - d:
                opens |= interval[here] == interval[-1]
            lead = np.ones(len(here), bool)
            lead[order[1:]] = ~same
            mark = mixed(h + np.uint64(d))
            for i in np.flatnonzero(opens & lead).tolist():
                row = rows[here[i]]
                sure = bool(twice[i] or known[here[i]])
                place = None if sure else row[2] + int(high[here[i]]) - d
                pair = mark[here[i]], right_hash[row_at_cut[here[i]], d]
                opened.append((*[int(p.astype(np.int64)) for p in pair], None if sure else row[1], place, 2 if sure else 1))
    found[known] = False  # their spans were found when they became one
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    spans = set()
    for i, start, stop in zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == 1)[1].tolist(), np.nonzero(edges == -1)[1].tolist()):
        anchor = rows[i][2] + len(rows[i][3])
        spans.add((rows[i][1], anchor - (stop - 1), anchor - start + LENGTH))
    return spans, opened


# The distributed sort


_RUNS = "target int, run bigint, seq int, block binary, key binary, begin bigint, end bigint"
_RUNS_ARROW = pa.schema([("target", pa.int32()), ("run", pa.int64()), ("seq", pa.int32()), ("block", pa.binary()),
                         ("key", pa.binary()), ("begin", pa.int64()), ("end", pa.int64())])
_FOUND = "key binary, begin bigint, end bigint, left_hash bigint, right_hash bigint, times int"
_FOUND_ARROW = pa.schema([("key", pa.binary()), ("begin", pa.int64()), ("end", pa.int64()),
                          ("left_hash", pa.int64()), ("right_hash", pa.int64()), ("times", pa.int32())])


def _rows(names: tuple, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = dict(zip(names, zip(*rows)))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in schema], schema=schema
    )


def splitters(texts: DataFrame, n_bytes: int) -> list[tuple]:
    """Ends of the targets' ranges: sampled (suffix, key, place)."""
    targets = min(MAX_TARGETS, math.ceil(n_bytes / TARGET_BYTES))
    if targets < 2:
        return []
    share = min(1.0, targets * SAMPLED * (REACH / 2) / n_bytes)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            rows = [(suffix, keys[row], place) for row, place, suffix, _ in records_of(batch.column(0))]
            if rows:
                yield _rows(("key", "begin", "block"), [(k, p, s) for s, k, p in rows], _RUNS_ARROW).select(["key", "begin", "block"])

    some = texts.sample(share, seed=11).mapInArrow(sampled, "key binary, begin bigint, block binary").collect()
    order = sorted((bytes(r["block"]), bytes(r["key"]), r["begin"]) for r in some)
    return [order[len(order) * i // targets] for i in range(1, targets)] if len(order) >= targets else order


def sorted_runs(texts: DataFrame, ends: list[tuple]) -> DataFrame:
    """Front-coded blocks of every task's sorted runs by target, and what is repeated inside a run."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: dict[tuple[bytes, bytes], list] = {}
        for batch in slices(batches, 0):
            keys = batch.column(1).to_pylist()
            for row, place, suffix, left in records_of(batch.column(0)):
                others = held.get((suffix, left))
                if others is None:
                    held[suffix, left] = [(keys[row], place)]
                else:
                    others.append((keys[row], place))
            if len(held) >= RUN_RECORDS:
                yield from run(held, number)
                held, number = {}, number + 1
        if held:
            yield from run(held, number)

    def run(held: dict, number: int) -> Iterator[pa.RecordBatch]:
        records = sorted((suffix, *at[0], left, int(len(at) > 1)) for (suffix, left), at in held.items())
        shared = shared_prefixes([r[0] for r in records])
        cuts = [0, *[bisect.bisect_left(records, end) for end in ends], len(records)]
        for target, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
            if low == high:
                continue
            shared[low] = 0
            blocks = range(low, high, BLOCK_RECORDS)
            rows = [
                (target, number, seq, encode(records[b : min(b + BLOCK_RECORDS, high)], shared[b : min(b + BLOCK_RECORDS, high)]))
                for seq, b in enumerate(blocks)
            ]
            yield _rows(("target", "run", "seq", "block"), rows, _RUNS_ARROW)
        # What is known already is dealt evenly, by text and place.
        spans = {
            (zlib.crc32(key, place & 0xFFFFFFFF) % (len(ends) + 1), key, place, place + len(left) + len(suffix))
            for (suffix, left), at in held.items() if len(at) > 1
            for key, place in at
        }
        if spans:
            yield _rows(("target", "key", "begin", "end"), list(spans), _RUNS_ARROW)

    return texts.mapInArrow(per_task, _RUNS)


def merge_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and open strings of one target, which is one partition."""
    runs: dict[int, list] = {}
    spans: set = set()
    for rows in batches:
        for run, seq, block, key, begin, end in zip(*[rows.column(c).to_pylist() for c in ("run", "seq", "block", "key", "begin", "end")]):
            if block is None:
                spans.add((key, begin, end))
            else:
                runs.setdefault(run, []).append((seq, block))
    opened: list[tuple] = []
    # What lies beyond a target's ends is not known: any interval may go on there.
    batch: list[tuple] = []
    before = LENGTH

    def look(after: int) -> None:
        more, open_strings = repeated_strings(batch, before, after)
        spans.update(more)
        opened.extend(open_strings)

    for record in LoserTree([decode([b for _, b in sorted(blocks)]) for _, blocks in sorted(runs.items())]):
        if len(batch) >= 2 * BATCH_RECORDS or (len(batch) >= BATCH_RECORDS and record[5] < GRAM):
            look(record[5])
            batch, before = [], record[5]
        batch.append(record)
    if batch:
        look(LENGTH)
    if spans:
        yield _rows(("key", "begin", "end"), list(spans), _FOUND_ARROW)
    if opened:
        yield _rows(("left_hash", "right_hash", "key", "begin", "times"), opened, _FOUND_ARROW)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(key, spans) of every text ``t`` of digest ``key`` with repeated strings."""
    n_bytes = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ends = splitters(texts, n_bytes)
    dealt = sorted_runs(texts, ends).repartitionById(len(ends) + 1, F.col("target"))
    found = durable(dealt.mapInArrow(merge_target, _FOUND), "repeated")
    opened = found.where("left_hash is not null")
    twice = opened.groupBy("left_hash", "right_hash").agg(F.sum("times").alias("n")).where("n > 1")
    closed = opened.where("key is not null").join(twice, ["left_hash", "right_hash"], "left_semi")
    spans = found.where("left_hash is null").select("key", "begin", "end")
    spans = spans.unionByName(closed.select("key", "begin", (F.col("begin") + LENGTH).alias("end"))).distinct()
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row (struct ``doc``) with ``n_bytes``, ``n_removed``, ``n_spans`` and the
    remaining bytes ``kept``."""
    key = F.unhex(F.md5(F.col(text).cast("binary")))
    texts = docs.where(F.octet_length(text) >= LENGTH).select(F.col(text).alias("t"), key.alias("key"))
    # Texts move once, inside of their rows.
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"))
    joined = carried.join(repeated_spans(texts), "key", "left").select(F.col("doc").getField(text).alias("t"), "spans", "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            data, offsets = bytes_of(batch.column(0))
            raw, kept, spans_left = data.tobytes(), [], []
            for i, spans in enumerate(batch.column(1).to_pylist()):
                whole, out, at, n = raw[offsets[i] : offsets[i + 1]], [], 0, 0
                for span in spans or []:
                    if span["begin"] > at or not n:
                        out.append(whole[at : span["begin"]])
                        n += 1
                    at = max(at, span["end"])
                out.append(whole[at:])
                kept.append(b"".join(out))
                spans_left.append(n)
            size = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(size), pa.array(size - [len(k) for k in kept]), pa.array(spans_left, pa.int64()), pa.array(kept, pa.binary())],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kind = joined.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes."""
    docs = table(prepared(spark), sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", sha256_of(F.col("kept")).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT r, unnest(range(0, (length(h) // 2 - 399)::BIGINT)) AS p, h FROM docs WHERE length(h) >= 800),
strings AS (SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS s FROM places),
twice AS (SELECT r, p FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
starts AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS step FROM twice),
runs AS (SELECT r, p, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM starts),
spans AS (SELECT r, k, min(p) AS b, max(p) + 400 AS e FROM runs GROUP BY ALL),
edged AS (SELECT r, b, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY b) AS since FROM spans),
kept AS (
  SELECT d.r, any_value(d.doc_id) AS doc_id, any_value(length(h)) // 2 AS n_bytes, coalesce(sum(e - b), 0) AS n_removed,
         count(b) AS n_spans, coalesce(string_agg(substr(h, 2 * since + 1, 2 * (b - since)), '' ORDER BY b), '')
           || substr(any_value(h), 2 * coalesce(max(e), 0) + 1) AS rest
  FROM docs d LEFT JOIN edged s ON s.r = d.r GROUP BY d.r
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
       sha256(unhex(rest)) AS kept_sha256
FROM kept
"""
