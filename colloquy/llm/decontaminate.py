"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the test items. Training words are
streamed through it: after each word it knows the longest run that ends there and
occurs in some item. Where that run is at least ``window`` words long, the last
``window`` words occur in an item; an item shorter than a window has to occur whole.

Only stretches whose neighbouring words also neighbour each other in some item are
streamed word by word. Outside of them no run is longer than one word, so skipping
them changes nothing; the test for a stretch is a hash filter, and what it lets
through is decided by the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import Words, code_points, durable, mixed, prepared, sha256_of, slices, table, words_of

#: Words of test items that one automaton may hold; more items get further automata.
INDEX_WORDS = 200_000
MATCH = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
_PAIR = np.uint64(0xD1B54A32D192ED03)


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mixed(h[:-1] * _PAIR + h[1:])


class SuffixAutomaton:
    """Generalised suffix automaton over lists of words, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 10):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str, int]] = []
        for name, words in items:
            state = 0
            for i, word in enumerate(words, 1):
                state = self._add(state, word)
                if i >= window:
                    ends.append((state, name, window))
            if words and len(words) < window:
                ends.append((state, name, len(words)))
        # Runs of the wanted length belong to the ancestor whose length range holds it.
        owned: dict[int, dict[int, set[str]]] = {}
        for state, name, size in ends:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            owned.setdefault(state, {}).setdefault(size, set()).add(name)
        self.owned = {s: sorted((k, frozenset(v)) for k, v in sizes.items()) for s, sizes in owned.items()}
        # Nearest state at or above each that owns a run.
        self.up = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.up[s] = s if s in self.owned else self.up[self.link[s]]
        self.shortest = min((min(window, len(w)) for _, w in items if w), default=0)
        self._filter(items)

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, word: bytes) -> int:
        """State of the run that ``last`` stands for, longer by ``word``."""
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def _filter(self, items: list[tuple[str, list[bytes]]]) -> None:
        """Hash sets of the words (or neighbouring words) that occur in items."""
        seen = []
        for _, words in items:
            if words:
                h = words_of(pa.array([b" ".join(words).decode()])).hashes
                seen.append(h if self.shortest < 2 else pair_hashes(h))
        keys = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        self.bits = np.uint64(max(16, int(16 * len(keys)).bit_length()))
        self.known = np.zeros(1 << int(self.bits), bool)
        self.known[(keys >> (np.uint64(64) - self.bits)).astype(np.int64)] = True

    def stretches(self, words: Words) -> np.ndarray:
        """First and last word of each stretch that can hold a window."""
        if not self.shortest or not len(words.hashes):
            return np.zeros((0, 2), np.int64)
        shift, pairs = np.uint64(64) - self.bits, self.shortest > 1
        h = pair_hashes(words.hashes) if pairs else words.hashes
        good = self.known[(h >> shift).astype(np.int64)]
        # A stretch ends where its text ends.
        last = words.first[1:-1]
        last = last[(last > 0) & (last < len(words.hashes))]
        cut = np.zeros(len(good) + 2, np.int8)
        if pairs:
            good[last - 1] = False
            cut[1:-1] = good
            edges = np.diff(cut)
            begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            keep = end - begin >= self.shortest - 1
            return np.stack([begin[keep], end[keep]], 1)
        cut[1:-1] = good
        edges = np.diff(cut)
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        out = []
        for a, b in zip(begin, end):
            inner = last[(last > a) & (last <= b)]
            out += zip([a, *inner], [*(inner - 1), b])
        return np.array(out, np.int64).reshape(-1, 2)

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(index of the last word, length, items) of every run that is to be hit."""
        state, length = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            at = self.up[state]
            while at:
                for size, names in self.owned[at]:
                    if size <= length:
                        yield i, size, names
                at = self.up[self.link[at]]


def match_batch(automaton: SuffixAutomaton, column: pa.Array) -> tuple[Words, np.ndarray, list[set[str]]]:
    """Words of a column of texts, which of them are hit, and the items of each text."""
    words = words_of(column)
    hit = np.zeros(len(words.hashes), bool)
    found: list[set[str]] = [set() for _ in range(len(column))]
    for a, b in automaton.stretches(words):
        text = int(np.searchsorted(words.first, a, side="right")) - 1
        for i, size, names in automaton.stream([words.text(k) for k in range(a, b + 1)]):
            hit[a + i - size + 1 : a + i + 1] = True
            found[text] |= names
    return words, hit, found


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def automata(
    benchmark: DataFrame, window: int = 10, item: str = "item_id", text: str = "text", most: int | None = None
) -> Iterator[SuffixAutomaton]:
    """Automata over all items, one after the other, each of at most ``most`` words.

    The driver holds the items of one automaton at a time. A longer item goes in pieces
    that share ``window - 1`` words, so each of its windows is in one of them. Rows with
    equal ids are parts of one item's evidence; a null id is named "".
    """
    most = max(most or INDEX_WORDS, 2 * window)
    part, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text)).toLocalIterator()
    for name, body in rows:
        words = words_of(pa.array([body], pa.string()))
        n = len(words.hashes)
        for begin in range(0, max(1, n - window + 1), most - window + 1):
            tokens = [words.text(i) for i in range(begin, min(n, begin + most))]
            if part and size + len(tokens) > most:
                yield SuffixAutomaton(part, window)
                part, size = [], 0
            part.append((name, tokens))
            size += len(tokens)
    yield SuffixAutomaton(part, window)


Matcher = Callable[[pa.RecordBatch], tuple[Words, np.ndarray, list[set[str]]]]


def matching(docs: DataFrame, benchmark: DataFrame, window: int, text: str) -> tuple[DataFrame, Matcher]:
    """Rows ``(text, runs, items, doc)`` of ``docs``, and what tells a batch's words, hits and items.

    One automaton is broadcast and the documents are streamed once. Of several, one at a
    time is: each pass keeps the hits of texts that have some, under a digest of the
    text, then the automaton is dropped everywhere; hits of all passes meet their rows
    in a join. So no more than two automata are ever held, however large the benchmark.
    """
    spark = docs.sparkSession
    made = automata(benchmark, window)
    first, second = next(made), next(made, None)
    body = F.col(f"`{text}`").cast("string")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    runs_kind, items_kind = "array<struct<begin:bigint,end:bigint>>", "array<string>"
    if second is None:
        shared = spark.sparkContext.broadcast(first)
        rows = docs.select(body.alias("text"), F.lit(None).cast(runs_kind).alias("runs"), F.lit(None).cast(items_kind).alias("items"), doc)
        return rows, lambda batch: match_batch(shared.value, batch.column(0))
    digest = F.unhex(F.md5(body.cast("binary"))).alias("key")
    texts = docs.where(body.isNotNull()).select(body.alias("text"), digest)
    passes = [_pass(texts, automaton) for automaton in chain([first, second], made)]
    # Copies of a text say the same: one of them is kept before anything is collected.
    each = [p.groupBy("key").agg(F.first("runs").alias("runs"), F.first("items").alias("items")) for p in passes]
    hits = reduce(DataFrame.unionByName, each).groupBy("key").agg(
        F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    rows = docs.select(body.alias("text"), digest, doc).join(hits, "key", "left").select("text", "runs", "items", "doc")

    def told(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, list[set[str]]]:
        words = words_of(batch.column(0))
        hit = np.zeros(len(words.hashes), bool)
        for at, runs in zip(words.first.tolist(), batch.column(1).to_pylist()):
            for run in runs or []:
                hit[at + run["begin"] : at + run["end"]] = True
        return words, hit, [set(x or []) for x in batch.column(2).to_pylist()]

    return rows, told


def _pass(texts: DataFrame, automaton: SuffixAutomaton) -> DataFrame:
    """Hit words, as runs, and items of those ``texts(text, key)`` that have some."""
    shared = texts.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            words, hit, items = match_batch(shared.value, batch.column(0))
            some = [t for t, names in enumerate(items) if names]
            runs = [[{"begin": int(a), "end": int(b)} for a, b in zip(*_runs(hit[words.first[t] : words.first[t + 1]]))] for t in some]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(some, pa.int64())),
                    pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(items[t]) for t in some], pa.list_(pa.string())),
                ],
                ["key", "runs", "items"],
            )

    found = durable(texts.mapInArrow(run, "key binary, runs array<struct<begin:bigint,end:bigint>>, items array<string>"), "hits")
    shared.destroy()
    return found


def match(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, hit words, items and hit spans of every document.

    Returns one row per row of ``docs``: ``key``, ``n_words``, ``n_hit``, ``items``
    (sorted as strings), ``spans`` (code points, end exclusive). A null or empty
    text has no words; an item without words occurs nowhere; other columns are not
    looked at. See ``matching`` for benchmarks of any size.
    """
    prepared(docs.sparkSession)
    rows, matched = matching(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), benchmark, window, "text")
    found = rows.select("text", "runs", "items", "doc.key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            words, hit, items = matched(batch)
            spans = _spans(words, hit)
            counts = np.diff(words.first)
            sums = np.concatenate([[0], np.cumsum(hit)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(3),
                    pa.array(counts, pa.int64()),
                    pa.array(sums[words.first[1:]] - sums[words.first[:-1]], pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["key", "n_words", "n_hit", "items", "spans"],
            )

    kind = found.schema["key"].dataType.simpleString()
    return found.mapInArrow(run, f"key {kind}, {MATCH}").withColumnRenamed("key", key)


def _spans(words: Words, hit: np.ndarray) -> list[list[dict]]:
    """Code-point spans of the runs of hit words of each text."""
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    if not hit.any():
        return out
    for t in np.unique(np.searchsorted(words.first, np.flatnonzero(hit), side="right") - 1):
        low, high = words.first[t], words.first[t + 1]
        start = words.offsets[t]
        points = code_points(words.data[start : words.offsets[t + 1]])
        for a, b in zip(*_runs(hit[low:high])):
            first, last = low + a, low + b - 1
            out[t].append(
                {
                    "start": int(points[words.begin[first] - start]),
                    "end": int(points[words.begin[last] + words.size[last] - start]),
                }
            )
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    max_coverage: float = 0.5,
    text: str = "text",
) -> DataFrame:
    """Documents without benchmark passages.

    Spans of hit words are cut out of the text together with nothing else; a document
    of whose words more than ``max_coverage`` are hit goes as a whole. All columns are
    kept as they are, whatever their names; clean documents, null and empty texts stay
    unchanged. Rows are independent, so repeated rows are treated alike.
    """
    prepared(docs.sparkSession)
    rows, matched = matching(docs, benchmark, window, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            column = batch.column(0)
            words, hit, _ = matched(batch)
            if not hit.any():
                yield pa.RecordBatch.from_arrays([column, batch.column(3)], ["text", "doc"])
                continue
            sums = np.concatenate([[0], np.cumsum(hit)])
            counts = sums[words.first[1:]] - sums[words.first[:-1]]
            kept = counts <= max_coverage * np.diff(words.first)
            texts = column.to_pylist()
            for t in np.flatnonzero((counts > 0) & kept):
                low, high = words.first[t], words.first[t + 1]
                raw = words.data[words.offsets[t] : words.offsets[t + 1]]
                stay = np.ones(len(raw), bool)
                for a, b in zip(*_runs(hit[low:high])):
                    last = low + b - 1
                    begin = words.begin[low + a] - words.offsets[t]
                    stay[begin : words.begin[last] + words.size[last] - words.offsets[t]] = False
                texts[t] = raw[stay].tobytes().decode()
            cut = pa.RecordBatch.from_arrays([pa.array(texts, column.type), batch.column(3)], ["text", "doc"])
            yield cut.filter(pa.array(kept))

    clean = rows.mapInArrow(run, f"text string, doc {rows.schema['doc'].dataType.simpleString()}")
    # The text of a row is what was cut; all else is in the row as it came.
    return clean.select(*[F.col("text").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document how many words the benchmark covers, and by which items."""
    found = match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha256_of(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH RECURSIVE
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM item_words WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
),
sizes AS (SELECT DISTINCT size FROM sized),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words CROSS JOIN sizes)
),
found AS (SELECT DISTINCT doc_id, i, p.size AS size, item_id FROM places p JOIN windows w ON w.run = p.run AND w.size = p.size),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(size)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
