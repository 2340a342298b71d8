"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.session import configure, durable, new_path  # noqa: F401

#: Rows of one Arrow batch. Texts differ in length by 10^5, so batches stay small.
BATCH_ROWS = 256

# A word: digits, letters and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MIX = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS = _powers(1024)


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings these operators count on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all of its bits depend on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The lower-cased words of a column of texts, as 64-bit hashes.

    ``first[i]:first[i + 1]`` are the words of text i; ``begin`` and ``size`` are
    byte places in ``data``. A null text has no words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        lowered = _LOWER[data]
        word = _WORD[data]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        inner = offsets[:-1]
        before[inner[inner < len(data)]] = False
        self.begin = np.flatnonzero(word & ~before)
        self.first = np.searchsorted(self.begin, offsets)
        kept = lowered[word]
        place = np.cumsum(word)
        starts = place[self.begin] - 1 if len(self.begin) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(starts, len(kept)))
        self.kept, self.starts = kept, starts
        self._within = None
        self.hashes = mixed(self._sums(self._terms())) if len(starts) else np.zeros(0, np.uint64)

    def _places(self) -> np.ndarray:
        if self._within is None:
            self._within = np.arange(len(self.kept)) - np.repeat(self.starts, self.size)
        return self._within

    def _terms(self) -> np.ndarray:
        longest = int(self.size.max())
        powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
        self.terms = _MIX[self.kept] * powers[self._places()]
        return self.terms

    def _sums(self, terms: np.ndarray) -> np.ndarray:
        return np.add.reduceat(terms, self.starts)

    def heads(self, length: int) -> np.ndarray:
        """Hashes of the first ``length`` bytes of each word; 0 for shorter words."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        out = mixed(self._sums(np.where(self._places() < length, self.terms, np.uint64(0))) + np.uint64(length))
        return np.where(self.size > length, out, np.uint64(0))

    def text(self, i: int) -> bytes:
        """Word i in lower case."""
        return self.kept[self.starts[i] : self.starts[i] + self.size[i]].tobytes()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    return raw, offsets - low


def words_of(column: pa.Array) -> Words:
    return Words(*bytes_of(column))


def hash_of(word: bytes) -> int:
    """The hash that ``Words`` gives one word."""
    return int(words_of(pa.array([word.decode()])).hashes[0])


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one take about ``limit`` bytes, one text at least."""
    for batch in batches:
        _, offsets = bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte place (and the end) how many characters start before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_of(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)
