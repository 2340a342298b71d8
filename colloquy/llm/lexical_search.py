"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds, for blocks of documents of like size, one bitmap a signature row: bit d
of a row says that some term of document d is hashed to that row. A term sets its rows
for every level it reaches: it occurs, at least twice, at least four times, and so on.
The bitmaps of a term's rows, combined by AND, overestimate where it occurs, and how
often; so the weighted sums of these slices are upper bounds of the scores of a whole
block at a time. Signatures are as long as the largest document of their block asks for.

A search first rescores, for each item, the few documents of the highest bounds. The
score of the k-th best of them is a score that the k-th best of all reaches at least.
Then every document whose bound is not below it is rescored exactly from its text; what
is left out is proven to be worse. No candidate is dropped otherwise, ties included.

Documents are known by a digest of their text, so equal texts are bounded row by row but
need no row numbers; a row of the result stands for one row of the documents. Items are
taken in groups of bounded size, all others of their words never meet.

Rows: a null text and one without terms hold nothing and are never found; they count for
nothing. Repeated documents and repeated items are each a row of their own. Ties go to
the lower order column, nulls last. An empty table on either side gives no rows. Rows
are carried in structs, so any column names may occur.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from colloquy.llm.common import bytes_of, durable, mixed, new_path, prepared, table

TOP = 10
#: Documents of a block, rows set for a term and level, signature rows for each of them.
BLOCK_DOCS, HASHES, ROWS_PER_ENTRY = 512, 4, 10
#: Levels of a term's frequency: 1, 2, 4, ... times.
LEVELS = 32
#: Documents of the highest bounds that set an item's threshold.
FIRST = 16
#: Distinct terms that a task counts before it hands them on.
COUNTED_TERMS = 400_000
#: Bytes of the items of one group, and the most items of it, on average.
GROUP_BYTES, GROUP_ITEMS = 1 << 21, 2_000

# Terms are runs of digits, letters and bytes beyond ASCII; A-Z are lowered.
_TO_TERM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_INDEX = "rows int, n_docs bigint, n_terms bigint, lengths binary, keys binary, bits binary, term binary, df bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_TERM).split()


def term_hash(term: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(term, digest_size=8).digest(), "little")


def rows_of(hashes: np.ndarray, level: np.ndarray, rows: int) -> np.ndarray:
    """The ``HASHES`` signature rows of each (term, level)."""
    base = mixed(hashes + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    steps = np.arange(1, HASHES + 1, dtype=np.uint64)
    return (mixed(base[:, None] + steps) & np.uint64(rows - 1)).astype(np.int64)


class _Block:
    """Documents of one size class on their way into a block."""

    def __init__(self, rows: int):
        self.rows, self.hashes, self.levels, self.places = rows, [], [], []
        self.lengths, self.keys = [], []

    def add(self, key: bytes, length: int, hashes: np.ndarray, levels: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.levels.append(levels)
        self.places.append(np.full(len(hashes), len(self.lengths)))
        self.lengths.append(length)
        self.keys.append(key)

    def row(self) -> dict:
        bits = np.zeros((self.rows, BLOCK_DOCS), bool)
        rows = rows_of(np.concatenate(self.hashes), np.concatenate(self.levels), self.rows)
        bits[rows, np.concatenate(self.places)[:, None]] = True
        lengths = np.array(self.lengths, np.int64)
        return {
            "rows": self.rows, "n_docs": len(lengths), "n_terms": int(lengths.sum()), "lengths": lengths.tobytes(),
            "keys": b"".join(self.keys), "bits": np.packbits(bits, axis=1).tobytes(),
        }


def _entries(counts: Counter, hash_of) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, level) of all levels that the terms of a document reach."""
    hashes = np.fromiter((hash_of(t) for t in counts), np.uint64, len(counts))
    reached = np.frexp(np.fromiter(counts.values(), np.float64, len(counts)))[1]
    level = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
    return np.repeat(hashes, reached), level


def build_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of signatures, and how many documents hold each term, by task."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, _Block] = {}
        df: Counter = Counter()
        known: dict[bytes, int] = {}
        kept: list[dict] = []
        kind = pa.schema([("rows", pa.int32()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("lengths", pa.binary()),
                          ("keys", pa.binary()), ("bits", pa.binary()), ("term", pa.binary()), ("df", pa.int64())])

        def counted() -> Iterator[pa.RecordBatch]:
            terms = list(df.items())
            for i in range(0, len(terms), 20_000):
                part = [{"term": t, "df": n} for t, n in terms[i : i + 20_000]]
                yield pa.RecordBatch.from_pylist(part, schema=kind)
            df.clear()
            known.clear()

        def hash_of(term: bytes) -> int:
            found = known.get(term)
            if found is None:
                found = known[term] = term_hash(term)
            return found

        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            keys = batch.column(1).to_pylist()
            raw = data.tobytes()
            for i, key in enumerate(keys):
                terms = terms_of(raw[offsets[i] : offsets[i + 1]])
                if not terms:
                    continue
                counts = Counter(terms)
                df.update(counts.keys())
                hashes, levels = _entries(counts, hash_of)
                rows = 1 << max(6, (ROWS_PER_ENTRY * len(hashes) - 1).bit_length())
                block = open_blocks.setdefault(rows, _Block(rows))
                block.add(key, len(terms), hashes, levels)
                if len(block.lengths) == BLOCK_DOCS:
                    kept.append(open_blocks.pop(rows).row())
                    yield pa.RecordBatch.from_pylist(kept, schema=kind)
                    kept.clear()
                if len(df) >= COUNTED_TERMS:
                    yield from counted()
        for block in open_blocks.values():
            yield pa.RecordBatch.from_pylist([block.row()], schema=kind)
        yield from counted()

    held = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), _key(text).alias("k"))
    return held.mapInArrow(per_task, _INDEX)


def _key(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


class Queries:
    """One group of items: their terms, each with its weight, and the corpus's numbers."""

    def __init__(self, texts: list[str | None], df: dict[bytes, int], n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        held = sorted(df)
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in held}
        place = {t: i for i, t in enumerate(held)}
        self.hashes = np.array([term_hash(t) for t in held], np.uint64)
        self.items: list[list[tuple[bytes, int]]] = []
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            counts = Counter(terms_of(text.encode())) if text is not None else Counter()
            weighted = [(t, c * weight[t]) for t, c in counts.items() if weight.get(t)]
            self.items.append(weighted)
            self.sums.append((np.array([place[t] for t, _ in weighted], int), np.array([w for _, w in weighted], np.int64)))

    def norm(self, length):
        """m of documents of ``length`` terms."""
        return 100 - 75 + (75 * length * self.n_docs) // self.n_terms

    def score(self, item: int, counts: Counter, m: int) -> int:
        total = 0
        for term, weight in self.items[item]:
            tf = counts.get(term)
            if tf:
                total += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        return total

    def bounds(self, rows: int, lengths: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of a block's documents, one row for each item."""
        level = np.zeros((len(self.hashes), len(lengths)), np.int8)
        left = np.arange(len(self.hashes))
        for k in range(LEVELS):
            slices = np.bitwise_and.reduce(bits[rows_of(self.hashes[left], np.full(len(left), k), rows)], axis=1)
            some = slices.any(1)
            left = left[some]
            if not len(left):
                break
            here = np.unpackbits(slices[some], axis=1)[:, : len(lengths)]
            # A level counts only on top of all levels below it.
            level[left] += (here & (level[left] == k)).astype(np.int8)
        # A term that is seen on levels up to k occurs less than 2^k times.
        most = (1 << np.arange(LEVELS + 1, dtype=np.int64)) - 1
        m = self.norm(lengths)
        part = (1_000_000_000 * most[:, None]) // (1000 * most[:, None] + 8 * m)
        each = part[level, np.arange(len(lengths))]
        out = np.zeros((len(self.sums), len(lengths)), np.int64)
        for i, (terms, weights) in enumerate(self.sums):
            if len(terms):
                out[i] = weights @ each[terms]
        return out


def _blocks(index: DataFrame) -> DataFrame:
    return index.where("bits is not null").select("rows", "lengths", "keys", "bits")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[bytes], np.ndarray]]:
    for batch in batches:
        for row in range(batch.num_rows):
            rows, lengths, keys, bits = (batch.column(c)[row].as_py() for c in range(4))
            names = [keys[i : i + 16] for i in range(0, len(keys), 16)]
            yield rows, np.frombuffer(lengths, np.int64), names, np.frombuffer(bits, np.uint8).reshape(rows, -1)


_FOUND = "item int, key binary, bound bigint"
_FOUND_ARROW = ["item", "key", "bound"]


def _candidates(items: list[int], keys: list[bytes], bounds: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(keys, pa.binary()), pa.array(bounds, pa.int64())], _FOUND_ARROW)


def best_bounds(index: DataFrame, queries: Queries, first: int = FIRST) -> DataFrame:
    """The ``first`` documents of the highest bounds of every item, at most ``first``
    rows an item from each task."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for rows, lengths, keys, bits in _read(batches):
            for item, bound in enumerate(queries.bounds(rows, lengths, bits)):
                near = np.argpartition(-bound, min(first, len(bound)) - 1)[:first]
                new = [(int(bound[d]), keys[d]) for d in near if bound[d] > 0]
                if new:
                    held[item] = sorted(set(held.get(item, []) + new), reverse=True)[:first]
        for item, rows_found in held.items():
            yield _candidates([item] * len(rows_found), [k for _, k in rows_found], [b for b, _ in rows_found])

    found = _blocks(index).mapInArrow(per_task, _FOUND)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= first).select("item", "key").distinct()


def not_excluded(index: DataFrame, queries: Queries, least: dict[int, int]) -> DataFrame:
    """Every (item, key) whose bound is above 0 and not below the item's threshold."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lengths, keys, bits in _read(batches):
            bounds = queries.bounds(rows, lengths, bits)
            asked = np.array([max(1, least.get(i, 0)) for i in range(len(bounds))], np.int64)
            items, docs = np.nonzero(bounds >= asked[:, None])
            if len(items):
                yield _candidates(items.tolist(), [keys[d] for d in docs], bounds[items, docs].tolist())

    return _blocks(index).mapInArrow(per_task, _FOUND).select("item", "key").distinct()


def rescore(docs: DataFrame, found: DataFrame, queries: Queries, text: str, order: str, top: int, bounded: bool) -> DataFrame:
    """The ``top`` best of the documents ``found``, by their exact scores.

    ``bounded`` says that ``found`` has a few rows an item only, so that it may be sent
    to all tasks; else Spark picks the join by size.
    """
    wanted = found.groupBy("key").agg(F.collect_list("item").alias("items"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    held = docs.where(F.col(text).isNotNull()).select(
        _key(text).alias("key"), F.col(text).alias("t"), F.col(f"`{order}`").alias("o"), rest.alias("doc")
    )
    joined = held.join(F.broadcast(wanted) if bounded else wanted, "key").select("t", "items", "o", "doc")

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            raw, places, items, scores = data.tobytes(), [], [], []
            for i, asked in enumerate(batch.column(1).to_pylist()):
                terms = terms_of(raw[offsets[i] : offsets[i + 1]])
                counts, m = Counter(terms), queries.norm(len(terms))
                for item in asked:
                    score = queries.score(item, counts, m)
                    if score > 0:
                        places.append(i)
                        items.append(item)
                        scores.append(score)
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), pa.array(scores, pa.int64()), batch.column(2).take(at), batch.column(3).take(at)],
                ["item", "score", "o", "doc"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    scored = joined.mapInArrow(per_task, f"item int, score bigint, o {kinds['o']}, doc {kinds['doc']}")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("o"))
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)


def _groups(items: DataFrame, text: str) -> Iterator[list]:
    """The items in groups of bounded size, one at a time in the driver."""
    size = items.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    n = max(1, math.ceil((size[0] or 0) / GROUP_BYTES), math.ceil(size[1] / GROUP_ITEMS))
    carried = items.select(F.col(text).alias("t"), F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("item"))
    dealt = carried.withColumn("g", F.pmod(F.xxhash64("t", "item"), F.lit(n)))
    for g in range(n):
        rows = dealt.where(F.col("g") == g).select("t", "item").collect()
        if rows:
            yield rows


def search(docs: DataFrame, items: DataFrame, order: str, text: str = "text", top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """The ``top`` documents of every item: structs ``item`` and ``doc`` (without the
    text), ``rank`` and ``score``. ``index`` is what ``build_index`` gave, if it is kept."""
    spark = docs.sparkSession
    index = durable(build_index(docs, text), "signatures") if index is None else index
    numbers = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = numbers[0] or 0, numbers[1] or 0
    item_kind = items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("item")).schema["item"].dataType
    path, results = new_path(spark, "ranked"), 0
    for rows in _groups(items, text):
        asked = sorted({t for r in rows if r["t"] is not None for t in terms_of(r["t"].encode())})
        if not asked or not n_docs:
            continue
        words = spark.createDataFrame([(bytearray(t),) for t in asked], "term binary")
        held = index.where("term is not null").join(F.broadcast(words), "term").groupBy("term").agg(F.sum("df").alias("df"))
        df = {bytes(r["term"]): r["df"] for r in held.collect()}
        queries = Queries([r["t"] for r in rows], df, n_docs, n_terms)
        first = durable(best_bounds(index, queries), "first")
        best = rescore(docs, first, queries, text, order, top, True)
        least = {r["item"]: r["score"] for r in best.where(F.col("rank") == top).select("item", "score").collect()}
        found = durable(not_excluded(index, queries, least), "candidates")
        ranked = rescore(docs, found, queries, text, order, top, False)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"item int, named {item_kind.simpleString()}")
        ranked.join(F.broadcast(names), "item").select(
            F.col("named").alias("item"), F.col("rank").cast("int").alias("rank"), "doc", "score"
        ).write.mode("append").parquet(path)
        results += 1
    if not results:
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
        kind = docs.select(rest.alias("doc")).schema["doc"].dataType.simpleString()
        return spark.createDataFrame([], f"item {item_kind.simpleString()}, rank int, doc {kind}, score bigint")
    return spark.read.parquet(path)


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    spark = prepared(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return search(docs, items, "doc_id").select("item.item_id", "rank", "doc.doc_id", "score")


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
docs AS (SELECT doc_id, r, len(terms) AS n, terms FROM lowered WHERE len(terms) > 0),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM docs),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term, nd
),
asked AS (
  SELECT item_id, q, term, count(*) AS times
  FROM (
    SELECT item_id, row_number() OVER () AS q,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY ALL
),
scored AS (
  SELECT item_id, q, doc_id, r,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (r), total
  GROUP BY ALL
)
SELECT item_id, rank, doc_id, score
FROM (
  SELECT item_id, doc_id, score,
         (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank
  FROM scored WHERE score > 0
) WHERE rank <= 10
"""
