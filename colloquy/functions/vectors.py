"""Dense-vector expressions over ARRAY<FLOAT> or ARRAY<DOUBLE>, computed in DOUBLE."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from colloquy.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 when either vector has no length."""
    return let(
        norm(a) * norm(b), lambda size: F.when(size > 0, dot(a, b) / size).otherwise(0.0)
    )


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays as it is."""

    def scaled(v: Column) -> Column:
        return let(
            norm(v),
            lambda length: F.transform(
                v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0)
            ),
        )

    return let(a, scaled)


def hashed_terms(tokens: Column, dim: int) -> Column:
    """Signed hashed term counts scaled to unit length: the model-free embedding.

    Four hex digits of a token's MD5 choose the slot and the fifth the sign, so
    any engine with MD5 gives the same vector.
    """

    # Five hex digits as one number: its last digit is the sign, the rest the slot.
    digits = F.transform(
        tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 5), 16, 10).cast("int")
    )
    slots = F.transform(
        digits, lambda n: F.floor(n / 16).cast("int") % dim + F.when(n % 16 >= 8, dim).otherwise(0)
    )

    def counts(found: Column) -> Column:
        def kept(d: Column) -> Column:
            return F.size(F.array_remove(found, d))

        # What removing a slot takes away is its count; no lambda per token.
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (kept(d + dim) - kept(d)).cast("double")
        )

    return unit(let(slots, counts))


def hashed_vectors(tokens: Column, dim: int, weights: np.ndarray | None = None) -> Column:
    """``hashed_terms`` for whole batches in Arrow; null for a list without tokens.

    ``weights`` has a weight for each value of the four digits, one each without it. A
    task keeps the places of the tokens it has seen, up to a million of them.
    """

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places: dict[str, tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            digits = int(hashlib.md5(token.encode()).hexdigest()[:5], 16)
            sign = -1.0 if digits & 15 >= 8 else 1.0
            found = places[token] = ((digits >> 4) % dim, sign if weights is None else sign * weights[digits >> 4])
            return found

        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            if len(places) > 1_000_000:
                places.clear()
            # Each different token of a batch is looked up once.
            terms = batch.flatten().dictionary_encode()
            at = [places.get(t) or place(t) for t in terms.dictionary.to_pylist()]
            term = terms.indices.to_numpy(zero_copy_only=False)
            slots = np.repeat(np.arange(len(batch)), size) * dim + np.array([d for d, _ in at], np.int64)[term]
            sums = np.bincount(slots, np.array([w for _, w in at], float)[term], len(batch) * dim).astype(float).reshape(-1, dim)
            length = np.sqrt((sums * sums).sum(1, keepdims=True))
            unit = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)
            ends = pa.array(np.arange(len(batch) + 1) * dim, pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.array(unit.ravel()), mask=pa.array(size == 0))

    return vectors(tokens)
