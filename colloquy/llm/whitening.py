"""Whitened principal components of embeddings, by FEAST contour integration.

Spark makes the moments and the projections, one pass each: the sums of the integer
vectors, the covariance of the centred ones, and at the end the whitened rows. What
comes back to the driver has the size of one d x d matrix, whatever the number of rows;
each task holds two of them.

The eigenvectors come from contour integrals. Inertia counts (signs of the pivots of
``V - sI``, made tridiagonal) tell how many eigenvalues lie above any s, so they cut the spectrum in its
gaps into intervals of a few eigenvalues. For each interval the projector onto its
eigenvectors is the integral of ``(zI - V)^-1`` along a circle around it: quadrature
solves complex shifted systems for a few start vectors, Rayleigh-Ritz extracts
eigenpairs from what they span, and this is repeated until the residuals are at rounding
level. An interval is done only when it gave as many eigenpairs as the inertia counts say.

Rows: a vector that is null, empty, or holds null or non-finite entries (or entries
beyond 2^55, whose integers leave a long) is no vector of the list, nor is one of another
length than most have (the longer one on ties). Repeated rows count as often as they are
there. Components without variance, as of a single vector, cannot be whitened and are
left out; an empty table gives no rows. Whole rows are carried in one struct, so any
column names may occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import prepared, table

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries up to here keep ``SCALE * entry`` inside a long.
LARGEST = float(2**55)
#: Quadrature points on the half circle, eigenvalues meant for one interval, repetitions.
POINTS, PER_INTERVAL, ROUNDS = 8, 8, 60
#: Eigenvalues up to here, in radii of an interval, are part of its subspace.
MARGIN = 1.4
#: Eigenvalues nearer than this share of the largest one are not cut apart.
LEAST_GAP = 1e-9
#: A component needs this share of the trace; below it, only rounding is left.
LEAST_SHARE = 1e-12


# The eigenvalue problem


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, squared side diagonal) of a tridiagonal matrix with the eigenvalues of
    ``v``, by Householder reflections."""
    a = v.copy()
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        length = np.linalg.norm(u)
        if length > 0:
            u /= length
            a[k + 1 :] -= 2 * np.outer(u, u @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
    return np.diagonal(a).copy(), np.diagonal(a, 1) ** 2


class Spectrum:
    """Inertia counts of ``v``, and cuts in the gaps of its spectrum that follow from them."""

    def __init__(self, v: np.ndarray):
        self.diagonal, self.side = tridiagonal(v)
        self.reach = 1.01 * np.abs(v).sum(1).max()
        # The eigenvalues, largest first, bisected side by side until only rounding is left.
        low, high = np.full(len(v), -self.reach), np.full(len(v), self.reach)
        ranks = np.arange(1, len(v) + 1)
        for _ in range(52):
            middle = (low + high) / 2
            enough = self.above(middle) >= ranks
            low, high = np.where(enough, middle, low), np.where(enough, high, middle)
        self.places = (low + high) / 2

    def above(self, shifts: np.ndarray) -> np.ndarray:
        """How many eigenvalues exceed each shift: by Sylvester's law, the positive pivots
        of the shifted matrix."""
        shifts = np.atleast_1d(np.asarray(shifts, float))
        count, pivot = np.zeros(len(shifts), int), np.ones(len(shifts))
        for i, entry in enumerate(self.diagonal):
            pivot = entry - shifts - (self.side[i - 1] / pivot if i else 0.0)
            pivot = np.where(np.abs(pivot) < 1e-300, -1e-300, pivot)
            count += pivot > 0
        return count

    def intervals(self, components: int) -> list[tuple[float, float, int]]:
        """(low, high, eigenvalues inside) of intervals that hold the largest ``components``.

        A cut lies in the widest of the next few gaps; eigenvalues that lie too close to be
        told apart stay in one interval, however many they are.
        """
        places = np.append(self.places, min(0.0, self.places[-1]) - 0.05 * self.reach)
        gaps = places[:-1] - places[1:]
        out, done, high = [], 0, places[0] + 0.05 * self.reach
        while done < components:
            first = min(done + PER_INTERVAL, components)
            near = gaps[first - 1 : first + PER_INTERVAL]
            cut = first + int(np.argmax(near))
            if near.max() < LEAST_GAP * self.reach:
                cut = first + int(np.argmax(gaps[first - 1 :] >= LEAST_GAP * self.reach))
            low = (places[cut - 1] + places[cut]) / 2
            inside = int(self.above(low)[0]) - done
            out.append((low, high, inside))
            done, high = done + inside, low
        return out


def feast(v: np.ndarray, spectrum: Spectrum, low: float, high: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` eigenpairs of ``v`` with values in ``(low, high)``.

    Quadrature does not end sharply at the circle: the subspace has room for all
    eigenvalues near it as well, of which the inertia counts tell the number.
    """
    d, reach = len(v), MARGIN * (high - low) / 2
    below, beyond = spectrum.above([(low + high) / 2 - reach, (low + high) / 2 + reach])
    size = min(d, max(2 * wanted, int(below - beyond)) + 4)
    at, weight = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi / 2 * (1 - at))
    shifts = (low + high) / 2 + (high - low) / 2 * turn
    start = np.random.default_rng(d).normal(size=(d, size))
    best = None
    for _ in range(ROUNDS):
        total = np.zeros(start.shape)
        for z, w, t in zip(shifts, weight, turn):
            total += w * np.real(t * np.linalg.solve(z * np.eye(d) - v, start.astype(complex)))
        q, _ = np.linalg.qr(total)
        values, inner = np.linalg.eigh(q.T @ v @ q)
        start = q @ inner
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(v @ start - start * values, axis=0)
        if inside.sum() == wanted:
            worst = residual[inside].max()
            if best is not None and worst >= best[0] / 2 and best[0] < 1e-9 * abs(np.trace(v)):
                return best[1:]  # rounding level: no round makes it smaller
            if best is None or worst < best[0]:
                best = worst, values[inside], start[:, inside]
    if best is None or best[0] > 1e-9 * abs(np.trace(v)):
        raise ArithmeticError(f"{wanted} eigenvalues in ({low}, {high}) were not all found")
    return best[1:]


def components_of(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns), largest first; at most ``most`` of those
    with variance. The largest entry of every vector is positive."""
    scale = float(np.trace(v))
    if not len(v) or not scale > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    spectrum = Spectrum(v / scale)
    most = min(most, int(spectrum.above(LEAST_SHARE)[0]))
    if not most:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [feast(v / scale, spectrum, *interval) for interval in spectrum.intervals(most)]
    # One last Rayleigh-Ritz step over all intervals makes the vectors orthogonal.
    q, _ = np.linalg.qr(np.hstack([vectors for _, vectors in found]))
    values, inner = np.linalg.eigh(q.T @ (v / scale) @ q)
    vectors = (q @ inner)[:, ::-1][:, :most]
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])
    return values[::-1][:most] * scale, vectors


# Moments and projections on Spark


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x of all entries, offsets, usable rows) of a column of double lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    held = np.asarray(column.is_valid())
    size = np.asarray(column.value_lengths().fill_null(0), np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    good = np.abs(entries) <= LARGEST  # false for nulls, which are NaN here, too
    offsets = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~good)])
    usable = held & (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    x = np.floor(SCALE * np.where(good, entries, 0)).astype(np.int64) + SHIFT
    return x, offsets, usable


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their x as a matrix) of the usable vectors of length ``d``."""
    x, offsets, usable = _integers(column)
    rows = np.flatnonzero(usable & (np.diff(offsets) == d))
    return rows, x[offsets[rows][:, None] + np.arange(d)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """The exact integers ``n * x - S``; Python's where a long could not hold them."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    kind = np.int64 if reach < 2**62 else object
    return n * x.astype(kind) - np.array(sums, kind)


def _sums_by_length(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(n, d, S) of the fit list; halves of 32 bits keep the sums exact."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x, offsets, usable = _integers(batch.column(0))
            size = np.diff(offsets)
            for d in np.unique(size[usable]):
                rows = np.flatnonzero(usable & (size == d))
                part = x[offsets[rows][:, None] + np.arange(d)]
                total = held.setdefault(int(d), np.zeros((3, d), np.int64))
                total += np.stack([np.full(d, len(rows)), (part >> 32).sum(0), (part & 0xFFFFFFFF).sum(0)])
        for d, total in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d)), pa.array(np.arange(d)), *map(pa.array, total)], ["d", "j", "n", "high", "low"]
            )

    partial = vectors.mapInArrow(per_task, "d bigint, j bigint, n bigint, high bigint, low bigint")
    by_place = partial.groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    # A corpus has few lengths; the one of most rows is looked up before its sums are read.
    most = by_place.where("j = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return 0, 0, []
    rows = sorted(by_place.where(F.col("d") == most["d"]).collect(), key=lambda r: r["j"])
    return most["n"], most["d"], [(r["high"] << 32) + r["low"] for r in rows]


def _summed(vectors: DataFrame, shape: tuple[int, int], of_batch: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the matrices that ``of_batch`` gives for batches.

    A task adds up its own, Spark adds the tasks' entries; one matrix comes back.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += of_batch(batch.column(0))
        i, j = np.indices(shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, total)], ["i", "j", "v"])

    out = np.zeros(shape)
    entries = vectors.mapInArrow(per_task, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for row in entries.collect():
        out[row["i"], row["j"]] = row["v"]
    return out


class Whitening:
    """A fitted whitening: n, sums, eigenvalues, eigenvectors and the trace of V."""

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS):
        n, d, sums = _sums_by_length(vectors)
        self.n, self.d, self.sums = n, d, sums
        if not n:
            self.values, self.vectors, self.trace = np.zeros(0), np.zeros((0, 0)), 0.0
            return

        def products(column: pa.Array) -> np.ndarray:
            c = (_centred(_matrix(column, d)[1], n, sums) / n).astype(float)
            return c.T @ c

        v = _summed(vectors, (d, d), products) / n
        v = (v + v.T) / 2
        self.trace = float(np.trace(v))
        self.values, self.vectors = components_of(v, components)

    def project(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row numbers, exact ``n * x - S``, whitened rows) of a batch."""
        rows, x = _matrix(column, self.d)
        centred = _centred(x, self.n, self.sums)
        return rows, centred, (centred / self.n).astype(float) @ (self.vectors / np.sqrt(self.values))

    def identity_error(self, vectors: DataFrame) -> float:
        """Largest entry of the whitened rows' covariance minus the identity."""
        k = len(self.values)
        if not k:
            return 0.0
        fitted = self
        mean = _summed(vectors, (1, k), lambda c: fitted.project(c)[2].sum(0, keepdims=True)) / self.n

        def products(column: pa.Array) -> np.ndarray:
            w = fitted.project(column)[2] - mean
            return w.T @ w

        return float(np.abs(_summed(vectors, (k, k), products) / self.n - np.eye(k)).max())


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where a long cannot hold one."""
    reach = int(np.abs(centred).max(initial=0))
    if reach * reach * centred.shape[1] < 2**63:
        return (centred.astype(np.int64) ** 2).sum(1).tolist()
    whole = [sum(int(c) * int(c) for c in row) for row in centred]
    return [w if w < 2**63 else None for w in whole]


def whiten(found: DataFrame, vector: str, components: int = COMPONENTS) -> DataFrame:
    """Every usable row of ``found`` (as struct ``row``) with its whitened components.

    One row for each component: ``component`` from 1, ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.
    """
    vectors = found.select(F.col(vector).cast("array<double>").alias("v"))
    fitted = Whitening(vectors, components)
    error, k = fitted.identity_error(vectors), len(fitted.values)
    share = fitted.values / fitted.trace if k else fitted.values
    carried = found.select(F.col(vector).cast("array<double>").alias("v"), F.struct(*[F.col(f"`{c}`") for c in found.columns]).alias("row"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k:
                continue
            rows, centred, white = fitted.project(batch.column(0))
            m = len(rows)
            each = np.repeat(np.arange(m), k)
            deviation = pa.array(_deviations(centred), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(rows[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fitted.n, np.int64)),
                    deviation.take(pa.array(each)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["row", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = carried.schema["row"].dataType.simpleString()
    return carried.mapInArrow(
        rows_of,
        f"row {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The 32 whitened components of every vector of ``embeddings``."""
    found = table(prepared(spark), sf_dir, "embeddings").select("vec_id", "embedding")
    named = found.select("embedding", "vec_id")
    return whiten(named, "embedding").select(
        "row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )
