"""Whitening of embeddings by the leading eigenvectors of their covariance.

The eigenvectors come from Chebyshev-filtered subspace iteration. A block of ``components + GUARD``
directions Q goes to the tasks, each adds up its part of X'XQ over the centred vectors, and Spark sums
the parts: one such pass is one application of the covariance, and nothing larger than dimensions x
directions reaches the driver. A polynomial of up to ``DEGREE`` passes in Chebyshev's recurrence damps the
spectrum between zero and the smallest Ritz value of the block, QR makes the block orthonormal, and a
Rayleigh-Ritz step gives eigenvalues, eigenvectors and their residuals. Rounds go on until all residuals
are below ``RESIDUAL`` times the largest eigenvalue, or rounding keeps them from falling further.

Vectors are integers floor(scale * c). The fit counts equal vectors once; sums are exact integers.

Defined results: rows with a null vector or null or non-finite entries are dropped, as are empty vectors,
vectors of another length than the most frequent one (the shortest of equally frequent ones) and those
with entries of 2**53 and more after scaling; rows without id or repeated under one id stay, one result
each; components whose eigenvalue is zero to rounding are left out, so equal vectors or one vector alone
give no rows, and so does an empty table; a deviation beyond the range of a long is null. Only the named
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

COMPONENTS = 4
GUARD = 28
#: Passes of a polynomial at most, and how far it may raise the first wanted direction over the last one.
DEGREE = 16
SPREAD = 1e4
ROUNDS = 200
RESIDUAL = 1e-13
#: Residuals that rounding may leave, relative to the largest eigenvalue.
FLOOR = 1e-10
#: Eigenvalues up to this part of the largest one are zero.
ZERO = 1e-12


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with exact ``sums``; ``values`` fall; ``axes`` holds a component a column."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float


def integer_vectors(rows: DataFrame, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable rows, stored."""
    c = F.col("x").cast("array<double>")
    named = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("x")).withColumn("x", c)
    sound = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < float(1 << 53)))
    made = stored(
        named.where(F.col("x").isNotNull() & (F.size("x") > 0) & sound).select(
            "vec_id", F.transform("x", lambda e: F.floor(e * scale) + 0).alias("x")
        )
    )
    length = made.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return made.where(F.size("x") == (length["d"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _blocks(vectors: DataFrame) -> DataFrame:
    """Each distinct vector once, packed into rows of many vectors, in the narrowest integers that hold them."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                kind = np.result_type(np.min_scalar_type(x.min()), np.min_scalar_type(x.max()), np.int8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(x)], pa.int64()),
                        pa.array([kind.str]),
                        pa.array([x.astype(kind).tobytes()], pa.binary()),
                    ],
                    names=["n", "kind", "data"],
                )

    return stored(vectors.select("x").distinct().mapInArrow(run, "n bigint, kind string, data binary"))


def _unpacked(batches) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["data"], dtype=np.dtype(row["kind"])).reshape(row["n"], -1)
            yield x.astype(np.int64)


def _exact_sums(blocks: DataFrame) -> tuple[int, list[int], int]:
    """The number of vectors, the sum of each dimension, and the sum of all squares."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for x in _unpacked(batches):
            top = int(np.abs(x).max())
            exact = x if top * top * len(x) < 1 << 62 else x.astype(object)
            sums, squares = exact.sum(axis=0), (exact * exact).sum(axis=0)
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(x.shape[1]), pa.int32()),
                    pa.array([int(s) for s in sums], kind),
                    pa.array([int(s) for s in squares], kind),
                ],
                names=["i", "s", "q"],
            )

    n = blocks.agg(F.sum("n")).first()[0] or 0
    parts = blocks.mapInArrow(run, "i int, s decimal(38,0), q decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").collect()
    return n, [int(r.s) for r in rows], sum(int(r.q) for r in rows)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, from exact differences where they fit."""
    if n * int(np.abs(x).max()) + max(abs(s) for s in sums) < 1 << 62:
        return (x * n - np.array(sums, dtype=np.int64)) / n
    mean = np.array([np.longdouble(s) / np.longdouble(n) for s in sums])
    return (x - mean).astype(np.float64)


def _added_up(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (a flat array) over all blocks: one pass over the vectors."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _unpacked(batches):
            own = part(x)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "y"]
            )

    rows = blocks.mapInArrow(run, "i int, y double").groupBy("i").agg(F.sum("y").alias("y")).collect()
    out = np.empty(len(rows))
    for r in rows:
        out[r.i] = r.y
    return out


def leading_pairs(
    apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a positive semidefinite operator and their vectors, by columns."""
    k = min(d, wanted + GUARD)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((d, k)))[0]
    before, shrink = np.inf, 1.0
    for _ in range(ROUNDS):
        w = apply(q)
        h = q.T @ w
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        if values[0] <= 0:
            return values[:0], q[:, :0]
        own = np.linalg.norm(w - q * values, axis=0)[:wanted]
        residual = float(own.max() / values[0])
        if residual <= RESIDUAL or (residual <= FLOOR and residual > before / 2) or k == d:
            return values[:wanted], q[:, :wanted]
        if residual > before / 2:  # the cut lies within a cluster: leave more of the spectrum alone
            shrink *= 0.9
        before = residual
        cut = max(values[-1] * shrink, values[0] * 1e-8)
        q = _filtered(apply, q, w, cut, values[0], max(values[min(wanted, k) - 1], cut))
    raise ArithmeticError("the eigenvectors have not converged")


def _filtered(apply, x: np.ndarray, vx: np.ndarray, cut: float, top: float, last: float) -> np.ndarray:
    """An orthonormal block after the polynomial that damps [0, cut]; ``vx`` is the first application.

    ``top`` and ``last`` are the first and last wanted eigenvalues.
    """
    half = cut / 2
    apart = np.arccosh(max(top / half - 1, 1)) - np.arccosh(max(last / half - 1, 1))
    degree = DEGREE if apart * DEGREE <= np.log(SPREAD) else max(2, int(np.log(SPREAD) / apart))
    sigma = first = half / (top - half)
    y = (vx - half * x) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        x, y = y, (apply(y) - half * y) * (2 * after / half) - x * (sigma * after)
        sigma = after
    return np.linalg.qr(y)[0]


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of (vec_id, x) as ``integer_vectors`` gives them."""
    blocks = _blocks(vectors)
    n, sums, squares = _exact_sums(blocks)
    d = len(sums)
    trace = (n * squares - sum(s * s for s in sums)) / (n * n) if n else 0.0
    if trace <= 0:
        return Whitening(n, sums, np.empty(0), np.empty((d, 0)), np.empty(0), 0.0)

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return (c.T @ (c @ q)).ravel()

        return _added_up(blocks, part).reshape(q.shape) / n

    values, axes = leading_pairs(apply, d, min(components, d))
    real = values > ZERO * values[0]
    values, axes = values[real], axes[:, real]
    m = len(values)
    scaled = axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = _centred(x, n, sums) @ scaled
        return np.concatenate((white.sum(axis=0), (white.T @ white).ravel()))

    total = _added_up(blocks, moments) / n
    mean, second = total[:m], total[m:].reshape(m, m)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())
    return Whitening(n, sums, values, axes, values / trace, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums of squares of n * x - S: exact modulo 2**64, and null where the size says they do not fit."""
    wrap = lambda v: np.uint64(v % (1 << 64))
    diff = x.view(np.uint64) * wrap(n) - np.array([wrap(s) for s in sums], dtype=np.uint64)
    exact = (diff * diff).sum(axis=1).view(np.int64)
    rough = ((_centred(x, n, sums) * float(n)) ** 2).sum(axis=1)
    fits = rough < float(1 << 63) * (1 - 1e-9)
    return pa.array(exact, pa.int64(), mask=~fits)


def whiten(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    m = len(fitted.values)
    scaled = fitted.axes / np.sqrt(fitted.values)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not m:
                continue
            x = _matrix(batch.column("x"))
            each = pa.array(np.repeat(np.arange(len(x)), m))
            white = _centred(x, fitted.n, fitted.sums) @ scaled
            columns = {
                "vec_id": batch.column("vec_id").take(each),
                "component": pa.array(np.tile(np.arange(1, m + 1), len(x)), pa.int32()),
                "n": pa.array(np.full(len(x) * m, fitted.n), pa.int64()),
                "deviation": _deviations(x, fitted.n, fitted.sums).take(each),
                "whitened": pa.array(white.ravel(), pa.float64()),
                "explained": pa.array(np.tile(fitted.explained, len(x)), pa.float64()),
                "identity_error": pa.array(np.full(len(x) * m, fitted.identity_error), pa.float64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(
        run,
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double",
    )
