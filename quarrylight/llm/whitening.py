"""Embedding whitening by spectrum slicing.

*Sums.*  Entries become integers, x = floor(scale * entry) + shift, so every sum is exact
and none depends on the order of tasks.  Two passes gather, from one row a task and
dimension (or pair of dimensions), the sums S and then the products of x - floor(S / n):
centred before multiplying, corrected exactly by the rest of S, and divided once.

*Slicing.*  The covariance V is brought to tridiagonal form by reflections, which keep
its inertia.  The signs in D of L D Lᵀ = V - sI count the eigenvalues above a shift s;
bisecting shifts isolates each of the leading eigenvalues, Rayleigh quotient iteration on
V itself converges in its interval cubically, and two more counts, on either side of what
it found, certify the eigenvalue's number.  Eigenvalues that no double tells apart are
one slice, whose vectors are any orthonormal basis.  The driver holds the covariance
alone: dims * dims numbers, however many rows there are.

*Error.*  A further pass measures the covariance of the whitened values themselves.

Defined results: rows take no part if their vector is null, empty, holds null or a number
that is not finite, or is of another length than most of the rest (of equally frequent
lengths, the longest counts).  Entries that pass 2**48 in size are taken as 2**48.  Null
ids are kept, repeated rows count each time, other columns are not read.  Directions
without variance have no component, so one row, or equal rows, give no result.
``deviation`` is null where it passes a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import ship_package

#: Sizes up to which entries, once scaled, are told apart.
LARGEST = float(1 << 48)
#: A sum over tasks: exact, far beyond 64 bits.
EXACT = T.DecimalType(38, 0)
EPS = float(np.finfo(float).eps)


def integers(vector, scale: int, shift: int):
    """The integer vector of a column; null where the row takes no part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    bounded = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.lit(float(scale)) * c.cast("double")))
    return F.when((F.size(vector) > 0) & finite, F.transform(vector, lambda c: F.floor(bounded(c)).cast("long") + shift))


# -- eigenvalues by counts


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a matrix of the same eigenvalues."""
    a = np.array(matrix, float)
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v /= size
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        x = a[k + 1 :, k]
        x -= 2 * (v @ x) * v
        a[k, k + 1 :] = x
    return np.diag(a).copy(), np.diag(a, 1) ** 2


class Slices:
    """Counts of a symmetric matrix's eigenvalues above shifts."""

    def __init__(self, matrix: np.ndarray) -> None:
        largest = float(np.abs(matrix).max())
        #: A power of two, so that dividing by it is exact; no row's sum is above 1 then.
        self.unit = math.ldexp(1.0, math.frexp(largest * len(matrix))[1]) if largest else 1.0
        self.matrix = matrix / self.unit
        diagonal, squares = tridiagonal(self.matrix)
        self.diagonal, self.squares = diagonal.tolist(), [0.0, *squares.tolist()]
        self.size = float(np.abs(self.matrix).sum(axis=1).max())
        #: Eigenvalues closer than this can't be told apart by doubles.
        self.width = 8 * len(matrix) * EPS * self.size

    def above(self, shift: float) -> int:
        """Positive pivots in L D Lᵀ of the shifted matrix; all is in units of ``unit``."""
        pivot, positive, least = 1.0, 0, EPS * EPS * self.size
        for a, square in zip(self.diagonal, self.squares, strict=True):
            pivot = a - shift - square / pivot
            if abs(pivot) < least:
                pivot = -least
            positive += pivot > 0
        return positive

    def leading(self, most: int) -> list[tuple[float, np.ndarray]]:
        """The ``most`` largest eigenvalues, falling, with unit vectors."""
        if not self.matrix.any():
            return [(0.0, v) for v in np.eye(len(self.matrix))[:most]]
        low, high = -1.01 * self.size, 1.01 * self.size
        work, found = [(low, high, len(self.matrix), 0)], []
        while work and len(found) < most:
            low, high, over_low, over_high = work.pop()
            if over_low == over_high:
                continue
            middle = (low + high) / 2
            narrow = high - low <= self.width or not low < middle < high
            got = None
            if narrow:
                got = self.basis(middle, over_low - over_high, [v for _, v in found])
            elif over_low - over_high == 1:
                got = self.converged(low, high, [v for e, v in found if e - high < 1e-3 * self.size])
            if got is not None:
                found += got
                continue
            over = self.above(middle)
            work += [(low, middle, over_low, over), (middle, high, over, over_high)]  # the upper one is taken first
        found = sorted(found, key=lambda x: -x[0])[:most]
        for number, (value, _) in enumerate(found, 1):
            if not self.above(value + self.width) < number <= self.above(value - self.width):
                raise ArithmeticError(f"eigenvalue {number} is not certified")
        return [(value * self.unit, v) for value, v in found]

    def _start(self, others: list[np.ndarray], seed: int) -> np.ndarray:
        return self._apart(np.random.default_rng(seed).normal(size=len(self.matrix)), others)

    def _apart(self, v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):  # twice is enough
            for other in others:
                v = v - (other @ v) * other
        return v / np.linalg.norm(v)

    def _solved(self, shift: float, v: np.ndarray) -> np.ndarray:
        eye = np.eye(len(v))
        for bump in (0.0, 1.0, -2.0):
            try:
                w = np.linalg.solve(self.matrix - (shift + bump * EPS * self.size) * eye, v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(w).all() and w.any():
                return w / np.linalg.norm(w)
        raise ArithmeticError("no direction at a shift")

    def converged(self, low: float, high: float, near: list[np.ndarray]) -> list[tuple[float, np.ndarray]] | None:
        """Rayleigh quotient iteration for the one eigenvalue of an interval; None if it
        leaves the interval, which must be halved then.  ``near``: vectors of eigenvalues
        close by, which it stays orthogonal to."""
        v, shift = self._start(near, len(near)), (low + high) / 2
        v = self._apart(self._solved(shift, v), near)
        for _ in range(12):
            value = float(v @ self.matrix @ v)
            if not low - self.width <= value <= high + self.width:
                return None
            if np.linalg.norm(self.matrix @ v - value * v) <= self.width / 8:
                return [(value, v)]
            v = self._apart(self._solved(value, v), near)
        return None

    def basis(self, shift: float, number: int, others: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        """Vectors of eigenvalues that are equal as far as doubles tell."""
        out = []
        for k in range(number):
            v = self._start(others, k)
            for _ in range(4):
                v = self._apart(self._solved(shift, v), others)
            others = [*others, v]
            out.append((float(v @ self.matrix @ v), v))
        return out


# -- passes over the rows


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def _exact(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def products(y: np.ndarray) -> np.ndarray:
    """yᵀy in Python integers: by doubles while those are exact."""
    largest = int(np.abs(y).max(initial=0))
    if largest >= 1 << 26:
        y = y.astype(object)
        return y.T @ y
    out, step = np.zeros((y.shape[1],) * 2, object), max(1, (1 << 53) // max(1, largest * largest))
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(float)
        out += (part.T @ part).astype(np.int64)
    return out


def _gathered(rows: DataFrame, dims: int, size: int, of_batch, exact: bool) -> np.ndarray:
    """The sum over all rows of ``of_batch(vectors)``, an array of ``size`` numbers: a
    row a task and number goes through the shuffle, ``size`` rows come to the driver."""
    kind = EXACT if exact else T.DoubleType()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object if exact else float)
        for batch in batches:
            total = total + of_batch(_vectors(batch.column("x"), dims))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), _exact(total[at]) if exact else pa.array(total[at])], names=["at", "total"])

    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("total", kind)])
    out = np.zeros(size, object if exact else float)
    for row in rows.select("x").mapInArrow(add, schema).groupBy("at").agg(F.sum("total").cast(kind).alias("total")).toLocalIterator():
        out[row.at] = int(row.total) if exact else row.total
    return out


@dataclass
class Whitening:
    """What whitens a vector: S = n * base + rest, eigenvalues, vectors as columns."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        y = x - self.base
        if int(np.abs(y).max(initial=0)) * self.n >= 1 << 61:
            y = y.astype(object)
        return y * self.n - self.rest.astype(y.dtype)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.vectors / np.sqrt(self.values)

    @staticmethod
    def deviations(centred: np.ndarray) -> list[int | None]:
        if len(centred) and int(np.abs(centred).max()) ** 2 * centred.shape[1] >= 1 << 63:
            centred = centred.astype(object)
        return [int(v) if int(v) < 1 << 63 else None for v in (centred * centred).sum(axis=1)]


def fit(rows: DataFrame, dims: int, most: int) -> Whitening | None:
    """From rows with ``x``, all of ``dims`` numbers; None without variance."""
    sums = _gathered(rows, dims, dims + 1, lambda x: np.append(x.sum(axis=0).astype(object), len(x)), True)
    n, sums = int(sums[-1]), sums[:-1]
    if n < 2:
        return None
    base, rest = np.array([int(s) // n for s in sums], np.int64), np.array([int(s) % n for s in sums], object)
    upper = np.triu_indices(dims)
    found = _gathered(rows, dims, len(upper[0]), lambda x: products(x - base)[upper], True)
    covariance = np.zeros((dims, dims))
    for i, j, s in zip(*upper, found, strict=True):
        covariance[i, j] = covariance[j, i] = (n * int(s) - int(rest[i]) * int(rest[j])) / (n * n)
    slices = Slices(covariance)
    kept = [(e, v) for e, v in slices.leading(most) if e > slices.width * slices.unit]
    if not kept:
        return None
    return Whitening(n, base, rest, np.array([e for e, _ in kept]), np.array([v for _, v in kept]).T, float(np.trace(covariance)))


def whiten(rows: DataFrame, *, most: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """-> id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``,
    ``identity_error``: a row a vector and component, ``most`` components at most."""
    spark = rows.sparkSession
    ship_package(spark)
    rows = rows.select(F.col(id_col), integers(F.col(vector_col), scale, shift).alias("x")).filter("x is not null")
    schema = T.StructType(
        [rows.schema[0], *(T.StructField(n, t) for n, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))]
    )
    usual = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    model = None
    if usual is not None:
        dims = usual.dims
        rows = rows.filter(F.size("x") == dims)
        model = fit(rows, dims, most)
    if model is None:
        return spark.createDataFrame([], schema)
    k = len(model.values)
    shared = spark.sparkContext.broadcast(model)

    def of_whitened(x: np.ndarray) -> np.ndarray:
        z = shared.value.whitened(shared.value.centred(x))
        return (z.T @ z).ravel()

    error = float(np.abs(_gathered(rows, dims, k * k, of_whitened, False).reshape(k, k) / model.n - np.eye(k)).max())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                number = batch.num_rows
                centred = own.centred(_vectors(batch.column(1), dims))
                each = np.repeat(np.arange(number), k)
                columns = [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), number)),
                    pa.array(np.full(number * k, own.n)),
                    pa.array(own.deviations(centred), pa.int64()).take(pa.array(each)),
                    pa.array(own.whitened(centred).ravel()),
                    pa.array(np.tile(own.values / own.trace, number)),
                    pa.array(np.full(number * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(apply, schema)
