"""Embedding whitening: Welford updates in partition iterators, merged in parallel, and a symmetric QR eigen-solve."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._shared import forget, private_names, store

#: Entries become floor(SCALE * c) + OFFSET. What is added cancels in every result.
SCALE, OFFSET = 1024, 100_000
#: Entries of so large a scaled value, or larger, are no 64-bit numbers: they count as not finite.
MOST = 2.0**62
#: Partial moments that one task merges into one.
FAN = 16
#: Bytes of the fits of all lengths of vectors that are shipped to every task.
MOST_FIT_BYTES = 64 << 20
_PARTIAL = "dims int, node long, n long, sums array<decimal(38,0)>, mean binary, m2 binary"


class Moments:
    """Number, mean and centred products of vectors."""

    def __init__(self, n: int, mean: np.ndarray, m2: np.ndarray):
        self.n, self.mean, self.m2 = n, mean, m2
        self._buffer = np.empty_like(m2)

    @classmethod
    def empty(cls, dims: int) -> Moments:
        return cls(0, np.zeros(dims), np.zeros((dims, dims)))

    def add(self, v: np.ndarray) -> None:
        """Welford's update by one vector: of rank one, centred before it is multiplied."""
        self.n += 1
        before = v - self.mean
        self.mean += before / self.n
        np.multiply(before[:, None], before * ((self.n - 1) / self.n), out=self._buffer)
        self.m2 += self._buffer

    def merge(self, other: Moments) -> None:
        """The update by the moments of other vectors."""
        if not other.n:
            return
        n = self.n + other.n
        apart = other.mean - self.mean
        self.mean = self.mean + apart * (other.n / n)
        self.m2 = self.m2 + other.m2 + np.multiply.outer(apart, apart) * (self.n * (other.n / n))
        self.n = n

    def row(self, node: int, sums: list[int]) -> tuple:
        """What travels: the upper triangle of the products, row by row."""
        return len(self.mean), node, self.n, [Decimal(s) for s in sums], self.mean.tobytes(), self.m2[np.triu_indices(len(self.mean))].tobytes()

    @classmethod
    def of_row(cls, dims: int, n: int, mean: bytes, m2: bytes) -> Moments:
        out = cls.empty(dims)
        out.n, out.mean = n, np.frombuffer(mean).copy()
        at = np.triu_indices(dims)
        out.m2[at] = np.frombuffer(m2)
        out.m2.T[at] = out.m2[at]
        return out


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows of a symmetric matrix.

    Householder reflections make it tridiagonal; implicit QR steps with Wilkinson's shift, as plane rotations that
    chase the bulge down, make that diagonal. The largest component of each vector is positive."""
    a = np.array(a, np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if not v[1:].any():
            continue
        alpha = -math.copysign(float(np.linalg.norm(v)), v[0])
        v[0] -= alpha
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0.0
        a[k + 1, k] = a[k, k + 1] = alpha
        q[k + 1 :] -= 2 * np.multiply.outer(v, v @ q[k + 1 :])
    d, e = np.diag(a).tolist(), np.diag(a, 1).tolist()
    hi, steps = n - 1, 0
    while hi > 0:
        for i in range(hi):
            if abs(e[i]) <= np.finfo(float).eps * (abs(d[i]) + abs(d[i + 1])):
                e[i] = 0.0
        if e[hi - 1] == 0.0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0.0:
            lo -= 1
        steps += 1
        if steps > 60 * n:
            raise RuntimeError("the eigen-solve did not settle")
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] * (e[hi - 1] / (half + math.copysign(math.hypot(half, e[hi - 1]), half)))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, ek, dn = d[k], e[k], d[k + 1]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k : k + 2] = np.array(((c, s), (-s, c))) @ q[k : k + 2]
    order = np.argsort(-np.array(d), kind="stable")
    vectors = q[order]
    flip = vectors[np.arange(n), np.abs(vectors).argmax(axis=1)] < 0
    vectors[flip] *= -1
    return np.array(d)[order], vectors


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors of a column of lists."""
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(len(at), size)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) as 64-bit numbers, without OFFSET."""
    return np.floor(x * SCALE).astype(np.int64)


def _partials(prepare: Callable[[np.ndarray], np.ndarray], exact: bool):
    """For each length of vectors the moments of a partition, and the exact sums of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                y = prepare(x)
                moments, high, low = held.setdefault(x.shape[1], (Moments.empty(y.shape[1]), np.zeros(y.shape[1], np.int64), np.zeros(y.shape[1], np.int64)))
                if exact:  # in halves, which cannot overflow
                    high += (y >> 32).sum(axis=0)
                    low += (y & 0xFFFFFFFF).sum(axis=0)
                for v in y.astype(np.float64):
                    moments.add(v)
        for dims, (moments, high, low) in held.items():
            row = moments.row(node, [(int(h) << 32) + int(b) for h, b in zip(high, low, strict=True)] if exact else [])
            yield _partial_batch([(dims, *row[1:])])

    return run


def _partial_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.binary(), pa.binary())
    names = [c.split()[0] for c in _PARTIAL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by length and node: those of one node are merged, one at a time."""
    at, moments, sums = None, None, []
    for batch in batches:
        for i in range(batch.num_rows):
            dims, node, n, s, mean, m2 = (c[i].as_py() for c in batch.columns)
            one = Moments.of_row(len(mean) // 8, n, mean, m2)
            if (dims, node) == at:
                moments.merge(one)
                sums = [a + int(b) for a, b in zip(sums, s, strict=True)]
                continue
            if at:
                yield _partial_batch([(at[0], *moments.row(at[1], sums)[1:])])
            at, moments, sums = (dims, node), one, [int(b) for b in s]
    if at:
        yield _partial_batch([(at[0], *moments.row(at[1], sums)[1:])])


def _merged(partials: DataFrame) -> DataFrame:
    """One row of moments for each length. Merging goes up a tree of FAN partials a node, so no task holds more than
    two, and none reads more than FAN of a length at a time."""
    now = store(partials)
    last = now.agg(F.max("node")).first()[0] or 0
    while last > 0:
        up = now.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        dealt = up.repartition("dims", "node").sortWithinPartitions("dims", "node", F.hash("mean"))
        after, last = store(dealt.mapInArrow(_merge, _PARTIAL)), last // FAN
        forget(now)
        now = after
    return now


def _sound(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has only finite entries that fit a whole number, as doubles, in a column of its own."""
    (name,) = private_names(vectors.columns, "vector")
    rows = vectors.withColumn(name, F.col(column).cast("array<double>"))
    whole = F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * SCALE < MOST))
    return rows.where(F.col(name).isNotNull() & F.coalesce(whole, F.lit(False)) & (F.size(name) > 0))


def _solve(most: int):
    """From the moments of a length to its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, _, n, sums, mean, m2 = (c[i].as_py() for c in batch.columns)
                covariance = Moments.of_row(dims, n, mean, m2).m2 / n
                values, vectors = symmetric_qr(covariance)
                k = min(most, dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dims], pa.int32()), pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.decimal128(38, 0))), pa.array([values[:k].tolist()]), pa.array([float(np.trace(covariance))]), pa.array([vectors[:k].tobytes()], pa.binary())],
                    names=["dims", "n", "sums", "eigenvalues", "trace", "components"],
                )

    return run


class Fit:
    """What whitening needs to know of the vectors of one length."""

    def __init__(self, dims: int, n: int, sums: list[int], values: list[float], trace: float, components: bytes):
        self.dims, self.n, self.sums, self.trace = dims, n, sums, trace
        self.values = np.array(values)
        self.components = np.frombuffer(components).reshape(len(values), dims)
        self.mean = np.array([s / n for s in sums])
        #: A direction without variance, beyond rounding, has no unit of its own.
        self.flat = self.values <= max(self.values.max(), 0.0) * dims * np.finfo(float).eps
        scale = np.where(self.flat, np.nan, 1 / np.sqrt(np.where(self.flat, 1.0, self.values)))
        self.project = (self.components * scale[:, None]).T

    @property
    def explained(self) -> np.ndarray:
        return np.maximum(self.values, 0.0) / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y - self.mean) @ self.project

    def deviations(self, y: np.ndarray) -> list[int]:
        """Exact sums of (n * x - S)**2."""
        most = self.n * max(abs(int(y.max())), abs(int(y.min())), 1) + max(map(abs, self.sums))
        if self.dims * most * most < 2**63:
            apart = y * self.n - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in y.tolist()]


def fit_whitening(vectors: DataFrame, components: int = 8, vector_column: str = "embedding") -> DataFrame:
    """(dims, n, sums, eigenvalues, trace, components) of all sound vectors, a row for each of their lengths.

    sums are those of floor(1024 * c), exact; components are unit eigenvectors of the covariance, divisor n,
    as the bytes of doubles, one after the other, by falling eigenvalue, at most so many. Which
    vectors are sound is said at ``whiten``. An empty table gives no rows.
    """
    column = F.col(private_names(vectors.columns, "vector")[0]).alias("vector")
    moments = _merged(_sound(vectors, vector_column).select(column).mapInArrow(_partials(scaled, True), _PARTIAL))
    return store(moments.mapInArrow(_solve(components), "dims int, n long, sums array<decimal(38,0)>, eigenvalues array<double>, trace double, components binary"))


def collect_fits(fits: DataFrame) -> dict[int, Fit]:
    """The fits on the driver: bounded by their size, which grows with the lengths of vectors and not with their number."""
    amount = fits.agg(F.coalesce(F.sum((F.size("eigenvalues") + 2) * F.col("dims") * 8), F.lit(0))).first()[0]
    if amount > MOST_FIT_BYTES:
        raise ValueError(f"fits of {amount} bytes: the vectors have too many lengths")
    return {r.dims: Fit(r.dims, r.n, [int(s) for s in r.sums], r.eigenvalues, r.trace, bytes(r.components)) for r in fits.toLocalIterator()}


def identity_errors(vectors: DataFrame, fits: dict[int, Fit], vector_column: str = "embedding") -> dict[int, float]:
    """For each length the largest absolute entry of the covariance of the whitened vectors minus the identity, measured
    on all of them; components without variance are left out."""

    def prepare(x: np.ndarray) -> np.ndarray:
        fit = fits[x.shape[1]]
        return fit.whitened(scaled(x))[:, ~fit.flat]

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, _, n, _, mean, m2 = (c[i].as_py() for c in batch.columns)
                own = Moments.of_row(len(mean) // 8, n, mean, m2)
                error = float(np.abs(own.m2 / n - np.eye(len(own.mean))).max()) if len(own.mean) else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([error])], names=["dims", "error"])

    column = F.col(private_names(vectors.columns, "vector")[0]).alias("vector")
    moments = _merged(_sound(vectors, vector_column).select(column).mapInArrow(_partials(prepare, False), _PARTIAL))
    return {r.dims: r.error for r in moments.mapInArrow(errors, "dims int, error double").toLocalIterator()}


def whiten(vectors: DataFrame, fits: dict[int, Fit] | None = None, components: int = 8, vector_column: str = "embedding") -> DataFrame:
    """The rows of sound vectors with dims, whitened (array of double) and deviation (decimal).

    A vector's entries become x = floor(1024 * c) + 100000. whitened is x without the mean of all x, projected
    on the first unit eigenvectors of their covariance and divided by the square roots of the eigenvalues;
    deviation is the exact sum over dimensions of (n * x - S)**2, null beyond 38 digits. Rows are dropped whose vector is
    null, empty, or holds null or non-finite entries, or entries beyond 2**52, whose x is no 64-bit number.
    Vectors of each length are fitted and whitened among themselves. A component without variance, as all are of
    a single vector or of copies of one, has whitened values of null. Repeated rows count as often as they
    occur. An empty table gives no rows. Other columns pass through, whatever their names, except that columns named dims,
    whitened or deviation are replaced.

    Moments of each partition are kept by updates of rank one and merged up a tree; what leaves a task is
    one triangle of products for each length. Nothing but those is shuffled.
    """
    fits = collect_fits(fit_whitening(vectors, components, vector_column)) if fits is None else fits
    vectors = vectors.drop(*[n for n in vectors.columns if n.lower() in ("dims", "whitened", "deviation")])
    own = private_names(vectors.columns, "vector")[0]
    rows = _sound(vectors, vector_column)
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in vectors.schema] + ["dims int", "whitened array<double>", "deviation decimal(38,0)"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(own)
            for at, x in _matrices(batch.column(place)):
                fit, y = fits[x.shape[1]], scaled(x)
                white = fit.whitened(y)
                flat = pa.array(white.ravel(), mask=np.isnan(white).ravel())
                white = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)), flat)
                apart = pa.array([Decimal(v) if v < 10**38 else None for v in fit.deviations(y)], pa.decimal128(38, 0))
                kept = [c.take(pa.array(at)) for k, c in enumerate(batch.columns) if k != place]
                names = [c for c in batch.schema.names if c != own]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(at), fit.dims, np.int32)), white, apart], names=[*names, "dims", "whitened", "deviation"])

    return rows.mapInArrow(run, schema)


def digest(vectors: DataFrame, components: int = 8) -> DataFrame:
    """A row for each vector and component, with n, explained and identity_error of the fit."""
    vectors = vectors.select("vec_id", "embedding")
    fits = collect_fits(fit_whitening(vectors, components))
    errors = identity_errors(vectors, fits)
    about = vectors.sparkSession.createDataFrame(
        [(f.dims, k + 1, f.n, float(f.explained[k]), errors[f.dims]) for f in fits.values() for k in range(len(f.values))], "dims int, component int, n long, explained double, identity_error double"
    )
    each = whiten(vectors, fits).select("vec_id", "dims", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    each = each.withColumn("component", F.col("place") + 1)
    return each.join(F.broadcast(about), ["dims", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
