"""Whitening of vectors by an incremental eigendecomposition of their covariance.

Method. A partition keeps the spectrum (eigenvalues and eigenvectors) of the scatter of the rows it has read and takes in
every further row as a centred rank-one update D + rho z zᵀ. Its eigenvalues are the roots of the secular equation
1 + rho Σ z_i² / (d_i - λ) = 0, one between each two neighbours of d, after deflation of zero z_i and equal d_i; eigenvectors come from the z
that these roots belong to exactly (Gu and Eisenstat), so they stay orthogonal. Spectra of partitions are combined, some at a time, by
successive rank-one updates: one for each eigenpair of the other spectrum, one for the distance of the means. The result is an
orthonormal basis; one more distributed pass takes the covariance within that basis from exactly centred rows
(Rayleigh-Ritz), whose small eigenproblem gives the components in double precision.

A number c becomes the integer x = floor(64 c) + 1000000. Counts and sums are exact integers, rows are centred as (n x - S) / n.
Components are fitted on each distinct x vector once, copies are dropped before the shuffle; every row is then projected.

Memory: a task holds one spectrum (dims² numbers) and a slice of rows; what reaches the driver is one spectrum and the Ritz matrix,
dims² numbers each. Vectors of different lengths are fitted apart, one after the other.

Defined results: a row is dropped if its vector is null or holds a null or non-finite number; an empty vector has no components
and gives no rows; components whose eigenvalue is not above rounding (1e-12 of the trace) do not exist, so fewer distinct vectors than numbers give
fewer components and a single distinct vector none; ``x`` beyond a long is the nearest long, a deviation beyond a long the
largest long; repeated rows are returned each; a null key is kept; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, ship_package
from .common import slices

SCALE, SHIFT = 64, 1_000_000
LONG = (1 << 63) - 1
#: Rows of a task that builds a spectrum, spectra combined by a task, rows worked on at once: division of work only.
ROWS, FAN_IN, SLICE = 2048, 8, 1024
_EPS = np.finfo(float).eps


@np.errstate(all="ignore")
def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(origin, offset): root j of 1 + rho Σ z²/(d - λ) is d[origin[j]] + offset[j], in (d[j], d[j+1]), the last below d[-1] + rho |z|².

    ``d`` rises strictly and no z is 0. The nearer end of each interval is the origin, so that differences
    to poles stay accurate. Newton's step on the rational form, kept in a bracket that is halved where a step leaves it.
    """
    k, w = len(d), rho * z * z
    width = np.append(np.diff(d), w.sum())
    gaps = d[None, :] - d[:, None]                       # gaps[j, i] = d_i - d_j
    middle = gaps - width[:, None] / 2
    at_middle = 1 + (w / middle).sum(1)
    right = at_middle < 0                                # the root lies beyond the middle
    right[-1] = False
    origin = np.arange(k) + right
    pole = d[None, :] - d[origin][:, None]
    low = np.where(right, -width / 2, 0.0)
    high = np.where(right, 0.0, np.where(at_middle < 0, width, width / 2))
    low[-1] = width[-1] / 2 if at_middle[-1] < 0 else 0.0
    t = (low + high) / 2
    here = np.arange(k)
    left, ones = (here[None, :] <= here[:, None]).astype(float), np.ones(k)
    for _ in range(80):
        gap = pole - t[:, None]
        part = w / gap
        slope = part / gap
        psi, total = np.einsum("ij,ij->i", part, left), part @ ones
        psi1, total1 = np.einsum("ij,ij->i", slope, left), slope @ ones
        value = 1 + total
        low, high = np.where(value < 0, t, low), np.where(value < 0, high, t)
        # what rounding leaves of the sums, and of the offset itself
        done = np.abs(value) <= _EPS * (16 * (1 + total - 2 * psi) + 4 * np.abs(t) * total1)
        if done.all():
            break
        # psi and phi, the sums over poles on each side, written as r + s / (nearest pole - t) that match value and slope
        near, phi1 = gap[here, here], total1 - psi1
        far = np.append(gap[here[:-1], here[1:]], 0.0)
        a = value - near * psi1 - far * phi1
        b = a * (near + far) + near * near * psi1 + far * far * phi1
        c = value * near * far
        root = np.sqrt(np.maximum(b * b - 4 * a * c, 0))
        step = np.where(b > 0, 2 * c / (b + root), (b - root) / (2 * a))
        step[-1] = near[-1] + near[-1] ** 2 * psi1[-1] / a[-1]
        new = t + step
        inside = (new > low) & (new < high)
        t = np.where(done, t, np.where(inside, new, (low + high) / 2))
    return origin, t


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of V diag(values) Vᵀ + rho (V z)(V z)ᵀ, rho >= 0, eigenvalues rising."""
    norm = float(np.sqrt(z @ z))
    if not rho * norm * norm > 0:
        return values, vectors
    z, rho = z / norm, rho * norm * norm
    tol = 8 * _EPS * max(float(values[-1]), rho)
    live = rho * np.abs(z) > tol
    d, vectors = values.copy(), vectors.copy()
    # equal eigenvalues: turn their plane until one of the two has no part in z
    order = np.flatnonzero(live)
    equal = np.abs(np.diff(d[order]) * z[order[:-1]] * z[order[1:]]) <= tol * (z[order[:-1]] ** 2 + z[order[1:]] ** 2)
    for a, b in zip(order[:-1], order[1:]) if equal.any() else ():
        size = math.hypot(z[a], z[b])
        c, s = z[b] / size, z[a] / size
        if abs((d[b] - d[a]) * c * s) <= tol:
            z[a], z[b] = 0.0, size
            vectors[:, a], vectors[:, b] = c * vectors[:, a] - s * vectors[:, b], s * vectors[:, a] + c * vectors[:, b]
            d[a], d[b] = d[a] * c * c + d[b] * s * s, d[a] * s * s + d[b] * c * c
            live[a] = False
    own = np.flatnonzero(live)
    rising = own[np.argsort(d[own], kind="stable")]
    p, w = d[rising], z[rising]
    k = len(p)
    if k == 1:
        d[rising[0]] = p[0] + rho * w[0] * w[0]
    elif k:
        origin, t = secular_roots(p, w, rho)
        away = p[None, :] - p[origin][:, None] - t[:, None]     # away[j, i] = d_i - root_j
        ratio = p[:, None] - p[None, :]
        np.fill_diagonal(ratio, 1.0)
        # z whose update has exactly these roots, paired so that no product leaves the doubles
        grid = -away / ratio.T
        grid[np.arange(k), np.arange(k)] = -away[np.arange(k), np.arange(k)]
        exact = np.sqrt(np.abs(np.prod(grid, axis=0) / rho)) * np.sign(w)
        q = exact[None, :] / away
        q /= np.sqrt((q * q).sum(1))[:, None]
        vectors[:, rising] = vectors[:, rising] @ q.T
        d[rising] = p[origin] + t
    back = np.argsort(d, kind="stable")
    return d[back], vectors[:, back]


@dataclass
class Spectrum:
    """Rows seen, exact sums of their numbers, and the eigenpairs of their scatter."""

    n: int
    sums: np.ndarray       # unbounded integers
    mean: np.ndarray       # of x - SHIFT
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dims: int) -> Spectrum:
        return Spectrum(0, np.zeros(dims, object), np.zeros(dims), np.zeros(dims), np.eye(dims))

    def take(self, rows: np.ndarray) -> None:
        """Take in rows of integers one by one."""
        self.sums = self.sums + rows.astype(object).sum(0)
        for x in (rows - SHIFT).astype(np.float64):
            gap = x - self.mean
            self.n += 1
            self.mean = self.mean + gap / self.n
            if self.n > 1:
                self.values, self.vectors = rank_one(self.values, self.vectors, self.vectors.T @ gap, (self.n - 1) / self.n)

    def join(self, other: Spectrum) -> None:
        """Take in another spectrum: its eigenpairs, then the distance of the means, by rank-one updates."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, self.vectors.T @ vector, float(value))
        gap, both = other.mean - self.mean, self.n + other.n
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, self.vectors.T @ gap, self.n * other.n / both)
        self.mean = self.mean + gap * (other.n / both)
        self.n, self.sums = both, self.sums + other.sums

    def row(self, no: int) -> dict:
        return {"no": no, "n": self.n, "sums": " ".join(map(str, self.sums)), "mean": self.mean.tobytes(), "spectrum_values": self.values.tobytes(),
                "spectrum_vectors": np.ascontiguousarray(self.vectors).tobytes()}

    @staticmethod
    def of(row: dict) -> Spectrum:
        values = np.frombuffer(row["spectrum_values"])
        return Spectrum(row["n"], np.array([int(s) for s in row["sums"].split()], object), np.frombuffer(row["mean"]), values,
                        np.frombuffer(row["spectrum_vectors"]).reshape(len(values), -1))


_SPECTRUM = "no long, n long, sums string, mean binary, spectrum_values binary, spectrum_vectors binary"
_ARROW = pa.schema([("no", pa.int64()), ("n", pa.int64()), ("sums", pa.string()), ("mean", pa.binary()), ("spectrum_values", pa.binary()),
                    ("spectrum_vectors", pa.binary())])


def integers(vector: str) -> F.Column:
    """x of every number of a vector."""
    def one(c):
        v = F.floor(c.cast("double") * SCALE)
        big = F.lit(float(1 << 62))
        return F.when(v.cast("double").between(-big, big), v + SHIFT).otherwise(
            F.when(c > 0, F.lit(LONG)).otherwise(F.lit(-LONG - 1)))

    return F.transform(vector, one)


def remaining(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the rows that are not dropped."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < math.inf))
    return vectors.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(key).alias("key"), integers(vector).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact; int64 where it fits."""
    largest = max(int(np.abs(rows).max(initial=0)), 1)
    if n * largest < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return rows * n - sums.astype(np.int64)
    return rows.astype(object) * n - sums


def combined(parts: DataFrame, tasks: int, merge: Callable[[list[dict]], dict], schema: str, arrow: pa.Schema) -> list[dict]:
    """All rows of ``parts(no, …)`` merged into one, ``FAN_IN`` at a time; at most one row comes back."""

    def some(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([merge(table.to_pylist())], arrow)

    while tasks > 1:
        parts = parts.groupBy(F.expr(f"no div {FAN_IN}")).applyInArrow(some, schema)
        tasks = -(-tasks // FAN_IN)
    return [r.asDict() for r in parts.collect()]


def spectrum(fit: DataFrame, dims: int, tasks: int) -> Spectrum | None:
    """The spectrum of all rows of ``fit(x)``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = Spectrum.empty(dims)
        for part in slices(batches, SLICE):
            held.take(matrix(part.column(0), dims))
        if held.n:
            yield pa.RecordBatch.from_pylist([held.row(TaskContext.get().partitionId())], _ARROW)

    def merge(rows: list[dict]) -> dict:
        rows = sorted(rows, key=lambda r: r["no"])
        held = Spectrum.of(rows[0])
        for r in rows[1:]:
            held.join(Spectrum.of(r))
        return held.row(rows[0]["no"] // FAN_IN)

    parts = combined(cut(fit.mapInArrow(build, _SPECTRUM)), tasks, merge, _SPECTRUM, _ARROW)
    return Spectrum.of(parts[0]) if parts else None


def projected_scatter(fit: DataFrame, basis: np.ndarray, n: int, sums: np.ndarray, tasks: int) -> np.ndarray:
    """Bᵀ V B of the covariance V of ``fit(x)``, from exactly centred rows."""
    dims, width = basis.shape
    schema, arrow = "no long, part binary", pa.schema([("no", pa.int64()), ("part", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((width, width))
        for part in slices(batches, SLICE):
            y = (centred(matrix(part.column(0), dims), n, sums) / n).astype(np.float64) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_pylist([{"no": TaskContext.get().partitionId(), "part": total.tobytes()}], arrow)

    def merge(rows: list[dict]) -> dict:
        rows = sorted(rows, key=lambda r: r["no"])
        return {"no": rows[0]["no"] // FAN_IN, "part": sum(np.frombuffer(r["part"]) for r in rows).tobytes()}

    parts = combined(cut(fit.mapInArrow(build, schema)), tasks, merge, schema, arrow)
    return np.frombuffer(parts[0]["part"]).reshape(width, width) / n


@dataclass
class Whitening:
    """A fitted whitening: count and sums of the fit list, components as columns by falling eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(fit: DataFrame, n: int, dims: int, most: int) -> Whitening:
    """Components of ``fit(x)``, whose ``n`` rows are distinct and of length ``dims``."""
    tasks = max(1, -(-n // ROWS))
    dealt = cut(fit.repartition(tasks))
    tasks = max(tasks, dealt.rdd.getNumPartitions())
    held = spectrum(dealt, dims, tasks)
    basis, _ = np.linalg.qr(held.vectors)
    ritz = projected_scatter(dealt, basis, held.n, held.sums, tasks)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    trace = float(np.trace(ritz))
    kept = [i for i in np.argsort(-values, kind="stable")[:most] if values[i] > 1e-12 * trace]
    components, values = basis @ turn[:, kept], values[kept]
    error = 0.0
    if kept:
        own = projected_scatter(dealt, components / np.sqrt(values), held.n, held.sums, tasks)
        error = float(np.abs(own - np.eye(len(kept))).max())
    return Whitening(held.n, held.sums, components, values, trace, error)


def project(rows: DataFrame, dims: int, w: Whitening) -> DataFrame:
    """(key, deviation as text, whitened array) of ``rows(key, x)`` of length ``dims``."""
    scaled = w.components / np.sqrt(w.values)
    kind = rows.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            gap = centred(matrix(part.column(1), dims), w.n, w.sums)
            y = (gap / w.n).astype(np.float64) @ scaled
            if gap.dtype != object and int(np.abs(gap).max(initial=0)) ** 2 * dims > LONG:
                gap = gap.astype(object)
            deviation = (gap * gap).sum(1).tolist()
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([str(d) for d in deviation]),
                                              pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["key", "deviation", "whitened"])

    return rows.where(F.size("x") == dims).select("key", "x").mapInArrow(work, f"key {kind}, deviation string, whitened array<double>")


def whitened(vectors: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every remaining row and component."""
    ship_package(vectors.sparkSession)
    rows = remaining(vectors, key, vector)
    fit = cut(rows.where(F.size("x") > 0).select("x").distinct())
    result = rows.where("false").select(
        F.col("key").alias(key), F.lit(1).alias("component"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("deviation"),
        F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    for dims, n in sorted(map(tuple, fit.groupBy(F.size("x")).agg(F.count(F.lit(1))).collect())):
        w = fit_whitening(fit.where(F.size("x") == dims), n, dims, most)
        if not len(w.values):
            continue
        explained = F.array(*[F.lit(float(v / w.trace)) for v in w.values])
        result = result.unionByName(project(rows, dims, w).select(
            F.col("key").alias(key), F.lit(w.n).cast("long").alias("n"),
            F.coalesce(F.expr("try_cast(deviation as bigint)"), F.lit(LONG)).alias("deviation"),
            F.posexplode("whitened").alias("at", "whitened")).select(
            key, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
            F.lit(w.identity_error).alias("identity_error")))
    return result
