"""Exact k-means in integers, by Shallot search.

Method. Every vector carries its centroid a, its second-nearest centroid b, an upper bound u of its distance to a and a lower
bound l of its distance to all others. After the centroids have moved, u grows by a's move and l shrinks by the largest
move of the others. Where u stays below l, or below half the distance from a to its next centroid, a is still the nearest. Else the
distances to a and b are computed, and the search starts from the closer one: its neighbours come in the order of their distance
from it, and a centroid beyond (distance to the start + distance to the second best so far) can be neither of the two nearest; that
ball shrinks whenever a better second is found. What is left inside it is compared in integers.

Bounds are doubles with a margin; they only save work. Every decision, ties included, is made on exact integers, and centroids are
exact floors of exact sums. A vector's numbers are floor(64 * x); a partition's numbers that leave 27 bits are handled as unbounded
integers, so any finite vector is clustered exactly.

A round is one pass over a written table of the vectors' numbers and bounds; it gives, beside the vectors, one row of sums for each
task and centroid. Only these sums are brought together, in steps, and the centroids (at most ``k`` vectors) go through the driver.

Defined results: a vector that is null, has not exactly ``dims`` numbers or holds a null or non-finite one is left out; centroids start as
the kept rows with the smallest sha256 of "1:<key>" (a null key last; equal keys by their numbers), fewer of them if fewer rows are
kept; repeated rows count each, and equal starts leave the later centroid empty, where it stays; distances and sums beyond a long are given
as the largest long; no kept row gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, delete_tables, recorded_tables, ship_package
from .common import slices

#: Rows worked on at once: division of work only.
ROWS = 4096
LONG = (1 << 63) - 1
#: Margin by which bounds must differ to save an exact comparison.
MARGIN = 1e-9


def small(dims: int) -> int:
    """Numbers below this size have squared distances of less than 62 bits."""
    return math.isqrt((1 << 62) // max(dims, 1)) // 2


def whole(values: np.ndarray) -> np.ndarray:
    """floor(64 * x) of doubles: int64 where all are small, else unbounded integers."""
    x = values.astype(np.float64)
    if not x.size or np.abs(x).max() < small(x.shape[1]) / 64 - 1:
        return np.floor(x * 64).astype(np.int64)
    # 64 x can leave the doubles; x is an integer long before
    return np.array([[math.floor(v * 64) if abs(v) < 2.0 ** 53 else int(v) * 64 for v in row] for row in x.tolist()], object)


def packed(numbers: np.ndarray) -> list[bytes]:
    """One cell per row: numbers of the least common width, or as text if they are unbounded."""
    if numbers.dtype == object:
        return [b"t" + " ".join(map(str, row)).encode() for row in numbers]
    most = int(np.abs(numbers).max(initial=0))
    kind = "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4"
    return [kind[-1].encode() + row.tobytes() for row in numbers.astype(kind)]


def unpacked(cells: list[bytes], dims: int) -> np.ndarray:
    if not cells:
        return np.zeros((0, dims), np.int64)
    if any(cell[:1] == b"t" for cell in cells):
        return np.array([[int(v) for v in cell[1:].split()] if cell[:1] == b"t"
                         else np.frombuffer(cell[1:], f"<i{cell[:1].decode()}").tolist() for cell in cells], object)
    out = np.empty((len(cells), dims), np.int64)
    for i, cell in enumerate(cells):
        out[i] = np.frombuffer(cell, f"<i{cell[:1].decode()}", offset=1)
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    gap = a - b
    return (gap * gap).sum(-1)


def rooted(squares: np.ndarray) -> np.ndarray:
    """Distances; those beyond a double are infinite, which no bound can use."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([math.sqrt(s) if s < 1 << 1000 else math.inf for s in squares.ravel()]).reshape(squares.shape)


@dataclass
class Centroids:
    """k centroids, what they moved by, and each one's neighbours in the order of distance."""

    at: np.ndarray
    moved: np.ndarray | None = None

    def __post_init__(self) -> None:
        k = len(self.at)
        apart = rooted(squared(np.repeat(self.at, k, 0), np.tile(self.at, (k, 1)))).reshape(k, k)
        self.apart = apart
        self.order = np.array([[j for j in np.lexsort((np.arange(k), apart[i])) if j != i] for i in range(k)], int).reshape(k, k - 1)
        self.half = np.array([apart[i, self.order[i, 0]] / 2 if k > 1 else math.inf for i in range(k)])

    def after(self, new: np.ndarray) -> Centroids:
        return Centroids(new, rooted(squared(new, self.at)))


def closer(da, a, db, b):
    """Where centroid a at squared distance da comes before b at db."""
    return (da < db) | ((da == db) & (a < b))


def assign(x: np.ndarray, c: Centroids, state: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, ...]:
    """(nearest, second, upper, lower) of every row of ``x``, from those of the round before."""
    n, k = len(x), len(c.at)
    if k == 1:
        return np.zeros(n, int), np.zeros(n, int), np.zeros(n), np.full(n, math.inf)
    if state is None:
        a, b, u, low = np.zeros(n, int), np.ones(n, int), np.full(n, math.inf), np.zeros(n)
    else:
        a, b, u, low = (s.copy() for s in state)
        if c.moved is not None:
            others = np.array([np.delete(c.moved, i).max() for i in range(k)])
            u = u + c.moved[a] * (1 + MARGIN)
            low = low - others[a] * (1 + MARGIN)

    def safe(rows):
        return u[rows] * (1 + MARGIN) + MARGIN < np.maximum(low[rows], c.half[a[rows]])

    open_ = np.flatnonzero(~safe(np.arange(n)))
    da = squared(x[open_], c.at[a[open_]])
    u[open_] = rooted(da)
    still = ~safe(open_)
    open_, da = open_[still], da[still]
    db = squared(x[open_], c.at[b[open_]])
    swap = ~closer(da, a[open_], db, b[open_])
    a[open_[swap]], b[open_[swap]] = b[open_[swap]], a[open_[swap]]
    da[swap], db[swap] = db[swap], da[swap]
    start, began = a[open_].copy(), rooted(da)
    for s in range(k):
        rows = np.flatnonzero(start == s)
        for j in c.order[s]:
            if not len(rows):
                break
            # the ball: a second-best distance that shrinks as better seconds are found
            reach = (began[rows] + rooted(db[rows])) * (1 + MARGIN) + MARGIN
            rows = rows[c.apart[s, j] <= reach]
            at = open_[rows]
            ask = rows[(a[at] != j) & (b[at] != j)]
            if not len(ask):
                continue
            at, d = open_[ask], squared(x[open_[ask]], c.at[j])
            first = closer(d, j, da[ask], a[at])
            second = ~first & closer(d, j, db[ask], b[at])
            b[at[first]], db[ask[first]] = a[at[first]], da[ask[first]]
            a[at[first]], da[ask[first]] = j, d[first]
            b[at[second]], db[ask[second]] = j, d[second]
    u[open_], low[open_] = rooted(da), rooted(db)
    return a, b, u, low


def _add(totals: dict[int, tuple], x: np.ndarray, a: np.ndarray, d: np.ndarray) -> None:
    """Add a batch to cluster → (rows, sums, inertia), in unbounded integers."""
    for j in np.unique(a).tolist():
        own = a == j
        rows, sums, inertia = totals.get(j, (0, 0, 0))
        totals[j] = (rows + int(own.sum()), sums + x[own].sum(0).astype(object), inertia + sum(d[own].tolist()))


def _pass(table: DataFrame, dims: int, centroids: Centroids, first: bool) -> DataFrame:
    """One round: every row with its new state, and rows of partial sums (kind 1)."""
    fields = ("kind int, key long, numbers binary, cluster int, second int, upper double, lower double, distance string, "
              "rows long, sums string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple] = {}
        for part in slices(batches, ROWS):
            if first:
                x = whole(np.asarray(part.column(1).flatten()).reshape(-1, dims))
                cells, state = packed(x), None
            else:
                cells = part.column(1).to_pylist()
                x = unpacked(cells, dims)
                state = tuple(np.asarray(part.column(i)) for i in range(2, 6))
            a, b, u, low = assign(x, centroids, state)
            d = squared(x, centroids.at[a])
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), part.column(0), pa.array(cells, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                 pa.array(u), pa.array(low), pa.array(list(map(str, d.tolist())), pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())],
                names)
            _add(totals, x, a, d)
        m = len(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(totals, pa.int32()),
             pa.nulls(m, pa.int32()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()),
             pa.array([str(t[2]) for t in totals.values()], pa.string()), pa.array([t[0] for t in totals.values()], pa.int64()),
             pa.array([" ".join(map(str, t[1])) for t in totals.values()], pa.string())], names)

    names = [f.split()[0] for f in fields.split(", ")]
    return cut(table.mapInArrow(work, fields))


def _totals(done: DataFrame, fan_in: int = 256) -> dict[int, tuple[int, list[int], int]]:
    """cluster → (rows, sums, inertia), by sums of partial sums."""

    def added(part: pa.Table) -> pa.Table:
        sums = [sum(column) for column in zip(*(map(int, s.split()) for s in part["sums"].to_pylist()))]
        return pa.table({"cluster": part["cluster"].slice(0, 1), "rows": pa.array([sum(part["rows"].to_pylist())], pa.int64()),
                         "sums": pa.array([" ".join(map(str, sums))]), "distance": pa.array([str(sum(map(int, part["distance"].to_pylist())))])})

    parts = done.where("kind = 1").select("cluster", "rows", "sums", "distance", F.monotonically_increasing_id().alias("no"))
    schema = "cluster int, rows long, sums string, distance string"
    some = parts.groupBy("cluster", F.pmod(F.xxhash64("no"), F.lit(fan_in))).applyInArrow(added, schema)
    one = some.groupBy("cluster").applyInArrow(added, schema)
    return {r["cluster"]: (r["rows"], [int(s) for s in r["sums"].split()], int(r["distance"])) for r in one.collect()}


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, key: str = "vec_id",
            vector: str = "embedding") -> tuple[DataFrame, list[list[int]], dict[int, tuple[int, list[int], int]]]:
    """(key, cluster, distance as text) of every kept row, the final centroids, and cluster → (rows, sums, inertia)."""
    ship_package(vectors.sparkSession)
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    kept = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("x")).where(
        (F.size("x") == dims) & F.coalesce(finite, F.lit(False)))
    mark = F.sha2(F.concat(F.lit("1:"), F.col("key").cast("string")), 256)
    starts = kept.select(mark.alias("mark"), "x").orderBy(F.col("mark").asc_nulls_last(), "x").limit(k).collect()
    if not starts:
        return kept.select("key", F.lit(0).alias("cluster"), F.lit("0").alias("distance")), [], {}
    centroids = Centroids(whole(np.array([r["x"] for r in starts])))
    with recorded_tables() as made:
        done = _pass(kept, dims, centroids, True)
        for _ in range(rounds):
            totals = _totals(done)
            new = [[s // totals[j][0] for s in totals[j][1]] if j in totals else centroids.at[j].tolist()
                   for j in range(len(centroids.at))]
            centroids = centroids.after(_array(new))
            before, done = made[:], _pass(
                done.where("kind = 0").select("key", "numbers", "cluster", "second", "upper", "lower"), dims, centroids, False)
            delete_tables(vectors.sparkSession, before)
    return done.where("kind = 0").select("key", "cluster", "distance"), centroids.at.tolist(), _totals(done)


def _array(rows: list[list[int]]) -> np.ndarray:
    bound = small(len(rows[0]))
    return np.array(rows, np.int64 if all(abs(v) < bound for row in rows for v in row) else object)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark: SparkSession = vectors.sparkSession
    found, at, totals = cluster(vectors, k, rounds)
    inertia = min(sum(t[2] for t in totals.values()), LONG)
    rows = [(j, min(totals[j][2], LONG), inertia, hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for j in totals]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return found.join(F.broadcast(of_cluster), "cluster").select(
        F.col("key").alias("vec_id"), "cluster", F.coalesce(F.expr("try_cast(distance as bigint)"), F.lit(LONG)).alias("distance"),
        "cluster_inertia", "inertia", "centroid_sha256")
