"""Exact nearest neighbours by cosine, as a block matrix join of quantised vectors.

Method. Queries and candidates are dealt by hash into blocks, and every pair of a query block and a candidate block is a
tile, one group of a cogrouped shuffle. In a tile each unit vector u is written as s*q + r, with q of int8 numbers, s its own scale
and |r| measured. The product of two int8 matrices is exact (its sums stay below 2^24, so a float32 product keeps them whole), and

    | u·v - s_u s_v q_u·q_v |  <=  |s_u q_u| |r_v| + |r_u| |s_v q_v| + |r_u| |r_v|

bounds every cosine from both sides. A candidate whose upper bound is below the kth lower bound of the tile's slice, or below
the kth score found so far, cannot be among the nearest; all others are recomputed in double precision from the original numbers and
offered to the query's heap of k+1. So a tile gives at most k+1 rows a query, whatever lies near it, and heaps are merged by rank.

Rows with equal vectors are one candidate with its k+1 smallest keys, and queries with equal vectors are searched once, so copies are no
hot group. Blocks have a bounded number of rows; their number grows with the rows.

The score is dot / sqrt(|a|^2 * |b|^2), each sum taken from the first number to the last, in double precision; vectors are first
scaled by powers of two, which changes no bit of it but keeps squares from overflowing. Equal vectors score 1 exactly.

Defined results: a vector that is null, empty or zero, or that holds a null or non-finite number, takes no part; vectors of different
lengths are not compared; a query is every such row whose key is divisible by ``every``, and it finds every row but itself, so a further
row with its key is a neighbour; repeated rows are neighbours each; ties go to the smaller key, a null key last; fewer
candidates than k give fewer rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, ship_package

#: Numbers of a block, and rows of a slice of it that is multiplied at once: division of work only.
BLOCK, QUERY_SLICE, CANDIDATE_SLICE = 1 << 22, 256, 8192
#: Fewest candidates of a block while there are fewer blocks than tasks; pairs recomputed at once; salts of a query's copies.
LEAST_BLOCK, PAIRS, SALTS = 2048, 1 << 18, 32
#: Numbers of two int8 vectors whose product sum stays below 2^24.
EXACT_DIMS = (1 << 24) // (127 * 127)
_NULL_KEY = np.iinfo(np.int64).max


class Side:
    """The vectors of one side of a tile: scaled originals, and their int8 form with its error."""

    def __init__(self, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        self.x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
        self.squares = ordered_sum(self.x * self.x)
        unit = self.x / np.sqrt(self.squares)[:, None]
        self.scale = np.abs(unit).max(1) / 127
        whole = np.rint(unit / self.scale[:, None])
        self.codes = whole.astype(np.int8)
        written = whole * self.scale[:, None]
        self.length = np.sqrt((written * written).sum(1)) * (1 + 1e-12)
        self.error = np.sqrt(((unit - written) ** 2).sum(1)) * (1 + 1e-12) + 1e-14


def ordered_sum(terms: np.ndarray) -> np.ndarray:
    """Sum of each row, from its first number to its last."""
    total = np.zeros(len(terms))
    for column in terms.T:
        total = total + column
    return total


def scores(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (a[i], b[j]) in double precision."""
    out = np.empty(len(i))
    for start in range(0, len(i), PAIRS):
        at = slice(start, start + PAIRS)
        dot = ordered_sum(a.x[i[at]] * b.x[j[at]])
        out[at] = dot / np.sqrt(a.squares[i[at]] * b.squares[j[at]])
    return np.clip(out, -1.0, 1.0)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a · bᵀ of int8 matrices, exact."""
    out = a[:, :EXACT_DIMS].astype(np.float32) @ b[:, :EXACT_DIMS].astype(np.float32).T
    for start in range(EXACT_DIMS, a.shape[1], EXACT_DIMS):
        part = slice(start, start + EXACT_DIMS)
        out = out.astype(np.float64) + a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return out


def tile(queries: np.ndarray, candidates: np.ndarray, order: list[tuple[int, int]], most: int) -> list[list[tuple[float, int]]]:
    """Of every query, its ``most`` best (score, candidate position), ties by the candidates' ``order``."""
    a, b = Side(queries), Side(candidates)
    heaps: list[list[tuple]] = [[] for _ in range(len(queries))]
    floor = np.full(len(queries), -np.inf)
    for c in range(0, len(candidates), CANDIDATE_SLICE):
        cs = slice(c, min(c + CANDIDATE_SLICE, len(candidates)))
        for q in range(0, len(queries), QUERY_SLICE):
            qs = slice(q, min(q + QUERY_SLICE, len(queries)))
            about = int8_product(a.codes[qs], b.codes[cs]) * np.outer(a.scale[qs], b.scale[cs])
            slack = (np.outer(a.length[qs] + a.error[qs], b.error[cs]) + np.outer(a.error[qs], b.length[cs])) + 1e-12
            lower = about - slack
            bar = floor[qs]
            if lower.shape[1] >= most:
                bar = np.maximum(bar, np.partition(lower, -most, axis=1)[:, -most])
            i, j = np.nonzero(about + slack >= bar[:, None])
            i, j = i + q, j + c
            found = scores(a, i, b, j)
            if len(i) > 4 * most * lower.shape[0]:
                # many near vectors: only a query's best of the slice go on to its heap
                exact = np.full(lower.shape, -np.inf)
                exact[i - q, j - c] = found
                bar = np.partition(exact, -most, axis=1)[:, -most] if lower.shape[1] >= most else bar
                kept = found >= np.maximum(bar, floor[qs])[i - q]
                i, j, found = i[kept], j[kept], found[kept]
            for x, y, score in zip(i.tolist(), j.tolist(), found.tolist()):
                heap = heaps[x]
                key, row = order[y]
                entry = (score, -key, -row, y)
                if len(heap) < most:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            for x in np.unique(i).tolist():
                if len(heaps[x]) == most:
                    floor[x] = heaps[x][0][0]
    return [[(score, y) for score, _, _, y in heap] for heap in heaps]


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The lists of a column, all of one length, as a matrix."""
    return np.concatenate([np.asarray(part.flatten()) for part in column.chunks]).reshape(-1, dims)


def taking_part(vector: str) -> Column:
    """A vector that is neither null, empty nor zero, of finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(
        vector, lambda x: x != 0)


def _first(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with their rank; each partition drops what cannot be among them before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, rank, key, score): the k nearest other rows of every row whose key is divisible by ``every``."""
    spark, most = vectors.sparkSession, k + 1
    ship_package(spark)
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    clean = cut(vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
                .where(taking_part("vector")).withColumn("row_no", F.monotonically_increasing_id()))
    by_key = [F.col("key").asc_nulls_last(), F.col("row_no")]
    items = _first(clean, ["vector"], by_key, most).groupBy("vector").agg(
        F.sort_array(F.collect_list(F.struct("rank", "key", "row_no"))).alias("rows"))
    items, seen = cut(items.select("vector", "rows", F.size("vector").alias("dims"), F.monotonically_increasing_id().alias("item")),
                      n=F.count(F.lit(1)), dims=F.max("dims"))
    asked = clean.where(F.col("key") % every == 0)
    asking, asks = cut(asked.select("vector").distinct().join(
        items.select("vector", "item", "dims"), "vector"), n=F.count(F.lit(1)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = max(LEAST_BLOCK, BLOCK // (seen["dims"] or 1))
    candidate_blocks = max(-(-seen["n"] // block), min(tasks, -(-seen["n"] // LEAST_BLOCK)), 1)
    query_blocks = max(-(-asks["n"] // block), 1)

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("item"), F.lit(blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))))

    q = dealt(asking.select("item", "dims", "vector"), "qb", query_blocks, "cb", candidate_blocks)
    c = dealt(items.select("item", "dims", "vector", F.col("rows")[0]["key"].alias("key"), F.col("rows")[0]["row_no"].alias("row_no")),
              "cb", candidate_blocks, "qb", query_blocks)

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and candidates.num_rows:
            dims = queries["dims"][0].as_py()
            keys = candidates["key"].fill_null(_NULL_KEY).to_pylist()
            order = list(zip(keys, candidates["row_no"].to_pylist()))
            items_, asked_ = candidates["item"].to_pylist(), queries["item"].to_pylist()
            best = tile(matrix(queries["vector"], dims), matrix(candidates["vector"], dims), order, most)
            for no, heap in zip(asked_, best):
                for score, y in heap:
                    for column, value in zip(out, (no, items_[y], score)):
                        column.append(value)
        return pa.table({"asker": pa.array(out[0], pa.int64()), "item": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    by = ["dims", "qb", "cb"]
    met = cut(q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(meet, "asker long, item long, score double"))
    rows = met.join(items.select("item", F.explode("rows").alias("r")), "item").select("asker", "score", "r.key", "r.row_no")
    best = _first(rows, ["asker"], [F.col("score").desc(), *by_key], most).groupBy("asker").agg(
        F.sort_array(F.collect_list(F.struct("rank", "key", "row_no", "score"))).alias("near"))
    # a query vector has a row per salt of its copies, so that the copies of one vector are spread
    copies = asking.select("vector", F.col("item").alias("asker")).join(best, "asker").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    others = F.slice(F.filter("near", lambda x: x["row_no"] != F.col("row_no")), 1, k)
    return asked.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int")).join(copies, ["vector", "salt"]).select(
        F.col("key").alias("query"), F.posexplode(others).alias("at", "x")).select(
        "query", (F.col("at") + 1).alias("rank"), F.col("x.key").alias("key"), F.col("x.score").alias("score"))


def nearest_by_cosine(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    return nearest(vectors, k, every).select(
        F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")
