"""What the operators of this subpackage share: word pattern, table reading, row slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut

#: A word is a run of anything but blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column) -> Column:
    """All words of a text in order; null gives an empty list."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words as long; null gives 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits spread over all 64."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _FACTOR
    return x ^ (x >> np.uint64(32))


def pack(numbers: np.ndarray) -> bytes:
    """Numbers ≥ 0, byte by byte of their rank, compressed."""
    raw = np.ascontiguousarray(numbers, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``rows``, so that a task holds the work of few texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Most rows (of at most a few numbers each) of a side that is sent whole to every executor.
SMALL_ROWS = 500_000


def small_side(side: DataFrame, rows: int) -> DataFrame:
    """A join's narrow side of a counted size: broadcast up to a bound, left to a shuffle join beyond it."""
    return F.broadcast(side) if rows <= SMALL_ROWS else side


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected edges (a, b): label is the smallest node reachable.

    Alternating stars: every node's larger neighbours, then its smaller ones, are hung onto the least node it
    knows; both steps are sums over map-side minima and joins, so a hub is no single group. The number of
    rounds grows with the logarithm of the longest chain.
    """
    now, seen = cut(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), **_state())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        then, after = cut(small.select("e.*").where("a <> b").distinct(), **_state())
        if after == seen:
            break
        now, seen = then, after
    return then.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        then.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _state() -> dict[str, Column]:
    return {"edges": F.count(F.lit(1)), "mark": F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))}
