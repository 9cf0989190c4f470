"""Exact nearest neighbours of binary codes in Hamming distance, by incremental multi-index hashing.

Method. A code is cut into segments of 16 bits, and every segment is an index: (segment, value) → codes. Round r
looks up, for each open query and segment, all values at distance r from the query's own. After it, every
code within segments*(r+1)-1 bits has been met, as some segment of it differs in r bits or less. Codes met are verified by their
full distance; a query is closed when its kth verified distance is covered so, and only open queries go on to the
next radius. A code counts where it is met first (the least radius, then the first segment), so nothing
is met twice, and the join lets through only what can still enter a query's best.

Rows with equal codes are one code with its k+1 smallest keys, found with a salt first, so copies are no hot
group; queries with equal codes are searched once. Rounds are joins on (segment, value); best lists are
written between rounds. The last radius covers all codes, so the result is exact whatever the data.

Codes come from vectors by the signs of their numbers (positive is 1). Defined results: a null vector is not in the
index and finds nothing; null, missing or NaN numbers are 0 bits; a null key is in the index with rank
last among equal distances and is no query; a query never finds the row with its own key; ties go to the smaller
key; repeated rows are neighbours each; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

BITS, SALTS = 16, 64


def sign_codes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, code array<int>) of every row with a vector, and the number of segments (from the longest vector)."""
    longest = vectors.agg(F.max(F.size(vector))).first()[0] or 1
    segments = max(1, -(-max(longest, 1) // BITS))
    bit = lambda i, j: F.when(F.coalesce(F.get(vector, i * BITS + j), F.lit(0)).between(1e-300, 1e300), 1).otherwise(0)
    code = F.transform(
        F.sequence(F.lit(0), F.lit(segments - 1)),
        lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0), lambda a, j: a * 2 + bit(i, j)))
    return vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), code.alias("code")), segments


def _ranked(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(
        F.col("_rank") <= most).drop("_rank")


def nearest(codes: DataFrame, queries: DataFrame, segments: int, k: int) -> DataFrame:
    """(query, rank, key, distance): the k nearest rows of ``codes`` for every row of ``queries``; both (key, code)."""
    most = k + 1
    last = F.col("key").asc_nulls_last()
    few = _ranked(codes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))), ["code", "salt"], [last], most)
    index, seen = cut(
        _ranked(few, ["code"], [last], most).groupBy("code").agg(F.collect_list(F.struct("key")).alias("keys")),
        rows=F.coalesce(F.sum(F.size("keys")), F.lit(0)))
    enough = min(most, seen["rows"])
    open_, state = cut(queries.where("key IS NOT NULL").select(F.col("code").alias("query")).distinct().withColumn(
        "limit", F.lit(BITS * segments)), rows=F.count(F.lit(1)))
    entries = index.select("code", "keys", F.posexplode("code").alias("segment", "value"))
    best, radius, tasks = None, 0, int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while state["rows"] and radius <= BITS:
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda x: F.bit_count(x) == radius)
        probes = (
            open_.repartition(tasks, "query")
            .select("query", "limit", F.posexplode("query").alias("segment", "own"))
            .select("query", "limit", "segment", "own", F.explode(masks).alias("mask"))
            .select("query", "limit", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value")))
        apart = [F.bit_count(F.col("query")[i].bitwiseXOR(F.col("code")[i])) for i in range(segments)]
        distance = reduce(lambda a, b: a + b, apart)
        at = F.col("p.segment")
        first = reduce(lambda a, b: a & b, [
            F.when(at > i, d > radius).when(at < i, d >= radius).otherwise(True) for i, d in enumerate(apart)])
        # probes are many times the open queries they are made from, so neither side is one to broadcast
        met = probes.alias("p").hint("merge").join(
            entries.alias("e"), (F.col("p.segment") == F.col("e.segment")) & (F.col("p.value") == F.col("e.value"))
            & (distance <= F.col("limit")) & first).select("query", distance.alias("distance"), F.explode("keys").alias("k"))
        met = met.select("query", F.col("k.key").alias("key"), "distance")
        best = cut(_ranked(met if best is None else best.unionByName(met), ["query"], [F.col("distance"), last], most))
        covered = segments * (radius + 1) - 1
        reach = best.groupBy("query").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
        open_, state = cut(
            open_.select("query").join(reach, "query", "left")
            .where(F.coalesce(F.col("n") < enough, F.lit(True)) | (F.col("far") > covered))
            .select("query", F.when(F.col("n") >= enough, F.col("far")).otherwise(BITS * segments).alias("limit")),
            rows=F.count(F.lit(1)))
        radius += 1
    if best is None:
        best = codes.where("false").select(F.col("code").alias("query"), "key", F.lit(0).alias("distance"))
    asked = queries.where("key IS NOT NULL").select(F.col("key").alias("asked"), F.col("code").alias("query"))
    found = asked.join(best, "query").where(~F.col("asked").eqNullSafe(F.col("key")))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", last))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("asked").alias("query"), "rank", "key", F.col("distance").cast("int").alias("distance"))


def nearest_by_sign(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows, by the signs of their vectors, of every row whose key is divisible by ``every``."""
    coded, segments = sign_codes(vectors, key, vector)
    coded = cut(coded)
    asked = coded.where(F.col("key") % every == 0)
    return nearest(coded, asked, segments, k).select(
        F.col("query").alias(f"query_{key}"), "rank", F.col("key").alias(key), "distance")
