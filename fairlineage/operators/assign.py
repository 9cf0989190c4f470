"""Owner assignment: who owns a copy of which record, drawn reproducibly by hashing.

Every draw is a number in [0, 1) made from md5 of (seed, what, key, …), so a rerun, a retry of a
lost task and another engine all draw the same.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.registry import ASSIGNED_TABLES
from ..session import cut


@dataclass(frozen=True)
class AssignmentConfig:
    """The defaults of the generator."""

    owners: int = 500
    alpha: float = 3.0
    max_copy: int = 4
    beta: float = 3.0
    owners_of_small_table: int = 5
    owners_of_basic_table: int = 10
    timeout: int = 7200
    sample_size: int = 1000
    small_tables: tuple[str, ...] = ("region", "nation")
    largest_table: str = "lineitem"
    equal_owners: bool = True
    equal_records: bool = True
    seed: int = 0

    def owners_of(self, table: str) -> int:
        """How many owners a table has: all but for small tables in equal mode; in unequal mode all
        for the largest table only."""
        if table in self.small_tables:
            n = self.owners_of_small_table
        elif self.equal_owners or table == self.largest_table:
            n = self.owners
        else:
            n = self.owners_of_basic_table
        return min(n, self.owners)


def tables_of(dataset: str) -> tuple[str, ...]:
    return ASSIGNED_TABLES[dataset]


def draw(seed: int, what: str, *key: Column) -> Column:
    """Uniform number in [0, 1) with 52 random bits."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(what), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _beside_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def zipf_weights(places: DataFrame, a: float) -> DataFrame:
    """(i, weight) for ``places(i)``, i from 1: weights ∝ 1/i^a that sum to 1."""
    raw = places.select("i", F.pow(F.col("i").cast("double"), F.lit(-float(a))).alias("_w"))
    return _beside_one(raw, raw.agg(F.sum("_w").alias("_total"))).select("i", (F.col("_w") / F.col("_total")).alias("weight"))


def copy_buckets(records: DataFrame, owners: int, max_copy: int, alpha: float) -> DataFrame:
    """(copies, records, first, last): record numbers [first, last) get so many copies.

    Shares are Zipf over 1..min(owners, max_copy), rounded down; the remainder goes to one copy.
    The result has one row per number of copies.
    """
    spark = records.sparkSession
    total = records.agg(F.count(F.lit(1)).alias("_n"))
    shares = _beside_one(zipf_weights(spark.range(1, min(owners, max_copy) + 1).withColumnRenamed("id", "i"), alpha), total)
    floor = shares.select(F.col("i").alias("copies"), "_n",
                          F.floor(F.col("weight") * F.col("_n")).cast("bigint").alias("_r"))
    used = floor.agg(F.sum("_r").alias("_used"))
    filled = _beside_one(floor, used).select("copies", F.when(
        F.col("copies") == 1, F.col("_r") + F.col("_n") - F.col("_used")).otherwise(F.col("_r")).alias("records"))
    return filled.withColumn("last", F.expr(
        "sum(records) over (order by copies rows between unbounded preceding and current row)")).select(
        "copies", "records", (F.col("last") - F.col("records")).alias("first"), "last")


def with_copies(records: DataFrame, buckets: DataFrame, number: str = "row_id") -> DataFrame:
    """Add ``copies`` by record number; the buckets are a handful of rows, checked by their count."""
    ranges = buckets.select("copies", "first", "last")
    return records.join(F.broadcast(ranges), (F.col(number) >= F.col("first")) & (F.col(number) < F.col("last"))).drop(
        "first", "last")


def owners_of_tables(spark: SparkSession, tables: tuple[str, ...], config: AssignmentConfig) -> DataFrame:
    """(table, place, owner_id): each table's owners, drawn without replacement, in drawn order."""
    quota = spark.createDataFrame([(t, config.owners_of(t)) for t in tables], "table string, quota int")
    every = quota.withColumn("owner_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(config.owners - 1).cast("bigint"))))
    ranked = every.withColumn("_d", draw(config.seed, "owner", F.col("table"), F.col("owner_id"))).withColumn(
        "place", F.expr("row_number() over (partition by table order by _d, owner_id)"))
    return ranked.where("place <= quota").select("table", F.col("place").cast("bigint").alias("place"), "owner_id")


def uniform_places(records: DataFrame, owners: int, seed: int, table: str) -> DataFrame:
    """(row_id, place): ``copies`` distinct places of 1..owners per record, all sets equally likely.

    Floyd's way: the j-th pick is drawn from a range that grows by one, and a place taken already
    gives way to the new end of the range. It runs inside the row; nothing is joined or sorted.
    """
    picks = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.least(F.col("copies"), F.lit(owners)).cast("bigint")),
        F.array().cast("array<bigint>"),
        lambda taken, j: F.transform(
            F.array((F.lit(owners) - F.least(F.col("copies"), F.lit(owners)) + j).cast("bigint")),
            lambda end: F.transform(
                F.array((F.floor(draw(seed, f"place-{table}", F.col("row_id"), j) * end) + 1).cast("bigint")),
                lambda pick: F.array_append(taken, F.when(F.array_contains(taken, pick), end).otherwise(pick)))[0])[0])
    return records.where("copies > 0").select("row_id", F.explode(picks).alias("place"))


GRID = 4096


def weighted_places(records: DataFrame, weights: DataFrame, seed: int, table: str) -> DataFrame:
    """(row_id, place): ``copies`` distinct places per record (all places, if these are fewer), drawn one
    after the other with the given ``weights(i, weight)``, each draw among the places not taken.

    A draw is a point on the line of places laid end to end, taken places cut out. Places are
    found by an equi join on a grid over that line; a grid cell holds the same share of records
    whatever the weights.
    """
    line = weights.withColumn("hi", F.expr(
        "sum(weight) over (order by i rows between unbounded preceding and current row)")).withColumn(
        "lo", F.col("hi") - F.col("weight")).withColumn(
        "top", F.expr("if(lead(i) over (order by i) is null, 2D, hi)")).withColumn(
        "_cell", F.explode(F.expr(f"sequence(cast(floor(lo * {GRID}) as int), cast(least(floor(hi * {GRID}), {GRID - 1}) as int))")))
    line, ends = cut(line.select("_cell", F.col("i").cast("bigint").alias("_i"), "lo", "hi", "top"), places=F.max("_i"))
    records, seen = cut(records.select("row_id", "copies"), most=F.max("copies"))
    taken_type = "array<struct<lo:double,hi:double,place:bigint>>"
    now = records.select("row_id", "copies", F.array().cast(taken_type).alias("taken"))
    for j in range(1, min(seen["most"] or 0, ends["places"] or 0) + 1):
        mass = "aggregate(taken, 0D, (m, p) -> m + p.hi - p.lo)"
        now = now.withColumn("_x", draw(seed, f"weight-{table}", F.col("row_id"), F.lit(j)) * (1 - F.expr(mass)))
        now = now.withColumn("_x", F.expr(
            "aggregate(sort_array(taken), _x, (x, p) -> if(x >= p.lo, (x - p.lo) + p.hi, x))")).withColumn(
            "_cell", F.when(F.col("copies") >= j, F.least(F.floor(F.col("_x") * GRID).cast("int"), F.lit(GRID - 1))))
        hit = (now["_cell"] == line["_cell"]) & (F.col("_x") >= F.col("lo")) & (
            (F.col("_x") < F.col("top")))
        now = now.join(line, hit, "left").select(
            "row_id", "copies",
            F.when(F.col("_i").isNull(), F.col("taken")).otherwise(F.array_append("taken", F.struct(
                F.col("lo"), F.col("hi"), F.col("_i").alias("place")))).alias("taken"))
    return now.select("row_id", F.explode("taken.place").alias("place"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``pos``, the place of a row in the given order, from 0: a distributed sort, then counts of the sorted files before a row's own, sent to all tasks."""
    ordered = cut(rows.orderBy(*order))
    at = ordered.select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_at"), *rows.columns)
    starts = at.groupBy("_f").agg(F.count(F.lit(1)).alias("_n")).select("_f", F.expr(
        "sum(_n) over (order by _f rows between unbounded preceding and current row) - _n").alias("_start"))
    return at.join(F.broadcast(starts), "_f").select((F.col("_start") + F.col("_at")).alias("pos"), *rows.columns)


def shuffled_rows(records: DataFrame, seed: int, table: str, key: str = "row_id") -> DataFrame:
    """(pos, row_id): a random order of all records, by a distributed sort on the draw."""
    drawn = records.select(key, draw(seed, f"shuffle-{table}", F.col(key)).alias("_d"))
    return numbered(drawn, "_d", key).select("pos", key)


def repair_starved(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """(row_id, owner_id): give every owner of ``owners(owner_id)`` at least one record.

    An owner of n records can give n − 1: first every donor its smallest record, then every donor its next, by owner; in that
    order the gifts go to the owners without records, by owner. Both sides are numbered by distributed sorts and met by number, and all moves are
    applied at once: pairs are counted, offered and rewritten once, whatever the number of owners. Owners that are left
    without a gift stay as they are; the number of pairs stays the same.
    """
    pairs = pairs.select("row_id", "owner_id")
    held = pairs.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))
    starved, seen = cut(owners.select("owner_id").distinct().join(held, "owner_id", "left_anti"), n=F.count(F.lit(1)))
    if not seen["n"]:
        return pairs
    # no donor gives more records than there are owners to get one; the rank is cut to that before the shuffle
    rank = F.expr("row_number() over (partition by owner_id order by row_id)")
    offers = pairs.withColumn("_r", rank).where(F.col("_r") <= seen["n"]).join(held, "owner_id").where(F.col("_r") < F.col("n"))
    first = offers.select("owner_id", "row_id", "_r").orderBy("_r", "owner_id").limit(seen["n"])
    gifts = numbered(first, "_r", "owner_id").select("pos", "owner_id", "row_id")
    moves = numbered(starved.withColumnRenamed("owner_id", "new_owner"), "new_owner").join(gifts, "pos").drop("pos")
    return pairs.join(moves, ["row_id", "owner_id"], "left").select("row_id", F.coalesce("new_owner", "owner_id").alias("owner_id"))


def assign_table(records: DataFrame, table: str, table_owners: DataFrame, config: AssignmentConfig) -> DataFrame:
    """(table, row_id, owner_id) of one table. How many copies a record has follows its place in a
    random order of all records, not its place in the file."""
    m = config.owners_of(table)
    buckets = copy_buckets(records, m, config.max_copy, config.alpha)
    counted = with_copies(shuffled_rows(records, config.seed, table), buckets, "pos").select("row_id", "copies")
    if config.equal_records:
        places = uniform_places(counted, m, config.seed, table)
    else:
        weights = zipf_weights(table_owners.select(F.col("place").alias("i")), config.beta)
        places = weighted_places(counted, weights, config.seed, table)
    pairs = places.join(table_owners.select("place", "owner_id"), "place").select("row_id", "owner_id")
    whole = repair_starved(cut(pairs), table_owners.select("owner_id"))
    return whole.select(F.lit(table).alias("table"), "row_id", "owner_id")


def assign_dataset(tables: Mapping[str, DataFrame], config: AssignmentConfig) -> DataFrame:
    """(table, row_id, owner_id) of all tables ``name → (row_id)``."""
    spark = next(iter(tables.values())).sparkSession
    owners = cut(owners_of_tables(spark, tuple(tables), config))
    result = None
    for name, records in tables.items():
        own = assign_table(records, name, owners.where(F.col("table") == name), config)
        result = own if result is None else result.unionByName(own)
    return result
