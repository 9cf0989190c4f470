"""The driver's parquet tables as a data set with a rule-based owner assignment.

The rule uses integer arithmetic only, so SQL engines agree on it: a row with key ``key`` of the
table with salt ``s`` has ``copies`` owners ``(key*5 + s + 3*j) % owners`` for j < copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import ROW_ID, Dataset

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

# Row key and salt of every table in the assignment rule.
ROW_KEYS = {
    "region": ("r_regionkey", 1),
    "nation": ("n_nationkey", 2),
    "supplier": ("s_suppkey", 3),
    "partsupp": ("ps_partkey * 7 + ps_suppkey", 4),
    "part": ("p_partkey", 5),
    "lineitem": ("l_orderkey * 7 + l_linenumber", 6),
    "orders": ("o_orderkey", 7),
    "customer": ("c_custkey", 8),
}
OWNERS = 8


@dataclass(frozen=True)
class Rule:
    salt: int
    owners: int = OWNERS

    def copies(self, key: Column) -> Column:
        share = (key * 37 + self.salt) % 100
        return F.when(share < 85, 1).when(share < 95, 2).when(share < 98, 3).otherwise(4)

    def owner_set(self, key: Column) -> Column:
        picks = F.array(*[(key * 5 + self.salt + 3 * j) % self.owners for j in range(4)])
        return F.sort_array(F.slice(picks, 1, self.copies(key)))


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    tables["partsupp"] = (
        tables["lineitem"].select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
        .distinct())
    return tables


def parquet_dataset(spark: SparkSession, sf_dir: str, owners: int = OWNERS) -> Dataset:
    """Tables with ``_row_id``, and the (table, row_id, owner_id) pairs of the rule as their assignment."""
    tables, pairs = {}, None
    for name, df in read_tables(spark, sf_dir).items():
        key, salt = ROW_KEYS[name]
        df = df.withColumn(ROW_ID, F.expr(f"cast({key} as bigint)"))
        tables[name] = df
        # an id's owners depend on the id alone, so ids are made distinct before they are multiplied by their owners
        owned = df.select(F.col(ROW_ID).alias("row_id")).distinct().select(
            F.lit(name).alias("table"), "row_id", F.explode(F.array_distinct(Rule(salt, owners).owner_set(F.col("row_id")))).alias("owner_id"))
        pairs = owned if pairs is None else pairs.unionByName(owned)
    return Dataset("tpch", tables, pairs)
