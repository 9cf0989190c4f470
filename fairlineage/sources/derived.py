"""Data sets of other shapes, derived row by row from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.registry import JoinPlan, JoinStep, register
from .tables import Dataset

# lineitem → its order → its customer
TRADE = register("trade", JoinPlan("lineitem", (
    JoinStep("orders", ("l_orderkey",), ("o_orderkey",), large=True),
    JoinStep("customer", ("o_custkey",), ("c_custkey",), large=True),
)))

# The matches of a league in the columns of the match data set: an order is a match, suppliers are
# the teams, nations the countries and leagues. One text, for every SQL engine.
MATCH_SQL = """
SELECT o_orderkey AS match_api_id,
       o_orderkey % (SELECT count(*) FROM supplier) + 1 AS home_team_api_id,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL
            ELSE (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM supplier) + 2 END AS away_team_api_id,
       o_custkey % 25 AS country_id, o_custkey % 25 + 1000 AS league_id,
       CASE WHEN o_orderkey % 5 < 2 THEN '2015/2016' ELSE '2014/2015' END AS season,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderkey % 4 END AS home_team_goal,
       CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE o_custkey % 5 END AS away_team_goal
FROM orders"""
TEAM_SQL = """
SELECT s_suppkey AS team_api_id,
       CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE concat(CAST(s_suppkey + 5000 AS varchar(20)), '.0') END AS team_fifa_api_id,
       s_name AS team_long_name
FROM supplier"""
COUNTRY_SQL = "SELECT CAST(n_nationkey AS bigint) AS id, n_name AS name FROM nation"
LEAGUE_SQL = ("SELECT CAST(n_nationkey AS bigint) + 1000 AS id, CAST(n_nationkey AS bigint) AS country_id, "
              "n_name AS name FROM nation")


def raw_match_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    for t in ("orders", "supplier", "nation"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return {name: spark.sql(sql) for name, sql in {
        "Match": MATCH_SQL, "Team": TEAM_SQL, "Country": COUNTRY_SQL, "League": LEAGUE_SQL}.items()}


def match_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    from .tables import clean_soccer

    return Dataset("soccer", clean_soccer(raw_match_tables(spark, sf_dir)))


def trade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traded lines by customer, with one owner each of the supplier's, the part's and the order's
    record."""
    from ..operators.joins import join_along

    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TRADE.tables}
    # owners are found before the joins: small numbers, which shuffle in fewer bytes than keys
    tables["lineitem"] = tables["lineitem"].select(
        "l_orderkey", ((F.col("l_suppkey") * 5 + 3) % 8).alias("supplier_owner"),
        ((F.col("l_partkey") * 5 + 5) % 8).alias("part_owner"))
    joined = join_along(tables, TRADE, with_assignment=True)
    return joined.select("c_custkey", "supplier_owner", "part_owner", ((F.col("o_orderkey") * 5 + 7) % 8).alias("order_owner"))


TRADE_OWNERS = ("supplier_owner", "part_owner", "order_owner")
