"""Declared column types of the data sets (no inference pass over the files)."""

from __future__ import annotations

from pyspark.sql.types import StructType

# The headers of the data set's files, misspelled names included.
TPCH = {
    "region": "r_regionkey int, r_name string, r_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey int, s_phone string, "
                "s_acctbal double, s_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey int, c_phone string, "
                "c_acctbal double, c_mktsegment string, c_comment string",
    "partsupp": "ps_partkey bigint, ps_suppkey bigint, ps_availqty int, ps_supplycost double, "
                "ps_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, "
            "p_container string, p_retailprice double, p_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdata string, o_orderpriority string, o_clerk string, o_shippriority int, "
              "o_comment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate string, l_commitdata string, "
                "l_receiptdata string, l_shipinstruct string, l_shipmode string, l_comment string",
}

# The columns whose cells must be whole numbers or null.
SOCCER_IDS = {
    "Team": ("team_fifa_api_id",),
    "Match": ("match_api_id", "home_team_api_id", "away_team_api_id"),
    "Country": ("id",),
    "League": ("id", "country_id"),
}


def schema_of(table: str) -> StructType | None:
    """Schema of a file by its name; the longest table name that starts it wins (partsupp, not part)."""
    fits = [t for t in TPCH if table.startswith(t)]
    return StructType.fromDDL(TPCH[max(fits, key=len)]) if fits else None
