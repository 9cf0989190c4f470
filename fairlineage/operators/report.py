"""Reports on assignments and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def owner_record_counts(assignment: DataFrame) -> DataFrame:
    """(table, owner_id, records)."""
    return assignment.groupBy("table", "owner_id").agg(F.count(F.lit(1)).alias("records"))


def owners_per_table(assignment: DataFrame) -> DataFrame:
    """(table, owners): how many owners hold a record of the table."""
    return owner_record_counts(assignment).groupBy("table").agg(F.count(F.lit(1)).alias("owners"))


def run_summary(sv: DataFrame, *, load_seconds: float = 0.0, cal_seconds: float = 0.0,
                total_seconds: float = 0.0) -> DataFrame:
    """Times of a run and the number of owners; the average is per owner, null without owners."""
    n = F.count(F.lit(1))
    return sv.agg(
        (F.lit(float(total_seconds)) / F.nullif(n, F.lit(0))).alias("avg_time"),
        F.lit(float(total_seconds)).alias("total_time"),
        F.lit(float(load_seconds)).alias("load_time"),
        F.lit(float(cal_seconds)).alias("sv_cal_time"),
        n.alias("num_of_owners"))


def value_check(sv: DataFrame, games: DataFrame) -> DataFrame:
    """(owners, total, games, difference): values must sum to the number of games."""
    one = F.lit(1).alias("_one")
    total = sv.agg(F.count(F.lit(1)).alias("owners"), F.sum("sv").alias("total")).select("*", one)
    count = games.agg(F.sum("tuples").alias("games")).select("*", one)
    return total.join(count, "_one").select(
        "owners", "total", "games", (F.col("total") - F.col("games")).alias("difference"))
