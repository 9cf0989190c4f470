"""Sinks: attribution results and owner assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.report import run_summary
from ..session import cut, shuffles_deleted


def result_document(sv: DataFrame, *, method: str, csv_dir: str | None = None,
                    assignment_dir: str | None = None, num_threads: int | None = None,
                    sample_size: int | None = None, load_seconds: float = 0.0,
                    cal_seconds: float = 0.0, total_seconds: float = 0.0) -> DataFrame:
    """One row with the value of every owner and the settings of the run.

    The document is one JSON object per run by format; it grows with the number of owners, not
    with the data. For very many owners read the ``sv`` table instead.
    """
    summary = run_summary(sv, load_seconds=load_seconds, cal_seconds=cal_seconds, total_seconds=total_seconds)
    settings = {
        "method": F.lit(method), "csv_dir": F.lit(csv_dir).cast("string"),
        "assignment_dir": F.lit(assignment_dir).cast("string"),
        "num_threads": F.lit(num_threads).cast("bigint"), "sample_size": F.lit(sample_size).cast("bigint"),
    }
    values = sv.agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col("owner_id").cast("string"), F.col("sv"))))
        ).alias("shapley_values"))
    return _beside(summary, values).select("*", *[v.alias(k) for k, v in settings.items()])


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables side by side."""
    one = F.lit(1).alias("_one")
    return left.select("*", one).join(right.select("*", one), "_one").drop("_one")


def write_result(document: DataFrame, sv: DataFrame, path: str) -> None:
    """``result.json`` (one object) and the ``sv`` table as parquet."""
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/result.json")
    sv.write.mode("overwrite").parquet(f"{path}/sv")


def write_assignment(assignment: DataFrame, path: str) -> None:
    """The assignment as one partitioned table, clustered by table and row."""
    with shuffles_deleted(assignment.sparkSession):
        assignment.write.mode("overwrite").partitionBy("table").parquet(path)


def assignment_lines(assignment: DataFrame, table: str, at: Column | None = None) -> DataFrame:
    """(k, row_id, owner_id) numbered pairs of one table, the content of ``<table>-owner.json``."""
    from .tables import with_position

    return with_position(assignment.where(F.col("table") == table).select("row_id", "owner_id"), "k")


def write_assignment_json(assignment: DataFrame, index: DataFrame, table: str, path: str) -> None:
    """``<table>-owner.json`` and ``<table>-index.json`` for readers of that format.

    Each is one JSON document cut into ordered part files (joined in name order they are the
    document), so sorting and writing are spread over tasks.
    """
    write_owner_json(assignment, table, path)
    write_index_json(index, table, path)


def write_owner_json(assignment: DataFrame, table: str, path: str) -> None:
    """``<table>-owner.json``."""
    pairs = assignment_lines(assignment, table)
    cells = pairs.select(F.lit(0).alias("part"), "k", F.col("row_id").alias("v")).unionByName(
        pairs.select(F.lit(1).alias("part"), "k", F.col("owner_id").alias("v")))
    last = pairs.agg(F.max("k")).scalar()
    first_of_map, last_of_map, second = F.col("k") == 0, F.col("k") == last, F.col("part") == 1
    _write_pieces(
        cells.withColumn("value", F.concat(
            F.when(first_of_map & second, '"owner":{').when(first_of_map, '{"index":{').otherwise(""),
            F.format_string('"%d":%d', F.col("k"), F.col("v")),
            F.when(last_of_map & second, "}}").when(last_of_map, "},").otherwise(","))),
        ["part", "k"], f"{path}/{table}-owner.json")


def write_index_json(index: DataFrame, table: str, path: str) -> None:
    """``<table>-index.json`` of ``index(pos, row_id)``, which is worked out once: the sort reads it twice."""
    index, seen = cut(index.select("pos", "row_id"), end=F.max("pos"))
    _write_pieces(
        index.withColumn("value", F.concat(
            F.when(F.col("pos") == 0, "[").otherwise(""), F.col("row_id").cast("string"),
            F.when(F.col("pos") == F.lit(seen["end"]), "]").otherwise(","))),
        ["pos"], f"{path}/{table}-index.json")


def _write_pieces(df: DataFrame, order: list[str], path: str) -> None:
    with shuffles_deleted(df.sparkSession):
        df.orderBy(*order).select("value").write.mode("overwrite").text(path)
