"""Table scans: CSV, pipe-delimited files, whole folders, row ids and owner assignments."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import cut, shuffles_deleted
from .schemas import SOCCER_IDS, schema_of

ROW_ID = "_row_id"
_FILE, _BLOCK = "_file", "_block"
ASSIGNMENT_SCHEMA = "table string, row_id bigint, owner_id bigint"


@dataclass
class Dataset:
    """Tables by name (with ``_row_id`` where owners are assigned) and who owns which row."""

    name: str
    tables: dict[str, DataFrame]
    assignment: DataFrame | None = None  # (table, row_id, owner_id)
    views: list[str] = field(default_factory=list)

    @property
    def has_assignment(self) -> bool:
        return self.assignment is not None

    def owners(self) -> DataFrame:
        """All owners of all tables; empty without an assignment."""
        if self.assignment is None:
            spark = next(iter(self.tables.values())).sparkSession
            return spark.createDataFrame([], "owner_id bigint")
        return self.assignment.select("owner_id").distinct()

    def create_views(self) -> "Dataset":
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        self.views = list(self.tables)
        return self


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             infer: bool = False) -> DataFrame:
    """CSV with a header row. Types are declared; inference is one more pass and must be asked for."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    return reader.csv(path)


def list_tables(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, str]:
    """table name → path for every file (or written folder) ``<table><suffix>`` of a folder.

    The listing goes through Spark's own file source, so it works on every file system; file
    contents are not read, and only names (one per file) reach the driver. A written folder is one table however many
    part files it has, though these end in ``suffix`` too: the first match below the folder counts.
    """
    tail = re.escape(suffix)
    name = os.path.basename(folder.rstrip("/"))
    above = "^.*?/" + (f"{re.escape(name)}/(?:[^/]+/)*?" if name.strip(".") else "")
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select(F.regexp_extract("path", rf"{above}([^/]+){tail}(?:/|$)", 1).alias("name"),
                F.regexp_extract("path", rf"({above}[^/]+{tail})(?:/|$)", 1).alias("path"))
        .where("name <> ''").distinct().collect()
    )
    return {r["name"]: r["path"] for r in rows}


def read_folder(spark: SparkSession, folder: str, infer: bool = False) -> dict[str, DataFrame]:
    """One table per ``*.csv`` of a folder, named by the file's stem."""
    return {
        name: read_csv(spark, path, None if infer else schema_of(name), infer)
        for name, path in sorted(list_tables(spark, folder).items())
    }


def _with_split(df: DataFrame, scan: bool) -> DataFrame:
    """Rows with the file and place in it that they come from; what is no plain file scan is written first,
    so that a row's place is the same in every branch and every retry. Spark offers a scan's file columns above a distinct
    as well, where rows of one split are no longer together, so that they resolve says nothing."""
    if {_FILE, _BLOCK} <= set(df.columns):
        return df
    return (df if scan else cut(df)).select(
        "*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK))


def with_position(df: DataFrame, name: str = "pos", scan: bool = False) -> DataFrame:
    """0-based position of a row in the order of the scan, without a global sort.

    Rows number themselves inside their piece of input; only the pieces' row counts (one row per
    file split) are summed up in order and sent to all tasks, so rows are not shuffled. Part files count in name order,
    whatever their sizes. ``scan`` says that ``df`` reads files row by row, without a shuffle, and need not be written first.
    """
    split = [_FILE, _BLOCK]
    numbered = _with_split(df, scan).withColumn("_mid", F.monotonically_increasing_id())
    counts = numbered.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    running = f"sum(_n) over (order by {', '.join(split)} rows between unbounded preceding and current row)"
    starts = counts.select(
        *[F.col(c).alias(f"_at{i}") for i, c in enumerate(split)],
        F.expr(f"{running} - _n - _first").alias("_shift"))
    same_split = [F.col(c) == F.col(f"_at{i}") for i, c in enumerate(split)]
    return numbered.join(F.broadcast(starts), same_split).withColumn(name, F.col("_mid") + F.col("_shift")).drop(
        "_mid", "_shift", *split, *[f"_at{i}" for i in range(len(split))])


def _scan_lines(spark: SparkSession, path: str, line_sep: str = "\n") -> DataFrame:
    return spark.read.option("lineSep", line_sep).text(path).select(
        "value", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with what :func:`with_position` needs."""
    return _scan_lines(spark, path)


def _json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document cut at its commas: a splittable scan instead of one huge row."""
    return _scan_lines(spark, path, ",").where(F.col("value").rlike(r"\d"))


def read_row_index(spark: SparkSession, path: str) -> DataFrame:
    """``[id, id, …]`` → (pos, row_id)."""
    pieces = _json_pieces(spark, path).withColumn(
        "row_id", F.regexp_extract("value", r"(-?\d+)", 1).try_cast("bigint"))
    return with_position(pieces).select("pos", "row_id")


def attach_row_index(table: DataFrame, index: DataFrame, scan: bool = False) -> DataFrame:
    """Give row *i* of the scan the *i*-th id of the index; lengths must agree. ``scan`` as in :func:`with_position`."""
    placed = with_position(table, "_pos", scan).join(
        index.select(F.col("pos").alias("_ipos"), F.col("row_id").alias(ROW_ID)),
        F.col("_pos") == F.col("_ipos"), "full")
    return placed.withColumn(
        ROW_ID,
        F.when(F.col("_pos").isNull() | F.col("_ipos").isNull(),
               F.raise_error(F.lit("row index and table have different lengths")).cast("bigint"))
        .otherwise(F.col(ROW_ID))).drop("_pos", "_ipos")


def read_assignment(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``{"index": {k: row_id}, "owner": {k: owner}}`` → (table, row_id, owner_id).

    Both maps are matched on k; a k that only one of them has is an error. A row may have many
    owners; the same pair given twice counts once.
    """
    pieces = _json_pieces(spark, path).select(
        F.struct(_FILE, _BLOCK, F.monotonically_increasing_id()).alias("at"),
        F.col("value").rlike(r'"index"\s*:\s*\{').alias("opens_index"),
        F.col("value").rlike(r'"owner"\s*:\s*\{').alias("opens_owner"),
        F.regexp_extract("value", r'"(\d+)"\s*:\s*(-?\d+)\s*\s*[}\s]*$', 1).alias("k"),
        F.regexp_extract("value", r'"(\d+)"\s*:\s*(-?\d+)\s*\s*[}\s]*$', 2).try_cast("bigint").alias("v"))
    starts = pieces.where("opens_index or opens_owner")
    index_at = starts.where("opens_index").select(F.min("at")).scalar()
    owner_at = starts.where("opens_owner").select(F.min("at")).scalar()
    in_owner = F.when(owner_at > index_at, F.col("at") >= owner_at).otherwise(F.col("at") < index_at)
    cells = pieces.where("v is not null").withColumn("in_owner", in_owner)
    index = cells.where("not in_owner").select(F.col("k").alias("k1"), F.col("v").alias("row_id"))
    owner = cells.where("in_owner").select(F.col("k").alias("k2"), F.col("v").alias("owner_id"))
    return (
        index.join(owner, F.col("k1") == F.col("k2"), "full")
        .select(
            F.lit(table).alias("table"),
            F.when(F.col("k1").isNull() | F.col("k2").isNull(),
                   F.raise_error(F.lit(f"unmatched key in the assignment of {table}")).cast("bigint"))
            .otherwise(F.col("row_id")).alias("row_id"),
            F.col("owner_id"))
        .distinct()
    )


def load_dataset(spark: SparkSession, name: str, folder: str, assignment: str | None = None,
                 infer: bool = False) -> Dataset:
    """All tables of a folder; with an assignment folder also their row ids and owners.

    The assignment folder holds either ``<table>-index.json`` and ``<table>-owner.json`` per
    table, or the parquet table this package writes (then ``_row_id`` is a column already).
    """
    tables = read_folder(spark, folder, infer)
    if assignment is None:
        return Dataset(name, tables)
    if not list_tables(spark, assignment, "-owner.json"):
        return Dataset(name, tables, spark.read.schema(ASSIGNMENT_SCHEMA).parquet(assignment))
    pairs = None
    for table in tables:
        index = read_row_index(spark, os.path.join(assignment, f"{table}-index.json"))
        tables[table] = attach_row_index(tables[table], index, scan=True)
        owned = read_assignment(spark, os.path.join(assignment, f"{table}-owner.json"), table)
        pairs = owned if pairs is None else pairs.unionByName(owned)
    return Dataset(name, tables, pairs)


def append_text_row_id(lines: DataFrame, table: str, column: str = "value", scan: bool = False) -> DataFrame:
    """Append ``|<table>.<line number from 1>`` to every line. ``scan`` as in :func:`with_position`."""
    return with_position(lines, "_line", scan).select(
        F.concat(F.col(column), F.lit(f"|{table}."), (F.col("_line") + 1).cast("string")).alias(column))


def read_delimited(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``|``-separated rows with one extra last field, which is dropped; columns by table name."""
    schema = schema_of(table)
    if schema is None:
        raise ValueError(f"no declared columns for {table!r}")
    wide = StructType.fromDDL(schema.toDDL() + ", _last string")
    return spark.read.option("sep", "|").schema(wide).csv(path).drop("_last")


def write_csv(df: DataFrame, path: str) -> None:
    with shuffles_deleted(df.sparkSession):
        df.write.mode("overwrite").option("header", True).csv(path)


def whole_number_cells(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Coerce cells to whole numbers; what is none becomes null (``12.0`` counts as 12)."""
    for c in columns:
        number = F.col(c).try_cast("double")
        df = df.withColumn(
            c, F.coalesce(F.col(c).try_cast("bigint"), F.when(number == F.floor(number), number.cast("bigint"))))
    return df


def clean_soccer(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Coerce id columns and give the team table its two roles; other tables are left out."""
    clean = {t: whole_number_cells(raw[t], ids) for t, ids in SOCCER_IDS.items() if t in raw}
    team = clean.pop("Team")
    return {"HomeTeam": team, "AwayTeam": team, **clean}
