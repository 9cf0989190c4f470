"""Every registered query: name → function of (session, folder of the parquet tables)."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import sets as S
from ..operators import assign as A
from ..operators import coefficients as C
from ..operators import dnf as D
from ..operators import games as G
from ..operators import joins as J
from ..operators import modules as M
from ..operators.run import run_attribution, totals_of_shapes
from ..operators import report as R
from ..operators import shapley as V
from ..operators import synthesis as T
from ..session import cut, shared_folder
from ..sources import derived as X
from ..sources import results as W
from ..sources import tables as I
from ..sources.schemas import schema_of
from ..sources.samples import ROW_KEYS, TABLES, parquet_dataset, read_tables
from .registry import JoinPlan, JoinStep, plan_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SAMPLES = 1000  # orders that the permutation method draws

_written: dict[tuple[str, str, str], DataFrame] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _once(name: str, spark: SparkSession, sf: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A working table many queries start from, written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        _written[key] = cut(build())
    return _written[key]


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), "fairlineage-files", uuid.uuid4().hex)


def _text(column: Column | str) -> Column:
    return S.text_of_set(F.col(column) if isinstance(column, str) else column)


def tuple_games(spark: SparkSession, sf: str) -> DataFrame:
    """(clauses, tuples, game_id) of the 8-table join."""
    return _once("tuple_games", spark, sf, lambda: G.name_games(G.tuple_games(G.lineage(parquet_dataset(spark, sf), texts=True))))


def tuple_dnf(spark: SparkSession, sf: str) -> DataFrame:
    return G.dual_terms(tuple_games(spark, sf))


def trade_games(spark: SparkSession, sf: str) -> DataFrame:
    return _once("trade", spark, sf, lambda: G.group_games(X.trade_rows(spark, sf), "c_custkey", X.TRADE_OWNERS))


def order_games(spark: SparkSession, sf: str) -> DataFrame:
    """(game_id, term): one game per order, one term per line with its supplier's and part's owner."""
    lines = _read(spark, sf, "lineitem").select(
        "l_orderkey", ((F.col("l_suppkey") * 5 + 3) % 8).alias("supplier_owner"),
        ((F.col("l_partkey") * 5 + 5) % 8).alias("part_owner"))
    return _once("orders", spark, sf, lambda: G.group_games(lines, "l_orderkey", ["supplier_owner", "part_owner"]))


def match_dnf(spark: SparkSession, sf: str) -> DataFrame:
    return _once("match", spark, sf, lambda: G.match_games(X.match_dataset(spark, sf)))


def trade_sets(spark: SparkSession, sf: str) -> DataFrame:
    """(game_id, members): three owners per customer, by its key."""
    key = F.col("c_custkey")
    return _read(spark, sf, "customer").select(
        key.alias("game_id"), F.sort_array(F.array(key % 8, (key + 1) % 8, (key + 3) % 8)).alias("members"))


def other_games(spark: SparkSession, sf: str) -> DataFrame:
    """(game_id, term): a second function per customer: the owners of its own record, or two others."""
    key = F.col("c_custkey")
    return _read(spark, sf, "customer").select(key.alias("game_id"), F.explode(F.array(
        F.array((key * 5) % 8), F.sort_array(F.array((key + 2) % 8, (key + 5) % 8)))).alias("term"))


def _terms(dnf: DataFrame) -> DataFrame:
    return dnf.select("game_id", _text("term").alias("term"))


def _rounded(sv: DataFrame, digits: int = 6) -> DataFrame:
    return sv.select("game_id", "owner_id", F.round("sv", digits).alias("sv"))


# --- sources and sinks ------------------------------------------------------------------------


@query
def csv_scan(spark, sf):
    path = _folder(spark)
    I.write_csv(_read(spark, sf, "customer"), path)
    return I.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


_files: dict[tuple[str, str, str], str] = {}


def _files_once(name: str, spark: SparkSession, sf: str, write: Callable[[str], None], folder: str | None = None) -> str:
    """A folder of files, written once per application and folder of tables."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _files:
        path = folder or _folder(spark)
        write(path)
        _files[key] = path
    return _files[key]


def _data_folder(spark: SparkSession, sf: str) -> str:
    """All eight tables as CSV files of one folder."""
    def write(path: str) -> None:
        for t, df in read_tables(spark, sf).items():
            I.write_csv(df, f"{path}/{t}.csv")

    return _files_once("data", spark, sf, write)


def _indexed_folders(spark: SparkSession, sf: str) -> tuple[str, str]:
    """All eight tables as CSV files, and the row index JSON of each."""
    data = _data_folder(spark, sf)

    def write(path: str) -> None:
        for t, df in read_tables(spark, sf).items():
            index = I.with_position(I.read_csv(spark, f"{data}/{t}.csv", df.schema), scan=True).select(
                "pos", F.expr(f"cast({ROW_KEYS[t][0]} as bigint)").alias("row_id"))
            W.write_index_json(index, t, path)

    return data, _files_once("index", spark, sf, write)


def _owned_folders(spark: SparkSession, sf: str) -> tuple[str, str]:
    """All eight tables as CSV files, and the row index and owner JSON of their assignment."""
    data, owned = _indexed_folders(spark, sf)

    def write(path: str) -> None:
        assignment = parquet_dataset(spark, sf).assignment
        for t in ROW_KEYS:
            W.write_owner_json(assignment, t, path)

    return data, _files_once("owners", spark, sf, write, owned)


def _stacked(tables: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


@query
def folder_scan(spark, sf):
    return _stacked(
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))
        for name, df in I.read_folder(spark, _data_folder(spark, sf), infer=True).items())


@query
def row_index_attach(spark, sf):
    """Every row of every table with the id that its place in the index gives it."""
    data, owned = _indexed_folders(spark, sf)
    tables = {}
    for t, df in read_tables(spark, sf).items():
        rows = I.read_csv(spark, f"{data}/{t}.csv", df.schema)
        tables[t] = I.attach_row_index(rows, I.read_row_index(spark, f"{owned}/{t}-index.json"), scan=True)
    return _stacked(df.select(
        F.lit(t).alias("table_name"), F.expr(f"cast({ROW_KEYS[t][0]} as bigint)").alias("row_key"),
        F.col(I.ROW_ID).alias("row_id")) for t, df in tables.items())


@query
def assignment_json_scan(spark, sf):
    _, owned = _owned_folders(spark, sf)
    return _stacked(I.read_assignment(spark, f"{owned}/{t}-owner.json", t).select(
        F.col("table").alias("table_name"), "row_id", "owner_id") for t in ROW_KEYS)


@query
def dataset_load_with_assignment(spark, sf):
    ds = I.load_dataset(spark, "tpch", *_owned_folders(spark, sf), infer=True)
    owners = ds.assignment.groupBy("table", "row_id").agg(F.sort_array(F.collect_list("owner_id")).alias("owners"))
    rows = _stacked(df.select(F.lit(t).alias("table"), F.col(I.ROW_ID).alias("row_id")) for t, df in ds.tables.items())
    return rows.join(owners, ["table", "row_id"]).select(
        F.col("table").alias("table_name"), "row_id", _text("owners").alias("owners"))


@query
def dataset_load_without_assignment(spark, sf):
    ds = I.load_dataset(spark, "tpch", _data_folder(spark, sf), infer=True)
    # left names stay without an assignment, so the chain's keys are named by their first table
    first = {"p_partkey": "ps_partkey", "ps_suppkey": "s_suppkey"}
    chain = plan_for("tpch")
    steps = tuple(JoinStep(s.table, tuple(first.get(k, k) for k in s.left_keys), s.right_keys, s.how, s.large) for s in chain.steps)
    joined = J.join_along(ds.tables, JoinPlan(chain.init_table, steps), with_assignment=False)
    big = [F.col(c).cast("bigint").alias(c) for c in ("s_suppkey", "ps_partkey", "l_orderkey", "o_custkey")]
    return joined.select("r_name", "n_name", "s_name", "p_name", "c_name", "l_linenumber", *big, "o_orderpriority",
                         F.lit(ds.has_assignment).alias("has_assignment"))


@query
def owner_universe(spark, sf):
    return parquet_dataset(spark, sf).owners()


@query
def result_json_sink(spark, sf):
    path = _folder(spark)
    run_attribution(parquet_dataset(spark, sf), "iusv", path)
    back = spark.read.schema("method string, num_of_owners bigint, shapley_values map<string,double>").json(
        f"{path}/result.json")
    return back.select("method", "num_of_owners", F.explode("shapley_values").alias("owner", "sv")).select(
        "method", "num_of_owners", F.col("owner").cast("bigint").alias("owner_id"), F.round("sv", 4).alias("sv"))


@query
def assignment_sink(spark, sf):
    path = _folder(spark)
    W.write_assignment(parquet_dataset(spark, sf).assignment, path)
    return spark.read.parquet(path).select(F.col("table").alias("table_name"), "row_id", "owner_id")


def _declared(column: str, df: DataFrame) -> Column:
    """The given column that a declared column is read from, as text; columns that the given tables lack are empty."""
    given = {"o_orderdata": "o_orderdate"}.get(column, column)
    return F.col(given).cast("string") if given in df.columns else F.lit("")


@query
def delimited_scan(spark, sf):
    """All eight tables as lines with a row id at the end, read back by their declared columns; a row's cells in one
    digest, amounts in hundredths."""
    path, found = _folder(spark), []
    for t, df in read_tables(spark, sf).items():
        names = schema_of(t).fieldNames()
        cells = [F.coalesce(_declared(c, df), F.lit("")) for c in names]
        I.append_text_row_id(df.select(F.concat_ws("|", *cells).alias("value")), t, scan=t in TABLES).write.text(f"{path}/{t}")
        back = I.read_delimited(spark, f"{path}/{t}", t)
        shown = [F.round(F.col(f.name) * 100).cast("bigint") if f.dataType.typeName() == "double" else F.col(f.name)
                 for f in back.schema]
        found.append(back.select(
            F.lit(t).alias("table_name"), F.expr(f"cast({ROW_KEYS[t][0]} as bigint)").alias("row_key"),
            F.md5(F.concat_ws("|", *[c.cast("string") for c in shown]).cast("binary")).alias("cells")))
    return _stacked(found)


@query
def text_row_id(spark, sf):
    path, customer = _folder(spark), _read(spark, sf, "customer")
    customer.orderBy("c_custkey").select(F.concat_ws("|", *customer.columns).alias("value")).write.text(path)
    return I.append_text_row_id(I.read_lines(spark, path), "customer").select(F.col("value").alias("line"))


@query
def soccer_cleanup(spark, sf):
    tables = X.match_dataset(spark, sf).tables
    home, away = tables["HomeTeam"], tables["AwayTeam"]
    return home.select("team_api_id", "team_fifa_api_id", "team_long_name").join(
        away.select("team_api_id", F.col("team_fifa_api_id").alias("away_fifa_api_id")), "team_api_id")


# --- owner assignment -------------------------------------------------------------------------


def _numbered(spark, sf, table="orders"):
    key = {"orders": "o_orderkey", "part": "p_partkey"}[table]
    return _read(spark, sf, table).select(F.col(key).alias("row_id"))


@query
def zipf_weights(spark, sf):
    places = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"))
    return A.zipf_weights(places, 3.0).select("i", F.round("weight", 9).alias("weight"))


@query
def copy_buckets(spark, sf):
    return A.copy_buckets(_read(spark, sf, "lineitem"), 500, 4, 3.0)


@query
def copies_per_record(spark, sf):
    records = I.with_position(_read(spark, sf, "orders").select("o_orderkey"), "row_id", scan=True).select("row_id")
    counted = A.with_copies(records, A.copy_buckets(records, 500, 4, 3.0))
    return counted.groupBy("copies").agg(F.count(F.lit(1)).alias("records"), F.min("row_id").alias("first_row"))


def _drawn_owners(spark, sf, **more):
    """Owners drawn for each table out of those that a loaded assignment of 500 names, with the table's records per owner."""
    ds = parquet_dataset(spark, sf, owners=500)
    config = A.AssignmentConfig(owners=ds.owners().count(), **more)
    own = cut(A.owners_of_tables(spark, A.tables_of("tpch"), config))
    held = own.groupBy("table").agg(F.count(F.lit(1)).alias("_owners")).join(
        _stacked(df.groupBy().agg(F.count(F.lit(1)).alias("_rows")).withColumn("table", F.lit(t)) for t, df in ds.tables.items()),
        "table")
    return own.join(held, "table").select(
        F.col("table").alias("table_name"), "place", "owner_id", F.expr("_rows div _owners").alias("records_each"))


@query
def owners_of_tables_equal(spark, sf):
    return _drawn_owners(spark, sf)


@query
def owners_of_tables_unequal(spark, sf):
    return _drawn_owners(spark, sf, equal_owners=False)


@query
def uniform_record_owners(spark, sf):
    records = _numbered(spark, sf, "part").withColumn("copies", F.col("row_id") % 4 + 1)
    return A.uniform_places(records, 50, 1, "part")


@query
def weighted_record_owners(spark, sf):
    records = _numbered(spark, sf, "part").withColumn("copies", F.col("row_id") % 3 + 1)
    weights = A.zipf_weights(spark.range(1, 51).withColumnRenamed("id", "i"), 3.0)
    return A.weighted_places(records, weights, 1, "part")


@query
def row_id_shuffle(spark, sf):
    return A.shuffled_rows(_read(spark, sf, "part").select(F.col("p_partkey").alias("row_id")), 1, "part")


@query
def starved_owner_repair(spark, sf):
    pairs = _read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("row_id"), (F.col("s_suppkey") % 3).alias("owner_id"))
    owners = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("owner_id"))
    return A.repair_starved(pairs, owners)


def _numbered_tables(spark, sf):
    """All eight tables with numbered rows."""
    return {t: I.with_position(df, "row_id", scan=t in TABLES).select("row_id") for t, df in read_tables(spark, sf).items()}


@query
def assignment_driver(spark, sf):
    tables = _numbered_tables(spark, sf)
    made = A.assign_dataset(tables, A.AssignmentConfig(owners=20, seed=4))
    return made.groupBy("table").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("row_id").alias("records"),
        F.count_distinct("owner_id").alias("owners")).withColumnRenamed("table", "table_name")


@query
def assignment_driver_weighted(spark, sf):
    tables = _numbered_tables(spark, sf)
    made = A.assign_dataset(tables, A.AssignmentConfig(owners=20, seed=4, equal_owners=False, equal_records=False))
    return made.groupBy("table").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("row_id").alias("records"),
        F.count_distinct("owner_id").alias("owners")).withColumnRenamed("table", "table_name")


@query
def owner_record_counts(spark, sf):
    return R.owner_record_counts(parquet_dataset(spark, sf).assignment).withColumnRenamed("table", "table_name")


@query
def owners_per_table(spark, sf):
    return R.owners_per_table(parquet_dataset(spark, sf).assignment).withColumnRenamed("table", "table_name")


# --- joins ------------------------------------------------------------------------------------


def _tpch_joined(spark, sf):
    ds = parquet_dataset(spark, sf)
    return J.join_along(ds.tables, plan_for("tpch"), with_assignment=True)


@query
def tpch_chain_join(spark, sf):
    return _tpch_joined(spark, sf).select("l_suppkey", "l_partkey", "o_orderkey", "c_custkey", "s_nationkey", "n_name",
                                          "l_linenumber", "l_quantity")


@query
def joined_row_ids(spark, sf):
    ids = J.row_ids(_tpch_joined(spark, sf))
    return ids.withColumnsRenamed({c: f"row_{c.rsplit(':', 1)[1]}" for c in ids.columns})


@query
def soccer_star_join(spark, sf):
    joined = J.join_along(X.match_dataset(spark, sf).tables, plan_for("soccer"), with_assignment=False)
    return joined.select("match_api_id", "home_team_api_id", "away_team_api_id", "name", F.col("name:League").alias(
        "league_name"), "team_fifa_api_id", F.col("team_long_name:AwayTeam").alias("away_name"), "season")


@query
def soccer_left_join(spark, sf):
    joined = J.join_along(X.match_dataset(spark, sf).tables, plan_for("soccer"), with_assignment=True)
    return joined.select("match_api_id", F.col("team_api_id:AwayTeam").alias("last_team_key"), "team_long_name",
                         F.col("team_long_name:AwayTeam").alias("away_name"))


@query
def joined_tuples_distinct(spark, sf):
    ds = parquet_dataset(spark, sf)
    narrow = {
        "lineitem": ds.tables["lineitem"].select("l_orderkey", "l_suppkey"),
        "orders": ds.tables["orders"].select("o_orderkey", "o_custkey"),
        "customer": ds.tables["customer"].select("c_custkey", "c_nationkey")}
    return J.join_along(narrow, plan_for("trade"), with_assignment=True, distinct=True)


def _melted(spark, sf, written: bool = False) -> DataFrame:
    """``written``: the ids are written once before they are melted, for what reads them twice."""
    ids = J.row_ids(_tpch_joined(spark, sf))
    ids = cut(ids) if written else ids
    return J.melt_row_ids(ids.withColumn("game_id", F.xxhash64(*[f"`{c}`" for c in ids.columns])))


@query
def lineage_lookup(spark, sf):
    found = J.lookup_owners(_melted(spark, sf, written=True), parquet_dataset(spark, sf).assignment)
    return found.groupBy(F.col("table").alias("table_name"), "owner_id").agg(F.count(F.lit(1)).alias("tuples"))


@query
def lineage_owner_counts(spark, sf):
    return J.count_owners(_melted(spark, sf), parquet_dataset(spark, sf).assignment).withColumnRenamed("table", "table_name")


@query
def unmatched_row_check(spark, sf):
    known = parquet_dataset(spark, sf).assignment.where("not (table = 'supplier' and row_id % 10 = 0)")
    return J.unmatched_rows(_melted(spark, sf), known).withColumnRenamed("table", "table_name")


@query
def tuple_lineage(spark, sf):
    return G.counted_families(G.lineage(parquet_dataset(spark, sf), texts=True)).select(
        F.concat_ws(" | ", F.sort_array(F.transform("family", S.text_of_set))).alias("family"), F.col("n").alias("tuples"))


# --- columns, predicates, scalar functions ----------------------------------------------------


def _won_matches(spark, sf):
    joined = J.join_along(X.match_dataset(spark, sf).tables, plan_for("soccer"), with_assignment=False)
    return G.with_winner(joined, "home_team_goal", "away_team_goal", "team_long_name", "team_long_name:AwayTeam")


@query
def match_winner(spark, sf):
    return _won_matches(spark, sf).select("match_api_id", "winner")


@query
def season_filter(spark, sf):
    return _won_matches(spark, sf).where(F.col("season") == "2015/2016").select("match_api_id", "season")


@query
def season_filter_without_draws(spark, sf):
    return _won_matches(spark, sf).where((F.col("season") == "2015/2016") & (F.col("winner") != "DRAW")).select(
        "match_api_id", "winner")


@query
def owner_columns_by_name(spark, sf):
    won = _won_matches(spark, sf)
    columns = G.columns_containing(won, "api_id")
    return won.select("match_api_id", F.concat_ws(",", *[
        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in sorted(columns)]).alias("owner_cells"))


@query
def games_in_winner_order(spark, sf):
    won = _won_matches(spark, sf).where((F.col("season") == "2015/2016") & (F.col("winner") != "DRAW"))
    return won.groupBy("winner").agg(F.count(F.lit(1)).alias("matches")).orderBy("winner")


@query
def owner_cell_cast(spark, sf):
    rows = _read(spark, sf, "supplier").select(
        "s_suppkey", S.owner_set(F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey"),
                                 F.when(F.col("s_suppkey") % 2 == 0, -F.col("s_suppkey")), wrap_u32=True).alias("owners"))
    return rows.select("s_suppkey", _text("owners").alias("owners"))


def _set_pairs(spark, sf):
    """Two owner sets per order: those of its own record and a rule-made one."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return _read(spark, sf, "orders").select(
        "o_orderkey", S.canonical(F.array(o % 8, (o + 3) % 8, (o * 5 + 1) % 8)).alias("a"),
        S.canonical(F.array(c % 8, (c + 1) % 8)).alias("b"))


@query
def set_algebra(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _set_pairs(spark, sf).select(
        "o_orderkey", _text(S.union(a, b)).alias("set_union"),
        F.array_join(S.intersection(a, b), " ").alias("set_intersection"),
        F.array_join(S.difference(a, b), " ").alias("set_difference"))


@query
def set_predicates(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _set_pairs(spark, sf).select(
        "o_orderkey", S.overlaps(a, b).alias("overlaps"), S.is_subset(b, a).alias("is_subset"),
        S.is_superset(b, a).alias("is_superset"), S.contains(a, F.lit(3).cast("bigint")).alias("has_three"),
        S.cardinality(a).alias("members"), S.is_singleton(b).alias("is_single"),
        S.same_members(F.reverse(a), b).alias("same"))


@query
def binomials(spark, sf):
    n = F.col("l_quantity").cast("bigint")
    return _read(spark, sf, "lineitem").select(n.alias("n"), F.col("l_linenumber").cast("bigint").alias("k")).distinct(
    ).select("n", "k", S.binomial(F.col("n"), F.col("k")).cast("bigint").alias("binom"))


@query
def binomial_rows(spark, sf):
    n = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"))
    return n.select("n", F.posexplode(S.binomial_row(F.col("n"))).alias("k", "c")).select(
        "n", F.col("k").cast("bigint").alias("k"), F.col("c").cast("bigint").alias("binom"))


@query
def game_text(spark, sf):
    return D.text_form(trade_games(spark, sf))


# --- aggregation ------------------------------------------------------------------------------


@query
def grouped_owner_lists(spark, sf):
    return G.grouped_lists(X.trade_rows(spark, sf), "c_custkey", X.TRADE_OWNERS).select(
        "game_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "copies")


@query
def distinct_owner_sets(spark, sf):
    rows = X.trade_rows(spark, sf).select(F.col("c_custkey").alias("game_id"), S.owner_set(
        *[F.col(c) for c in X.TRADE_OWNERS]).alias("term"))
    return _terms(rows.dropDuplicates(D.KEYS))


@query
def smallest_term(spark, sf):
    return trade_games(spark, sf).groupBy("game_id").agg(
        F.min(F.struct(F.size("term").alias("n"), "term"))["term"].alias("term")).select("game_id", _text("term").alias("term"))


@query
def coalition_utility(spark, sf):
    sets = trade_sets(spark, sf).select("game_id", "members")
    return V.utilities(trade_games(spark, sf), sets).select("game_id", _text("members").alias("members"),
                                                             F.col("value").cast("bigint").alias("value"))


@query
def winning_coalitions_by_size(spark, sf):
    won = V.coalitions(V.masked_games(trade_games(spark, sf))).where(V.is_winning())
    return won.groupBy("game_id", F.expr("bit_count(coalition)").cast("bigint").alias("k")).agg(
        F.count(F.lit(1)).alias("winning"))


@query
def run_summary(spark, sf):
    """The summary of a measured run. Seconds differ from run to run, so their relations are returned in place of them."""
    _, document = run_attribution(parquet_dataset(spark, sf), "iusv")
    t = F.col("total_time")
    return document.select(
        "num_of_owners", ((F.col("load_time") > 0) & (F.col("sv_cal_time") > 0)).alias("both_parts_took_time"),
        (F.abs(F.col("load_time") + F.col("sv_cal_time") - t) <= 0.01 * t).alias("parts_make_the_total"),
        (F.abs(F.col("avg_time") * F.col("num_of_owners") - t) <= 1e-9 * t).alias("average_is_per_owner"))


@query
def value_total_check(spark, sf):
    return R.value_check(total_sv(spark, sf), tuple_games(spark, sf)).select(
        "owners", F.round("total", 4).alias("total"), "games")


# --- games ------------------------------------------------------------------------------------


@query
def tuple_game_clauses(spark, sf):
    return tuple_games(spark, sf).select("game_id", "tuples")


@query
def tuple_game_terms(spark, sf):
    return _terms(D.expand_clauses(tuple_games(spark, sf)))


@query
def group_game_terms(spark, sf):
    return _terms(trade_games(spark, sf))


@query
def match_game_terms(spark, sf):
    return _terms(match_dnf(spark, sf))


@query
def minimised_terms(spark, sf):
    raw = X.trade_rows(spark, sf).select(F.col("c_custkey").alias("game_id"), F.explode(F.array(
        S.owner_set(F.col("supplier_owner"), F.col("part_owner")),
        S.owner_set(*[F.col(c) for c in X.TRADE_OWNERS]))).alias("term"))
    return _terms(D.minimise(raw))


@query
def game_players(spark, sf):
    return D.variables(trade_games(spark, sf))


@query
def game_player_counts(spark, sf):
    return D.owner_counts(trade_games(spark, sf))


@query
def minimal_sets_with_owner(spark, sf):
    return _terms(D.minimal_sets(trade_games(spark, sf), F.array_contains("term", F.lit(3).cast("bigint"))))


@query
def games_by_mode(spark, sf):
    """Both ways to make games, chosen by whether there is an assignment."""
    tuples = G.games_of(parquet_dataset(spark, sf))
    matches = G.games_of(X.match_dataset(spark, sf))
    return tuples.select(F.lit("tuple").alias("mode"), "game_id", _text("term").alias("term"), "tuples").unionByName(
        matches.select(F.lit("group").alias("mode"), "game_id", _text("term").alias("term"), "tuples"))


@query
def tuple_shapes(spark, sf):
    """How often an owner takes a place in a shape; places are summed up to be comparable."""
    shapes = G.tuple_shapes(G.lineage(parquet_dataset(spark, sf), texts=True), count_first=True)
    return shapes.groupBy("owner_id").agg(F.sum("tuples").alias("appearances"))


# --- DNF algebra ------------------------------------------------------------------------------


@query
def dnf_kinds(spark, sf):
    games = _read(spark, sf, "customer").select(F.col("c_custkey").alias("game_id"))
    return D.kinds(D.partial_eval(trade_games(spark, sf), trade_sets(spark, sf), True), games)


@query
def dnf_evaluate_true(spark, sf):
    return D.evaluate(trade_games(spark, sf), trade_sets(spark, sf), True)


@query
def dnf_evaluate_false(spark, sf):
    return D.evaluate(trade_games(spark, sf), trade_sets(spark, sf), False)


@query
def dnf_partial_eval_true(spark, sf):
    return _terms(D.partial_eval(trade_games(spark, sf), trade_sets(spark, sf), True))


@query
def dnf_partial_eval_false(spark, sf):
    return _terms(D.partial_eval(trade_games(spark, sf), trade_sets(spark, sf), False))


@query
def dnf_partial_eval_complement_true(spark, sf):
    return _terms(D.partial_eval_complement(trade_games(spark, sf), trade_sets(spark, sf), True))


@query
def dnf_partial_eval_complement_false(spark, sf):
    return _terms(D.partial_eval_complement(trade_games(spark, sf), trade_sets(spark, sf), False))


@query
def dnf_touching_terms(spark, sf):
    return _terms(D.touching(trade_games(spark, sf), trade_sets(spark, sf)))


@query
def dnf_not_touching_terms(spark, sf):
    return _terms(D.not_touching(trade_games(spark, sf), trade_sets(spark, sf)))


@query
def dnf_contraction(spark, sf):
    return _terms(D.contraction(trade_games(spark, sf), trade_sets(spark, sf)))


@query
def dnf_conjunction(spark, sf):
    return _terms(D.conjunction(trade_games(spark, sf), other_games(spark, sf)))


@query
def dnf_disjunction(spark, sf):
    return _terms(D.disjunction(trade_games(spark, sf), other_games(spark, sf)))


@query
def dnf_rename_variables(spark, sf):
    games = trade_games(spark, sf)
    halves = D.variables(games).withColumn("new_id", F.expr("owner_id div 2"))
    return _terms(D.rename_variables(games, halves))


# --- decomposition ----------------------------------------------------------------------------


@query
def connected_components(spark, sf):
    return M.owner_components(tuple_dnf(spark, sf))


@query
def or_split(spark, sf):
    return M.or_split(tuple_dnf(spark, sf)).select("game_id", "part", _text("term").alias("term"))


@query
def module_test(spark, sf):
    return M.module_test(trade_games(spark, sf), trade_sets(spark, sf)).select(
        "game_id", _text("members").alias("members"), "is_module")


@query
def module_culprits(spark, sf):
    met = M.meetings(trade_games(spark, sf), trade_sets(spark, sf))
    return M.culprits(met, ["game_id", "members"]).select(
        "game_id", _text("s0").alias("inside"), _text("t0").alias("outside"))


@query
def module_closure_step(spark, sf):
    step = M.closure_step(trade_games(spark, sf), trade_sets(spark, sf).withColumn("seed", F.col("members")))
    return step.select("game_id", "is_module", _text("members").alias("members"))


@query
def module_closure(spark, sf):
    games = tuple_dnf(spark, sf)
    pairs = D.variables(games).groupBy("game_id").agg(F.min("owner_id").alias("a"), F.max("owner_id").alias("b"))
    seeds = pairs.where("a < b").select("game_id", F.array("a", "b").alias("members"))
    return M.closure(games, seeds).select("game_id", _text("members").alias("members"))


@query
def twin_owners(spark, sf):
    return M.twins(tuple_dnf(spark, sf))


def _decomposed(spark, sf) -> T.Decomposition:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trees:
        _trees[key] = T.decompose_shapes(order_games(spark, sf))
    return _trees[key]


_trees: dict[tuple[str, str], T.Decomposition] = {}


@query
def maximal_modules(spark, sf):
    return T.top_modules(_decomposed(spark, sf))


@query
def and_split(spark, sf):
    return T.top_modules(_decomposed(spark, sf)).where("kind = 'and'").select("game_id", "module", "owner_id")


@query
def hybrid_quotient(spark, sf):
    modules, quotient, _ = T.split_once(_decomposed(spark, sf))
    prime = modules.where("kind = 'hybrid'").select("game_id").distinct()
    return _terms(quotient.join(prime, "game_id", "left_semi"))


@query
def one_level_parts(spark, sf):
    _, _, parts = T.split_once(_decomposed(spark, sf))
    return parts.select("game_id", "module", _text("term").alias("term"))


@query
def recursive_tree(spark, sf):
    return T.tree(_decomposed(spark, sf))


@query
def recursive_tree_expanded(spark, sf):
    return _terms(T.expand(_decomposed(spark, sf)))


@query
def recursive_tree_text(spark, sf):
    return T.canonical_text(_decomposed(spark, sf))


@query
def recursive_tree_digest(spark, sf):
    return T.tree_digests(_decomposed(spark, sf))


@query
def recursive_tree_equality(spark, sf):
    """Trees of the orders' games against those of games in which returned lines' parts belong to the next owner."""
    lines = _read(spark, sf, "lineitem").select(
        "l_orderkey", ((F.col("l_suppkey") * 5 + 3) % 8).alias("supplier_owner"),
        ((F.col("l_partkey") * 5 + 5 + (F.col("l_returnflag") == "R").cast("int")) % 8).alias("part_owner"))
    other = T.decompose_shapes(G.group_games(lines, "l_orderkey", ["supplier_owner", "part_owner"]))
    return T.equal_trees(_decomposed(spark, sf), other)


# --- Shapley methods --------------------------------------------------------------------------


@query
def shapley_exhaustive(spark, sf):
    return _rounded(V.exhaustive(trade_games(spark, sf)))


@query
def shapley_permutation(spark, sf):
    return _rounded(V.permutation(tuple_dnf(spark, sf), SAMPLES, seed=1, portable=True))


@query
def shapley_permutation_fast_hash(spark, sf):
    return _rounded(V.permutation(match_dnf(spark, sf), SAMPLES, seed=1))


@query
def linear_test(spark, sf):
    return V.linear_test(trade_games(spark, sf)).select("game_id", "linear", "large", "k", "singles")


@query
def shapley_linear(spark, sf):
    return _rounded(V.linear(tuple_dnf(spark, sf)))


@query
def inclusion_exclusion_value(spark, sf):
    return V.union_value(C.union_states(trade_games(spark, sf))).select("game_id", F.round("value", 6).alias("value"))


@query
def shapley_combination(spark, sf):
    return _rounded(V.combination(trade_games(spark, sf)))


@query
def shapley_lookup(spark, sf):
    return _rounded(V.lookup(trade_games(spark, sf)))


@query
def shapley_form_choice(spark, sf):
    return V.form_choice(trade_games(spark, sf))


@query
def shapley_iusv(spark, sf):
    return _rounded(V.attribute(trade_games(spark, sf), "iusv"))


@query
def shapley_rdsv(spark, sf):
    return _rounded(V.attribute(trade_games(spark, sf), "rdsv"))


@query
def shapley_rdsv_matches(spark, sf):
    return _rounded(V.attribute(match_dnf(spark, sf), "rdsv"))


@query
def shapley_rdsv_tuples(spark, sf):
    return _rounded(V.attribute(tuple_dnf(spark, sf), "rdsv"))


@query
def shapley_rdsv_full_tree(spark, sf):
    return _rounded(T.synthesise(_decomposed(spark, sf)))


def _ablation(name: str) -> Query:
    def run(spark, sf):
        return _rounded(T.synthesise(T.ablate(_decomposed(spark, sf), name)))

    run.__name__ = "shapley_ablation_" + name.replace("-", "_")
    return query(run)


for _kind in T.ABLATIONS:
    _ablation(_kind)


def total_sv(spark: SparkSession, sf: str, method: str = "iusv", **settings) -> DataFrame:
    """(owner_id, sv) over all tuples of the 8-table join: shapes are solved, owners are summed."""
    shapes = cut(G.tuple_shapes(G.lineage(parquet_dataset(spark, sf), texts=True), count_first=True))
    return totals_of_shapes(shapes, method, **settings)


def _attribution(method: str) -> Query:
    def run(spark, sf):
        return total_sv(spark, sf, method).select("owner_id", F.round("sv", 4).alias("sv"))

    run.__name__ = f"tpch_attribution_{method}"
    return query(run)


for _method in ("traditional", "iusv", "rdsv"):
    _attribution(_method)


for _ablation in ("no-horizontal", "no-vertical", "no-hybrid"):
    def _run(spark, sf, _ablation=_ablation):
        return run_attribution(parquet_dataset(spark, sf), "rdsv", ablation=_ablation)[0].select(
            "owner_id", F.round("sv", 4).alias("sv"))

    _run.__name__ = f"tpch_ablation_{_ablation.replace('-', '_')}"
    query(_run)


@query
def tpch_attribution_permutation(spark, sf):
    """Totals from sampled orders; they differ from the exact ones by the sample's error."""
    return total_sv(spark, sf, "permutation", sample_size=SAMPLES, seed=1).select("owner_id", F.round("sv", 4).alias("sv"))


@query
def tpch_attribution_500_owners(spark, sf):
    """Totals of 500 owners, whose games hardly repeat."""
    shapes = cut(G.tuple_shapes(G.lineage(parquet_dataset(spark, sf, owners=500), texts=True)))
    return totals_of_shapes(shapes, "iusv").select("owner_id", F.round("sv", 4).alias("sv"))


@query
def tpch_attribution_uncounted(spark, sf):
    """The same without counting equal games first."""
    shapes = cut(G.tuple_shapes(G.lineage(parquet_dataset(spark, sf), texts=True)))
    return totals_of_shapes(shapes, "iusv").select("owner_id", F.round("sv", 4).alias("sv"))


@query
def trade_attribution(spark, sf):
    return V.total_by_owner(V.attribute(trade_games(spark, sf), "traditional")).select(
        "owner_id", F.round("sv", 4).alias("sv"))


# --- coefficients -----------------------------------------------------------------------------


def _polynomials(spark, sf):
    """The polynomials of both functions of every customer."""
    return tuple(C.union_polynomial(C.union_states(games)) for games in (trade_games(spark, sf), D.minimise(other_games(spark, sf))))


def _counts(poly: DataFrame) -> DataFrame:
    return poly.withColumn("coeff", F.col("coeff").cast("bigint"))


@query
def coefficients_add(spark, sf):
    return _counts(C.add(*_polynomials(spark, sf)))


@query
def coefficients_subtract(spark, sf):
    return _counts(C.subtract(*_polynomials(spark, sf)))


@query
def coefficients_negate(spark, sf):
    return _counts(C.scale(_polynomials(spark, sf)[0], -1))


@query
def coefficients_multiply(spark, sf):
    return _counts(C.multiply(*_polynomials(spark, sf)))


@query
def coefficients_vertical(spark, sf):
    a, b = _polynomials(spark, sf)
    return _counts(C.vertical(C.vertical(a, b), b))


@query
def coefficients_horizontal(spark, sf):
    return _counts(C.horizontal(*_polynomials(spark, sf)))


@query
def coefficients_value(spark, sf):
    a, _ = _polynomials(spark, sf)
    return C.value_of(a).select("game_id", F.round("value", 6).alias("value"))


@query
def leave_one_out_products(spark, sf):
    rows = _read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), "l_linenumber", "l_partkey", "l_suppkey",
        ((F.col("l_partkey") + F.col("l_suppkey")) % 4).alias("factor")).distinct()
    return C.leave_one_out(rows, ["game_id"], "factor").select(
        "game_id", "l_linenumber", "l_partkey", "l_suppkey", F.round("others", 4).alias("others"))


@query
def union_states(spark, sf):
    return C.union_states(trade_games(spark, sf)).select("game_id", _text("members").alias("members"), "coeff")


@query
def union_polynomial(spark, sf):
    return _counts(C.union_polynomial(C.union_states(trade_games(spark, sf))))


def _child_polynomials(games: DataFrame) -> DataFrame:
    """Every owner stands for an OR of two or an AND of two, by parity: 2t − t², or t²."""
    odd = F.array(F.struct(F.lit(1), F.lit(2)), F.struct(F.lit(2), F.lit(-1)))
    even = F.array(F.struct(F.lit(2), F.lit(1)))
    return D.variables(games).select("game_id", F.col("owner_id").alias("child_id"), F.explode(
        F.when(F.col("owner_id") % 2 == 1, odd).otherwise(even)).alias("p")).select(
        "game_id", "child_id", F.col("p.col1").cast("bigint").alias("degree"), F.col("p.col2").cast("bigint").alias("coeff"))


@query
def child_product_coefficients(spark, sf):
    games = trade_games(spark, sf)
    states = games.select("game_id", F.col("term").alias("members"))
    return C.child_products(states, _child_polynomials(games)).select(
        "game_id", _text("members").alias("members"), "degree", F.col("coeff").cast("bigint").alias("coeff"))


@query
def expression_coefficients(spark, sf):
    games = trade_games(spark, sf)
    return _counts(C.expression_polynomial(C.union_states(games), _child_polynomials(games)))


@query
def interaction_coefficients(spark, sf):
    games, other = trade_games(spark, sf), other_games(spark, sf)
    children = _child_polynomials(games.select(*D.KEYS).unionByName(other))
    return _counts(C.interaction_polynomial(C.union_states(games), C.union_states(D.minimise(other)), children))


@query
def interaction_union_states(spark, sf):
    states = C.interaction_states(C.union_states(trade_games(spark, sf)), C.union_states(D.minimise(other_games(spark, sf))))
    return states.select("game_id", _text("members").alias("members"), F.col("coeff").cast("bigint").alias("coeff"))
