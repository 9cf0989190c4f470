import pytest
from pyspark.sql import functions as F

from fairlineage.operators import assign as A
from fairlineage.operators import games as G
from fairlineage.operators import joins as J
from fairlineage.plans import catalog as C
from fairlineage.plans.registry import JoinPlan, plan_for
from fairlineage.sources import tables as I
from fairlineage.sources.samples import parquet_dataset


def test_json_assignment(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "own").mkdir()
    (tmp_path / "data" / "t.csv").write_text("k,v\n10,a\n20,b\n30,c\n")
    (tmp_path / "own" / "t-index.json").write_text("[2, 0, 1]")
    (tmp_path / "own" / "t-owner.json").write_text(
        '{"index":{"0":0,"1":1,"2":2,"3":2},"owner":{"0":7,"1":8,"2":9,"3":7}}')
    ds = I.load_dataset(spark, "x", str(tmp_path / "data"), str(tmp_path / "own"), infer=True)
    assert {r["k"]: r["_row_id"] for r in ds.tables["t"].collect()} == {10: 2, 20: 0, 30: 1}
    assert {(r["row_id"], r["owner_id"]) for r in ds.assignment.collect()} == {(0, 7), (1, 8), (2, 9), (2, 7)}
    assert {r["owner_id"] for r in ds.owners().collect()} == {7, 8, 9}
    lineage = G.lineage(ds, JoinPlan("t", ()))
    assert sorted(r[0] for r in lineage.collect()) == [[7], [7, 9], [8]]


def test_unmatched_key_is_an_error(spark, tmp_path):
    (tmp_path / "t-owner.json").write_text('{"index":{"0":0,"1":1},"owner":{"0":7}}')
    with pytest.raises(Exception, match="unmatched key"):
        I.read_assignment(spark, str(tmp_path / "t-owner.json"), "t").collect()


def test_ownerless_row_is_an_error(spark):
    t = spark.createDataFrame([(0,), (1,)], "_row_id bigint")
    pairs = spark.createDataFrame([("t", 0, 5)], I.ASSIGNMENT_SCHEMA)
    with pytest.raises(Exception, match="no owner"):
        G.lineage(I.Dataset("x", {"t": t}, pairs), JoinPlan("t", ())).collect()


def test_unknown_plan():
    with pytest.raises(KeyError):
        plan_for("nothing")


def test_winner_nulls(spark):
    rows = spark.createDataFrame([(1, 1, None, "h", "a"), (2, None, None, "h", "a"), (3, None, 0, "h", "a"), (4, 2, 1, None, "a")],
                                 "id int, hs bigint, as_ bigint, h string, a string")
    won = G.with_winner(rows, "hs", "as_", "h", "a")
    assert [r["winner"] for r in won.where("id < 4").orderBy("id").collect()] == ["h", "DRAW", "a"]
    with pytest.raises(Exception, match="no name"):
        won.collect()


def test_group_games_skip_nulls(spark):
    rows = spark.createDataFrame([("g", 1, None), ("g", 1, 2), ("h", 3, 4), ("h", 3, 4)], "k string, a bigint, b int")
    got = {(r["game_id"], tuple(r["term"])) for r in G.group_games(rows, "k", ["a", "b"]).collect()}
    assert got == {("g", (1,)), ("h", (3, 4))}


def test_weighted_places(spark):
    n = 4000
    records = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3 + 1).alias("copies"))
    weights = A.zipf_weights(spark.range(1, 6).withColumnRenamed("id", "i"), 1.0)
    p = A.weighted_places(records, weights, 0, "t")
    assert p.count() == p.distinct().count() == records.agg(F.sum("copies")).first()[0]
    first = p.join(records.where("copies = 1"), "row_id").groupBy("place").count().collect()
    share = {r["place"]: r["count"] for r in first}
    total = sum(share.values())
    for i, w in {1: 60 / 137, 2: 30 / 137, 5: 12 / 137}.items():
        assert abs(share[i] / total - w) < 0.05


def test_repair(spark):
    pairs = spark.createDataFrame([(i, i % 2) for i in range(20)], "row_id bigint, owner_id bigint")
    owners = spark.range(7).withColumnRenamed("id", "owner_id")
    fixed = A.repair_starved(pairs, owners)
    assert fixed.count() == 20 and fixed.select("owner_id").distinct().count() == 7


def test_shuffle_is_a_permutation(spark):
    s = A.shuffled_rows(spark.range(500).withColumnRenamed("id", "row_id"), 1, "t").collect()
    assert sorted(r["pos"] for r in s) == sorted(r["row_id"] for r in s) == list(range(500))
    assert [r["row_id"] for r in sorted(s, key=lambda r: r["pos"])] != list(range(500))


def test_plain_join_is_inner(spark):
    from fairlineage.sources.derived import match_dataset
    ds = match_dataset(spark, "/root/testdata/sf0.001")
    plain = J.join_along(ds.tables, plan_for("soccer"), with_assignment=False).count()
    left = J.join_along(ds.tables, plan_for("soccer"), with_assignment=True).count()
    teams = ds.tables["HomeTeam"].select(F.col("team_api_id").alias("home_team_api_id"))
    assert plain < left == ds.tables["Match"].join(teams, "home_team_api_id").count()


def test_lookup_of_hot_rows(spark):
    """A row that is in every tuple is dealt out, and each tuple still finds all its owners once."""
    melted = spark.range(3000).select(F.col("id").alias("game_id"), F.explode(F.array(
        F.struct(F.lit("small").alias("table"), F.lit(0).cast("bigint").alias("row_id")),
        F.struct(F.lit("large").alias("table"), F.col("id").alias("row_id")))).alias("c")).select("game_id", "c.*")
    owners = spark.createDataFrame([("small", 0, 1), ("small", 0, 2)], "table string, row_id bigint, owner_id bigint").unionByName(
        spark.range(2999).select(F.lit("large").alias("table"), F.col("id").alias("row_id"), (F.col("id") % 3).alias("owner_id")))
    found = J.lookup_owners(melted, owners, check=False)
    assert sorted(map(tuple, found.collect())) == sorted(
        [(i, "small", o) for i in range(3000) for o in (1, 2)] + [(i, "large", i % 3) for i in range(2999)])
    with pytest.raises(Exception, match="row id without owner"):
        J.lookup_owners(melted, owners).collect()
    assert {tuple(r) for r in J.count_owners(melted, owners, check=False).collect()} == {
        ("small", 1, 3000), ("small", 2, 3000), ("large", 0, 1000), ("large", 1, 1000), ("large", 2, 999)}
    assert [tuple(r) for r in J.unmatched_rows(melted, owners).collect()] == [("large", 2999, 1)]
    assert J.lookup_owners(melted.limit(0), owners).collect() == []


def test_written_tables_of_many_files(spark, tmp_path):
    folder = str(tmp_path / "old.csv" / "data")
    rows = spark.range(30).select("id", (F.col("id") % 4).alias("v"))
    I.write_csv(rows.repartition(5), f"{folder}/t.csv")
    I.write_csv(rows.where("id < 3").coalesce(1), f"{folder}/u.csv")
    tables = I.read_folder(spark, folder, infer=True)
    assert {n: df.count() for n, df in tables.items()} == {"t": 30, "u": 3}
    assert sorted(r["id"] for r in tables["t"].collect()) == list(range(30))


def test_lineage_shuffles_ids_once_and_joins_from_behind(spark, sf_dir):
    ds, plan = parquet_dataset(spark, sf_dir), plan_for("tpch")
    owned = J.owner_sets(ds.assignment.where("table = 'lineitem'"))
    assert owned._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    keys = {k for s in plan.steps for k in (*s.left_keys, *s.right_keys)}
    narrow = {t: df.select(*[c for c in df.columns if c in keys or c == "_row_id"]) for t, df in ds.tables.items()}
    tables, short = J.fold_tail(narrow, plan)
    assert [s.table for s in short.steps][-1] == "lineitem" and len(plan.steps) - len(short.steps) == 2
    want = J.row_ids(J.join_along(narrow, plan, with_assignment=True))
    got = J.row_ids(J.join_along(tables, short, with_assignment=True)).select(*[f"`{c}`" for c in want.columns])
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    arrays, texts = G.tuple_games(G.lineage(ds)), G.tuple_games(G.lineage(ds, texts=True))
    assert {(str(r[0]), r[1]) for r in arrays.collect()} == {(str(r[0]), r[1]) for r in texts.collect()}


def test_positions_of_a_distinct_table(spark, tmp_path):
    lines = str(tmp_path / "lines")
    spark.range(6000).select((F.col("id") * 7919 % 500).alias("a"), (F.col("id") % 3).alias("b")).repartition(7).write.parquet(lines)
    pairs = spark.read.parquet(lines).distinct()
    assert sorted(r["pos"] for r in I.with_position(pairs).collect()) == list(range(1500))
    made = A.assign_dataset({"t": I.with_position(pairs, "row_id").select("row_id")}, A.AssignmentConfig(owners=20, seed=4))
    assert made.select("row_id").distinct().count() == 1500


def test_positions_are_not_shuffled(spark, tmp_path, capsys):
    path = str(tmp_path / "rows")
    spark.range(9000).select("id").repartitionByRange(5, "id").write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = I.with_position(spark.read.parquet(path), scan=True)
        assert sorted(tuple(r) for r in placed.collect()) == [(i, i) for i in range(9000)]
        capsys.readouterr()
        placed.explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_row_index_needs_no_owner_files(spark, sf_dir, monkeypatch):
    def owners(*args):
        raise AssertionError("owner files were written")

    monkeypatch.setattr(C, "_files", {})
    monkeypatch.setattr(C.W, "assignment_lines", owners)
    rows = C.row_index_attach(spark, sf_dir)
    assert rows.where("row_key <> row_id").count() == 0
    assert rows.groupBy("table_name").count().count() == 8


def test_growing_tables_are_shuffled(spark, sf_dir):
    from fairlineage.sources.derived import trade_rows
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"  # these files are far smaller
    assert "Broadcast" not in trade_rows(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_lineage_of_growing_tables_is_shuffled(spark, sf_dir):
    lineage = G.lineage(parquet_dataset(spark, sf_dir), JoinPlan("partsupp", plan_for("tpch").steps[3:]))
    rows, plan = lineage.collect(), lineage._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_lineage_lookup_joins_the_tables_once(spark, sf_dir):
    """The tuples' ids are read again from a written table; files go without shuffle files left behind."""
    plan = C._melted(spark, sf_dir, written=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan

    def kept():
        return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    folder, before = C._folder(spark), kept()
    I.write_csv(spark.range(50).groupBy((F.col("id") % 3).alias("k")).count(), folder)
    assert kept() <= before
