import random

import pytest
from pyspark.sql import functions as F

from fairlineage.operators import shapley as V
from fairlineage.operators import synthesis as T

from .golden import GAMES, VALUES
from .helpers import brute_force, dnf_table, parse, random_games, substituted_games, values


def expected():
    return {(g, o): v for g, per in VALUES.items() for o, v in per.items()}


def check(sv, want, tolerance=1e-5):
    got = values(sv)
    assert got.keys() == want.keys()
    wrong = {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) > tolerance}
    assert not wrong


@pytest.mark.parametrize("method", ["traditional", "iusv", "rdsv"])
def test_exact_methods(spark, method):
    check(V.attribute(dnf_table(spark, GAMES), method), expected())


@pytest.mark.parametrize("form", [V.combination, V.lookup])
def test_minimal_set_forms(spark, form):
    check(form(dnf_table(spark, GAMES)), expected())


@pytest.mark.parametrize("ablation", list(T.ABLATIONS))
def test_ablations(spark, ablation):
    check(V.attribute(dnf_table(spark, GAMES), "rdsv", ablation=ablation), expected())


def test_random_games(spark):
    rng = random.Random(5)
    games = {**random_games(rng, 60), **substituted_games(rng, 40)}
    want = {(g, o): v for g, text in games.items() for o, v in brute_force(parse(text)).items()}
    dnf = dnf_table(spark, games)
    check(V.exhaustive(dnf), want, 1e-9)
    check(V.minimal_set_method(dnf), want, 1e-9)
    d = T.decompose(dnf)
    check(T.synthesise(d), want, 1e-9)
    for ablation in T.ABLATIONS:
        check(T.synthesise(T.ablate(d, ablation)), want, 1e-9)
    back = T.expand(d)
    assert back.exceptAll(d.dnf).count() == 0 and d.dnf.exceptAll(back).count() == 0


def test_permutation(spark):
    dnf = dnf_table(spark, GAMES)
    sv = V.permutation(dnf, 2000, seed=3)
    sums = {r["game_id"]: r["s"] for r in sv.groupBy("game_id").agg(F.sum("sv").alias("s")).collect()}
    assert all(abs(s - 1) < 1e-9 for s in sums.values()) and sums.keys() == GAMES.keys()
    check(sv, expected(), 0.05)
    assert values(sv) == values(V.permutation(dnf, 2000, seed=3))
    with pytest.raises(ValueError):
        V.attribute(dnf, "permutation")


def test_zero_samples_kept(spark):
    sv = V.permutation(dnf_table(spark, {"g": GAMES["lumpy"]}), 3)
    assert len(values(sv)) == 6


def test_dual_games_have_equal_values(spark):
    from fairlineage.operators import dnf as D
    clauses = spark.createDataFrame(
        [("a", [[1], [2, 3], [3, 4]]), ("b", [[1, 2], [2, 3], [1, 3]]), ("c", [[5, 6], [7, 8]])],
        "game_id string, clauses array<array<bigint>>")
    dual = clauses.select("game_id", F.explode("clauses").alias("term"))
    a, b = values(V.exhaustive(dual)), values(V.exhaustive(D.expand_clauses(clauses)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_lookup_of_many_players(spark):
    """33 owners, all pairs as terms: losing coalitions have one member at most."""
    pairs = dnf_table(spark, {"p": " + ".join(f"{i} {j}" for i in range(33) for j in range(i))})
    for got in (values(V.lookup(pairs)), values(V.attribute(pairs, "iusv"))):
        assert len(got) == 33 and all(abs(v - 1 / 33) < 1e-9 for v in got.values())


def test_too_many_players(spark):
    wide = dnf_table(spark, {"w": " ".join(map(str, range(1, 70)))})
    with pytest.raises(Exception, match="more than"):
        V.exhaustive(wide).collect()
    got = values(V.attribute(wide, "rdsv"))
    assert all(abs(v - 1 / 69) < 1e-12 for v in got.values()) and len(got) == 69


def test_large_game(spark):
    """A game with many owners: OR of many pairs with a common owner."""
    games = {"big": " + ".join(f"0 {i} {i + 1000}" for i in range(1, 301))}
    got = values(V.attribute(dnf_table(spark, games), "rdsv"))
    assert len(got) == 601 and abs(sum(got.values()) - 1) < 1e-9
    assert len({round(v, 12) for (g, o), v in got.items() if o != 0}) == 1


def test_totals(spark):
    sv = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 1.0)], "game_id string, owner_id bigint, sv double")
    n = spark.createDataFrame([("a", 4), ("b", 3)], "game_id string, tuples bigint")
    assert {r["owner_id"]: r["sv"] for r in V.total_by_owner(sv, n).collect()} == {1: 5.0, 2: 2.0}
    assert {r["owner_id"]: r["sv"] for r in V.total_by_owner(sv).collect()} == {1: 1.5, 2: 0.5}


def test_totals_of_many_owners_and_of_samples(spark, sf_dir):
    """Values of 500 owners sum to the tuples; sampled totals lie within four standard errors of the exact ones, taken as
    if all tuples shared the same 1,000 orders."""
    from fairlineage.plans.catalog import QUERIES

    tuples = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    many = [r["sv"] for r in QUERIES["tpch_attribution_500_owners"](spark, sf_dir).collect()]
    assert len(many) == 500 and abs(sum(many) - tuples) < 0.1
    exact = {r["owner_id"]: r["sv"] for r in QUERIES["tpch_attribution_traditional"](spark, sf_dir).collect()}
    drawn = {r["owner_id"]: r["sv"] for r in QUERIES["tpch_attribution_permutation"](spark, sf_dir).collect()}
    error = {o: tuples * (v / tuples * (1 - v / tuples) / 1000) ** 0.5 for o, v in exact.items()}
    assert drawn.keys() == exact.keys() and abs(sum(drawn.values()) - tuples) < 0.1
    assert all(abs(drawn[o] - v) < 4 * error[o] for o, v in exact.items()), (drawn, exact)


def test_permutation_shuffles_terms_not_samples(spark):
    dnf = dnf_table(spark, {"g": "1 2 + 3 + 4 5"})
    plan = V.permutation(dnf, 300, seed=2)._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip() for x in plan.splitlines()]
    assert not [x for x in lines if "Exchange hashpartitioning" in x and "_sample" in x]
    assert not [x for x in lines if x.lstrip("+-:| ").startswith(("Sort ", "SortAggregate")) and "_sample" in x]
    sv = values(V.permutation(dnf, 300, seed=2))
    assert abs(sum(sv.values()) - 1) < 1e-9 and sv["g", 3] > max(v for (_, o), v in sv.items() if o != 3)
