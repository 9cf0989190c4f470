"""Every operator against the same step on Python sets, over random games."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from fairlineage.functions import sets as S
from fairlineage.operators import dnf as D

from .helpers import dnf_table, minimal, parse, sets_table, terms, texts


@pytest.fixture(scope="module")
def games():
    rng = random.Random(41)
    return {f"g{i}": minimal([rng.sample(range(9), rng.randint(1, 4)) for _ in range(rng.randint(1, 6))]) for i in range(25)}


@pytest.fixture(scope="module")
def picks(games):
    rng = random.Random(43)
    return {g: frozenset(rng.sample(range(9), rng.randint(1, 5))) for g in games}


def table(spark, games):
    rows = [(g, sorted(t)) for g, ts in games.items() for t in ts]
    return spark.createDataFrame(rows, "game_id string, term array<bigint>")


def same(df, want):
    assert texts(df) == {g: {tuple(sorted(t)) for t in ts} for g, ts in want.items() if ts}


def test_minimise(spark):
    rng = random.Random(1)
    raw = {f"g{i}": [rng.sample(range(16), rng.choice([1, 2, 3, 5, 12, 13])) for _ in range(12)] for i in range(20)}
    raw["true"] = [[], [3], [3, 4]]
    raw["copies"] = [[5, 6], [6, 5], [5, 6, 7]]
    same(D.minimise(table(spark, {g: [frozenset(t) for t in ts] for g, ts in raw.items()})), {g: minimal(ts) for g, ts in raw.items()})


def test_algebra(spark, games):
    names = sorted(games)
    other = {a: games[b] for a, b in zip(names, reversed(names))}
    a, b = table(spark, games), table(spark, other)
    same(D.conjunction(a, b), {g: minimal([s | t for s, t in product(games[g], other[g])]) for g in games})
    same(D.disjunction(a, b), {g: minimal(list(games[g]) + list(other[g])) for g in games})
    new = {o: o // 2 for o in range(6)}
    mapping = spark.createDataFrame([(g, o, n) for g in games for o, n in new.items()], "game_id string, owner_id bigint, new_id bigint")
    same(D.rename_variables(a, mapping), {g: {frozenset(new.get(o, o) for o in t) for t in ts} for g, ts in games.items()})


def test_evaluation(spark, games, picks):
    dnf, sets = table(spark, games), sets_table(spark, picks)
    for value, worth in ((True, lambda t, s: t <= s), (False, lambda t, s: not t & s)):
        got = {r["game_id"]: r["result"] for r in D.evaluate(dnf, sets, value).collect()}
        assert got == {g: any(worth(t, picks[g]) for t in ts) for g, ts in games.items()}


def test_restriction(spark, games, picks):
    dnf, sets = table(spark, games), sets_table(spark, picks)
    every = frozenset(range(9))
    for fix, step in ((lambda g: picks[g], D.partial_eval), (lambda g: every - picks[g], D.partial_eval_complement)):
        same(step(dnf, sets, True), {g: minimal([t - fix(g) for t in ts]) for g, ts in games.items()})
        same(step(dnf, sets, False), {g: {t for t in ts if not t & fix(g)} for g, ts in games.items()})


def test_parts(spark, games, picks):
    dnf, sets = table(spark, games), sets_table(spark, picks)
    touched = {g: {t for t in ts if t & picks[g]} for g, ts in games.items()}
    same(D.touching(dnf, sets), touched)
    same(D.not_touching(dnf, sets), {g: ts - touched[g] for g, ts in games.items()})
    same(D.contraction(dnf, sets), {g: minimal([t & picks[g] for t in ts]) for g, ts in touched.items()})


def test_constants(spark):
    names = spark.createDataFrame([("a",), ("b",)], "game_id string")
    assert texts(D.constant_true(names)) == {"a": {()}, "b": {()}} and texts(D.constant_false(names)) == {}
    owned = spark.createDataFrame([("a", 4), ("b", 6)], "game_id string, owner_id bigint")
    assert texts(D.single_variable(owned)) == {"a": {(4,)}, "b": {(6,)}}


def test_text_and_kinds(spark):
    games = {"always": "TRUE", "own": "8", "both": "8 12", "either": "6 9 + 5"}
    dnf = dnf_table(spark, games)
    assert {r[0]: r[1] for r in D.text_form(dnf).collect()} == {"always": "TRUE", "own": "8", "both": "8 12", "either": "5 + 6 9"}
    names = spark.createDataFrame([(g,) for g in [*games, "never"]], "game_id string")
    got = {r["game_id"]: (r["is_true"], r["is_false"], r["is_variable"]) for r in D.kinds(dnf, names).collect()}
    assert got == {"always": (True, False, False), "own": (False, False, True), "both": (False,) * 3, "either": (False,) * 3,
                   "never": (False, True, False)}


def test_expand_clauses(spark):
    rng = random.Random(7)
    games = {f"g{i}": [rng.sample(range(8), rng.randint(1, 3)) for _ in range(n)] for i, n in enumerate((1, 2, 4, 6, 9, 10))}
    games["empty"] = [[1, 2], []]
    clauses = spark.createDataFrame(list(games.items()), "game_id string, clauses array<array<bigint>>")
    got = D.expand_clauses(clauses)
    same(got, {g: minimal([frozenset(p) for p in product(*cs)]) if all(cs) else set() for g, cs in games.items()})
    assert texts(D.from_pairs(D.to_pairs(got))) == texts(got)
    assert D.variables(clauses.select("game_id", F.explode("clauses").alias("term"))).where("game_id = 'empty'").count() == 2
    assert parse("FALSE") == []


def test_owner_cells_count_by_declared_type(spark):
    rows = spark.createDataFrame([(3, "17", 2.7, 5), (None, "4", 1.0, 3)], "a int, b string, c double, d bigint")
    got = [r[0] for r in rows.select(S.owner_set(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [[3, 5], [3]]
    assert terms("1 2") == {(1, 2)}


def test_minimise_of_few_owners_joins_no_terms(spark):
    small = {"a": "1 + 1 2 + 2 3", "b": "TRUE + 4", "c": "5 6 + 5 6 7 + 7 8"}
    wide = {"w": "1 2 + 1 2 3 + " + " + ".join(str(o) for o in range(4, 16)) + " + 1 15"}
    got = D.minimise(dnf_table(spark, small))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert texts(got) == {"a": {(1,), (2, 3)}, "b": {()}, "c": {(5, 6), (7, 8)}}
    both = texts(D.minimise(dnf_table(spark, {**small, **wide})))
    assert both["w"] == {(1, 2), *((o,) for o in range(4, 16))} and both["a"] == {(1,), (2, 3)}
