import random
from decimal import Decimal
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from fairlineage.operators import coefficients as C

from .helpers import dnf_table, parse, random_games


def poly(spark, coeffs, game="g"):
    return spark.createDataFrame([(game, d, c) for d, c in coeffs.items()], "game_id string, degree bigint, coeff bigint")


def got(df):
    return {r["degree"]: r["coeff"] for r in df.collect()}


def children(spark, polys):
    return spark.createDataFrame([("g", i, d, c) for i, p in enumerate(polys) for d, c in p.items()],
                                 "game_id string, child_id bigint, degree bigint, coeff bigint")


def test_arithmetic(spark):
    a, b = poly(spark, {1: 1, 2: 2}), poly(spark, {1: 3, 2: 4})
    assert got(C.multiply(a, b)) == {2: 3, 3: 10, 4: 8}
    assert got(C.add(a, b)) == {1: 4, 2: 6} and got(C.subtract(b, a)) == {1: 2, 2: 2}
    assert got(C.horizontal(poly(spark, {1: 1}), poly(spark, {1: 1}))) == {1: 2, 2: -1}
    assert got(C.vertical(poly(spark, {0: 1}), a)) == {1: 1, 2: 2}
    assert C.value_of(a).first()["value"] == 2.0


def test_no_polynomial_is_broadcast(spark):
    p = spark.range(4).selectExpr("id div 2 as game_id", "id % 2 + 1 as degree", "id + 1 as coeff")
    for made in (C.multiply(p, p), C.vertical(p, p), C.horizontal(p, p)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r["game_id"], r["degree"], int(r["coeff"])) for r in C.multiply(p, p).collect()} == {
        (0, 2, 1), (0, 3, 4), (0, 4, 4), (1, 2, 9), (1, 3, 24), (1, 4, 16)}


def times(*polys):
    out = {0: 1}
    for p in polys:
        new = {}
        for (d, c), (e, f) in product(out.items(), p.items()):
            new[d + e] = new.get(d + e, 0) + c * f
        out = new
    return out


def put_in(term_list, polys):
    """Inclusion-exclusion over all sets of terms, with the members' polynomials multiplied."""
    out = {}
    for k in range(1, len(term_list) + 1):
        for chosen in combinations(term_list, k):
            for d, c in times(*[polys[i] for i in set().union(*chosen)]).items():
                out[d] = out.get(d, 0) + (c if k % 2 else -c)
    return {d: c for d, c in out.items() if c}


def test_expressions(spark):
    polys = [{1: 2}, {1: 1, 3: -1}, {2: 5, 3: 1}, {1: -3, 2: 4}, {4: 1}, {1: 1}, {1: 7}, {2: 2}, {1: 1, 2: 1}, {1: 3}]
    table = children(spark, polys)
    for text in ("0 1", "0 1 + 1 2 + 3", "2 3 4 + 0 4", "0 1 2 3 4 5 6 7 8 + 9"):
        states = C.union_states(dnf_table(spark, {"g": text}))
        assert got(C.expression_polynomial(states, table)) == put_in([set(t) for t in parse(text)], polys)
    a, b = "0 + 2 3", "1 2 + 4"
    both = [set(s) | set(t) for s, t in product(parse(a), parse(b))]
    a, b = (C.union_states(dnf_table(spark, {"g": t})) for t in (a, b))
    assert got(C.interaction_polynomial(a, b, table)) == put_in(both, polys)


def test_leave_one_out(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in range(1, 6)] + [("z", 0.0), ("z", 2.0), ("z", 3.0)],
                                 "game_id string, v double")
    out = {(r["game_id"], r["v"]): r["others"] for r in C.leave_one_out(rows, ["game_id"], "v").collect()}
    assert all(abs(out["g", float(v)] - 120 / v) < 1e-9 for v in range(1, 6))
    assert (out["z", 0.0], out["z", 2.0], out["z", 3.0]) == (6.0, 0.0, 0.0)


def test_wide_coefficients(spark):
    a = poly(spark, {1: 1 << 40})
    assert got(C.multiply(a, a)) == {2: 1 << 80}
    ones = poly(spark, {0: 1, 1: 1})
    power = ones
    for _ in range(99):
        power = C.multiply(power, ones, drop_constant=False)
        if _ % 20 == 19:
            power = spark.createDataFrame(power.collect(), power.schema)
    assert got(power)[50] == 100891344545564193334812497256  # C(100, 50)
    huge = spark.createDataFrame([("g", 1, Decimal(10 ** 37))], "game_id string, degree bigint, coeff decimal(38,0)")
    with pytest.raises(Exception, match="(?i)38|overflow|represented"):
        C.multiply(huge, huge).collect()


def test_states_of_one_large_game(spark):
    """24 terms: states reported by round, spread over tasks, and those with all owners gone before the end."""
    rng = random.Random(3)
    ts = set()
    while len(ts) < 24:
        ts.add(tuple(sorted(rng.sample(range(10), 4))))
    sizes = []
    states = C.union_states(dnf_table(spark, {"g": " + ".join(" ".join(map(str, t)) for t in ts)}), sizes)
    got_ = {tuple(r["members"]): r["coeff"] for r in states.collect()}
    worth = lambda m: any(set(t) <= m for t in ts)
    for k in range(1, 11):
        for u in combinations(range(10), k):
            want = sum((-1) ** (k - j) * worth(set(c)) for j in range(k + 1) for c in combinations(u, j))
            assert got_.get(u, 0) == want
    assert len(sizes) >= 6 and max(sizes) <= 1 << 10


def test_no_numbering_of_a_whole_game(spark):
    plan = C._blocks(dnf_table(spark, {"g": "1 2 + 3"}))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(game_id" in plan and "_k" in plan.split("windowspecdefinition(game_id")[1][:40]


def test_listed_states_equal_multiplied_ones(spark):
    rng = random.Random(4)
    games = {**random_games(rng, 60, owners=10, terms=9), "true": "TRUE", "wide": " + ".join(f"{i} {i + 1}" for i in range(11)),
             "far": "-9000000000 7 + 7 9000000000 + -9000000000 9000000000"}
    dnf = dnf_table(spark, games)
    rows = lambda df: sorted((r["game_id"], tuple(r["members"]), r["coeff"]) for r in df.collect())
    states = C.union_states(dnf)
    assert rows(states) == rows(C._multiplied(dnf))
    # states of small games are not joined with factors, round by round
    small = C.union_states(dnf.where("game_id <> 'wide'"))
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString()
    nested = C.union_states(dnf.select(F.struct("game_id", F.lit(3).alias("rep")).alias("game_id"), "term"))
    assert rows(nested.select("game_id.game_id", "members", "coeff")) == rows(states)


def test_listed_products_equal_joined_ones(spark):
    states = spark.createDataFrame([("g", [1, 2]), ("g", [2]), ("g", [1, 2, 3]), ("g", []), ("h", [1]), ("w", list(range(12)))],
                                   "game_id string, members array<bigint>")
    polys = [("g", 1, 1, 2), ("g", 1, 2, -1), ("g", 2, 2, 1), ("g", 2, 2, 4), ("h", 1, 1, 1), ("h", 1, 1, -1)]
    polys += [("w", i, 1, 1 << 8) for i in range(12)]
    kids = spark.createDataFrame(polys, "game_id string, child_id bigint, degree bigint, coeff bigint")
    rows = lambda df: sorted((r["game_id"], tuple(r["members"]), r["degree"], r["coeff"]) for r in df.collect())
    assert rows(C.child_products(states, kids)) == rows(C._joined_products(states, kids))
    few = C.child_products(states.where("game_id <> 'w'"), kids)
    assert "_child" not in few._jdf.queryExecution().executedPlan().toString()
    big = spark.createDataFrame([("g", i, 1, Decimal(10 ** 20)) for i in (1, 2)], "game_id string, child_id bigint, degree bigint, coeff decimal(38,0)")
    with pytest.raises(Exception, match="(?i)38|precision"):
        C.child_products(states.where("game_id = 'g'"), big).collect()


def test_products_of_a_game_are_summed_where_they_are_made(spark):
    """Also where 64 bits do not suffice; no side is sent through the driver and no product is shuffled."""
    states = spark.createDataFrame(
        [("a", [1, 2], 3), ("a", [2, 3], -1), ("a", [1, 2], 2), ("b", [1], 1 << 61), ("c", [9], 1)], "game_id string, members array<bigint>, coeff bigint")
    children = spark.createDataFrame(
        [("a", 1, 1, 2), ("a", 1, 2, -1), ("a", 2, 1, 1), ("a", 3, 0, 4), ("b", 1, 3, 1 << 40), ("b", 8, 1, 1)],
        "game_id string, child_id bigint, degree bigint, coeff bigint")
    poly = C.expression_polynomial(states, children)
    plan = poly._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "degree" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    assert {(r["game_id"], r["degree"]): int(r["coeff"]) for r in poly.collect()} == {
        ("a", 1): -4, ("a", 2): 10, ("a", 3): -5, ("b", 3): 1 << 101}


def test_interaction_states_of_small_games_are_not_paired_in_a_join(spark):
    """Also where a game has too many owners for a row, or too large a coefficient."""
    rng = random.Random(4)
    wide = list(range(20, 33))
    rows = {k: [(g, sorted(rng.sample(pool, rng.randint(1, 3))), rng.choice([-2, -1, 1, 3]) * big)
                for g, pool, big in (("a", range(6), 1), ("b", range(8), 1), ("w", wide, 1), ("c", range(4), 1 << 30)) for _ in range(7)]
            for k in "xy"}
    a, b = (spark.createDataFrame(rows[k], "game_id string, members array<bigint>, coeff bigint") for k in "xy")
    want = {}
    for g, s, c in rows["x"]:
        for h, t, e in rows["y"]:
            if g == h:
                key = (g, tuple(sorted({*s, *t})))
                want[key] = want.get(key, 0) + c * e
    got = {(r["game_id"], tuple(r["members"])): int(r["coeff"]) for r in C.interaction_states(a, b).collect()}
    assert got == {k: c for k, c in want.items() if c}
    small = C.interaction_states(a.where("game_id < 'c'"), b.where("game_id < 'c'"))
    assert "_part" not in small._jdf.queryExecution().optimizedPlan().toString()
