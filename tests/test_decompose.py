import random
from itertools import combinations, product

from pyspark.sql import functions as F

from fairlineage.operators import modules as M
from fairlineage.operators import synthesis as T

from .golden import GAMES
from .helpers import dnf_table, parse, random_games, sets_table, terms, texts


def test_components(spark):
    games = {"a": "2 9 + 5 9 + 3 4 + 8", "b": "1 6 + 1 7 + 2 6 + 2 7",
             "chain": " + ".join(f"{i} {i + 1}" for i in range(1, 40))}
    parts = {}
    for r in M.owner_components(dnf_table(spark, games)).collect():
        parts.setdefault((r["game_id"], r["part"]), set()).add(r["owner_id"])
    assert parts == {("a", 2): {2, 5, 9}, ("a", 3): {3, 4}, ("a", 8): {8}, ("b", 1): {1, 2, 6, 7}, ("chain", 1): set(range(1, 41))}


def is_module(ts, s):
    """Terms that touch s, cut to s and outside s, combine freely."""
    touching = [t for t in ts if t & s]
    return all((a & s) | (b - s) in ts for a in touching for b in touching)


def test_modules_against_brute_force(spark):
    games = {k: {frozenset(t) for t in parse(v)} for k, v in {
        "m": "1 2 7 + 1 3 7 + 2 3 7 + 5 7 + 6", "n": "1 4 + 2 5 + 1 3 5 + 2 3 4", "o": "1 2 8 9 + 3 8 9 + 1 2 4"}.items()}
    asked = {"m": [{1, 2, 3}, {1, 2}, {1, 2, 3, 5}, {7, 6}], "n": [{1, 2}, {3}, {4, 5}, {1, 2, 3, 4, 5}], "o": [{1, 2}, {8, 9}, {1, 8}, {3, 4}]}
    dnf = dnf_table(spark, {g: " + ".join(" ".join(map(str, sorted(t))) for t in ts) for g, ts in games.items()})
    for i in range(4):
        got = {r["game_id"]: r["is_module"] for r in M.module_test(dnf, sets_table(spark, {g: a[i] for g, a in asked.items()})).collect()}
        assert got == {g: is_module(games[g], frozenset(a[i])) for g, a in asked.items()}
    rows = [(g, i, sorted(s)) for g, a in asked.items() for i, s in enumerate(a)]
    seeds = spark.createDataFrame(rows, "game_id string, seed int, members array<bigint>")
    for r in M.closure(dnf, seeds).collect():
        ts, seed = games[r["game_id"]], asked[r["game_id"]][r["seed"]]
        owners = sorted(frozenset().union(*ts) - seed)
        larger = [frozenset(seed) | set(c) for k in range(len(owners) + 1) for c in combinations(owners, k)]
        assert frozenset(r["members"]) == next(m for m in larger if is_module(ts, m))


def test_trees(spark):
    # two of (a, b, c), where a is 3, b is two of (6, 7, 8), c is 9 or both of 4 and 5
    inner = {"3": ["3"], "b": ["6 7", "6 8", "7 8"], "c": ["9", "4 5"]}
    nested = " + ".join(f"{x} {y}" for p, q in (("3", "b"), ("3", "c"), ("b", "c")) for x in inner[p] for y in inner[q])
    games = {"x": nested, "y": "1 6 + 1 7 + 2 6 + 2 7", "z": "2 + 4 + 6", "v": "5", **GAMES}
    dnf = dnf_table(spark, games)
    d = T.decompose(dnf)
    text = {r["game_id"]: r["text"] for r in T.canonical_text(d).collect()}
    assert text["x"] == "hybrid[3, hybrid[6, 7, 8], or[9, and[4, 5]]]"
    assert text["y"] == "and[or[1, 2], or[6, 7]]"
    assert text["z"] == "or[2, 4, 6]" and text["v"] == "5"
    modules, quotient, parts = T.split_once(d)
    top = {}
    for r in modules.where("game_id = 'x'").collect():
        top.setdefault(r["module"], set()).add(r["owner_id"])
        assert r["kind"] == "hybrid"
    assert top == {3: {3}, 4: {4, 5, 9}, 6: {6, 7, 8}}
    assert texts(quotient)["x"] == terms("3 4 + 3 6 + 4 6")
    found = texts(parts.where("game_id = 'x'").select(F.col("module").cast("string").alias("game_id"), "term"))
    assert found == {"3": terms("3"), "4": terms("9 + 4 5"), "6": terms("6 7 + 6 8 + 7 8")}
    assert texts(T.expand(d)) == {g: terms(t) for g, t in games.items()}


def test_equal_trees_whatever_the_rounds(spark):
    """A digest is the same for the same tree and another one for another kind or another owner."""
    games = {"x": "1 6 + 1 7 + 2 6 + 2 7", "y": "1 2 + 2 3 + 1 3", "z": "2 + 4", "v": "5", "w": "1 2 3 + 4"}
    other = games | {"x": "1 6 + 1 7 + 2 6 + 2 8", "y": "1 2 3", "w": "1 2 4 + 3"}
    a, b = T.decompose(dnf_table(spark, games)), T.decompose(dnf_table(spark, other | {"more": "1"}), search_above=12)
    got = {r["game_id"]: r["equal"] for r in T.equal_trees(a, b).collect()}
    assert got == {"x": False, "y": False, "z": True, "v": True, "w": False, "more": False}
    counted = {r["game_id"]: r["nodes"] for r in T.tree_digests(a).collect()}
    assert counted == {"x": 7, "y": 4, "z": 3, "v": 1, "w": 6}
    names = {(r["node_id"], r["parent_id"], r["kind"]) for r in T.tree(a).where("game_id = 'w'").collect()}
    assert names == {("1/4", None, "or"), ("1/3", "1/4", "and"), ("owner:4", "1/4", "var"), *(
        (f"owner:{i}", "1/3", "var") for i in (1, 2, 3))}


def test_culprits_against_all_pairs(spark):
    """Also where smaller terms fit into pairs that do not occur, so that a run's first pairs give way."""
    rng = random.Random(12)
    games = random_games(rng, 60, owners=8, terms=9)
    games["fits"] = "1 9 + 1 2 6 7 8 + 3 9"
    sets = {g: sorted(rng.sample(range(1, 9), 3)) for g in games} | {"fits": [1, 2, 3]}
    met = M.meetings(dnf_table(spark, games), sets_table(spark, sets))
    got = {r["game_id"]: (tuple(r["s0"]), tuple(r["t0"])) for r in M.culprits(met, ["game_id", "members"]).collect()}
    for g, text in games.items():
        a = set(sets[g])
        parts = [(tuple(sorted(set(t) & a)), tuple(sorted(set(t) - a))) for t in parse(text) if set(t) & a]
        lacking = [(len(s) + len(t), s, t) for s in {p[0] for p in parts} for t in {p[1] for p in parts}
                   if not any(set(x) <= set(s) and set(y) <= set(t) for x, y in parts)]
        assert got.get(g) == (min(lacking)[1:] if lacking else None)
    plan = M._fitted(met.select("game_id", "members", "s", "t"), met, ["game_id", "members"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def _owners(text):
    return sorted({o for t in parse(text) for o in t})


def _nested(rng, outer, inner):
    """A function with some variables replaced by functions, and owners named by chance."""
    names = rng.sample(range(1, 100), 30)
    where = rng.sample(_owners(outer), len(inner))
    part = {v: [frozenset([names[v]])] for v in _owners(outer)}
    for i, (v, f) in enumerate(zip(where, inner)):
        part[v] = [frozenset(names[6 + 6 * i + o] for o in t) for t in parse(f)]
    ts = {frozenset().union(*c) for t in parse(outer) for c in product(*(part[v] for v in t))}
    return " + ".join(" ".join(map(str, sorted(t))) for t in sorted(ts, key=sorted))


def test_seeds_reach_every_least_module(spark):
    """A seed lies in each inclusion-minimal module of more than one owner; games without twins only."""
    rng = random.Random(5)
    prime = ["1 2 + 2 3 + 1 3", "1 2 + 2 3 + 3 4", "1 2 + 2 3 + 3 4 + 4 5 + 1 5", "1 4 + 2 5 + 1 3 5 + 2 3 4"]
    games = {f"n{i}": _nested(rng, rng.choice(prime), [rng.choice(prime) for _ in range(rng.randint(1, 2))]) for i in range(20)}
    games |= {f"r{i}": g for i, g in enumerate(random_games(rng, 40, owners=8, terms=8).values())}
    # equal for all owners: three of seven, and two of three whose third is three of five
    games["same"] = " + ".join(" ".join(map(str, c)) for c in combinations(range(1, 8), 3))
    games["inner"] = "1 2 + " + " + ".join(f"{a} {' '.join(map(str, c))}" for a in (1, 2) for c in combinations(range(3, 8), 3))
    asked = {}
    for g, text in games.items():
        ts, owners = {frozenset(t) for t in parse(text)}, _owners(text)
        if len(owners) > 11:
            continue
        found = []
        for k in range(2, len(owners)):
            for c in map(frozenset, combinations(owners, k)):
                if not any(m < c for m in found) and is_module(ts, c):
                    found.append(c)
        if not any(len(m) == 2 for m in found):  # two owners that are a module are twins
            asked[g] = found
    assert sum(bool(f) for f in asked.values()) >= 15 and {"same", "inner"} <= set(asked)
    seeds = {}
    for r in M.module_seeds(dnf_table(spark, {g: games[g] for g in asked})).collect():
        seeds.setdefault(r["game_id"], []).append(frozenset(r["members"]))
    for g, found in asked.items():
        assert all(any(s <= m for s in seeds.get(g, [])) for m in found), g
    # only where two owners cannot be told apart by shares do all pairs stand in
    assert sum(map(len, seeds.values())) - len(seeds["same"]) - len(seeds["inner"]) <= 2 * sum(len(_owners(games[g])) for g in asked)


def test_ring_has_few_seeds(spark):
    """A ring of 40 owners is prime; so is one with a ring of 12 in place of an owner, but for that module."""
    ring = [(i, i % 40 + 1) for i in range(1, 41)]
    inside = [(100 + i, 100 + (i + 1) % 12) for i in range(12)]
    nested = [t for t in ring if 1 not in t] + [(o, *p) for t in ring if 1 in t for o in t if o != 1 for p in inside]
    games = {"ring": " + ".join(f"{a} {b}" for a, b in ring), "nested": " + ".join(" ".join(map(str, sorted(t))) for t in nested)}
    dnf = dnf_table(spark, games)
    count = {r["game_id"]: r["count"] for r in M.module_seeds(dnf).groupBy("game_id").count().collect()}
    assert count["ring"] <= 40 and count["nested"] <= 52, count
    found = {r["game_id"]: set(r["members"]) for r in M.prime_modules(dnf).collect()}
    assert found == {"ring": set(range(1, 41)), "nested": set(range(100, 112))}


def test_games_of_one_shape_come_apart_once(spark):
    from .helpers import substituted_games, values

    rng = random.Random(77)
    games = substituted_games(rng, 3)
    ring = {"ring": " + ".join(f"{o} {o % 13 + 1}" for o in range(1, 14))}  # more owners than are listed
    renamed = {f"{g}/{k}": " + ".join(" ".join(str(int(o) * 7 % 31 + k) for o in t.split()) for t in text.split(" + "))
               for g, text in {**games, "small": "1 2 + 2 3 + 3 4 + 5"}.items() for k in range(4)}
    dnf = dnf_table(spark, {**renamed, **ring, "one": "5"})
    one_by_one, shared = T.decompose(dnf), T.decompose_shapes(dnf)
    listed = {g for g, text in renamed.items() if len(set(text.replace("+", "").split())) <= 10} | {"one"}
    shapes = {r["game_id"]: r["shape"] for r in shared.names.select("game_id", "shape").distinct().collect()}
    assert len({shapes[g] for g in listed}) < len(listed) and len({shapes[f"small/{k}"] for k in range(4)}) == 1
    for show in (T.tree, T.tree_digests, T.top_modules, T.expand, T.canonical_text):
        rows = [sorted(str(sorted(r.asDict().items())) for r in show(d).collect()) for d in (one_by_one, shared)]
        assert rows[0] == rows[1], show.__name__
    want, got = values(T.synthesise(one_by_one)), values(T.synthesise(shared))
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_values_of_trees_are_made_row_by_row(spark):
    """Node values of union states and elements are not shuffled, whether a game has few owners or its tree fits a row."""
    from fairlineage.operators.listed_trees import values as listed_values

    from .helpers import brute_force, values

    rng = random.Random(8)
    games = {k: " + ".join(" ".join(map(str, sorted(t))) for t in sorted(map(sorted, m))) for k, m in
             ((k, {frozenset(t) for t in parse(v)}) for k, v in random_games(rng, 25, owners=8, terms=9).items())}
    few = T.decompose(dnf_table(spark, games | {"one": "7"}), search_above=12)
    found = listed_values(few.rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = values(T.synthesise(few))
    want = {(g, o): v for g, text in (games | {"one": "7"}).items() for o, v in brute_force(parse(text)).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    wide = T.decompose(dnf_table(spark, {"w": " + ".join(f"1 {i} {i + 20}" for i in range(2, 9)), "v": "1 2 + 2 3 + 1 3"}))
    got, want = values(T.synthesise(wide)), values(T._by_steps(wide))
    assert wide.wide and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_written_table_leaves_no_shuffle_files(spark):
    from fairlineage.session import cut

    def kept():
        return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    before = kept()
    assert cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert kept() <= before + 1  # that of the count itself
