"""Brute force and table helpers for small games."""

from itertools import combinations
from math import factorial

from pyspark.sql import functions as F


def parse(text):
    if text == "FALSE":
        return []
    return [sorted(int(o) for o in t.split()) if t != "TRUE" else [] for t in text.split(" + ")]


def dnf_table(spark, games):
    rows = [(g, t) for g, text in games.items() for t in parse(text)]
    return spark.createDataFrame(rows, "game_id string, term array<bigint>")


def sets_table(spark, sets):
    return spark.createDataFrame([(g, sorted(s)) for g, s in sets.items()], "game_id string, members array<bigint>")


def texts(dnf):
    """game → set of terms."""
    out = {}
    for r in dnf.collect():
        out.setdefault(r["game_id"], set()).add(tuple(r["term"]))
    return out


def terms(text):
    return {tuple(t) for t in parse(text)}


def values(sv):
    return {(r["game_id"], r["owner_id"]): r["sv"] for r in sv.collect()}


def minimal(sets):
    sets = {frozenset(s) for s in sets}
    return {s for s in sets if not any(r < s for r in sets)}


def brute_force(term_list):
    ts = [frozenset(t) for t in term_list]
    players = sorted(set().union(*ts)) if ts else []
    n = len(players)
    worth = lambda c: any(t <= c for t in ts)
    out = {}
    for i in players:
        rest = [p for p in players if p != i]
        out[i] = sum(
            factorial(k) * factorial(n - k - 1) / factorial(n) * (worth(frozenset(c) | {i}) - worth(frozenset(c)))
            for k in range(n) for c in combinations(rest, k))
    return out


def random_games(rng, count, owners=7, terms=6):
    games = {}
    for i in range(count):
        n, m = rng.randint(1, owners), rng.randint(1, terms)
        ts = minimal([rng.sample(range(1, n + 1), rng.randint(1, min(n, 4))) for _ in range(m)])
        games[f"r{i}"] = " + ".join(" ".join(map(str, sorted(t))) for t in sorted(ts, key=sorted))
    return games


def substituted_games(rng, count):
    """Games with nested modules: variables of a prime function replaced by functions."""
    outer = ["1 2 + 2 3 + 1 3", "1 2 + 2 3 + 3 4", "1 4 + 2 5 + 1 3 5 + 2 3 4"]
    inner = ["{a}", "{a} {b}", "{a} + {b}", "{a} {b} + {b} {c} + {a} {c}", "{a} {b} + {c}"]
    games = {}
    for i in range(count):
        shape = parse(rng.choice(outer))
        names = iter(range(1, 100))
        part = {}
        for v in sorted({x for t in shape for x in t}):
            a, b, c = (next(names) for _ in range(3))
            part[v] = parse(rng.choice(inner).format(a=a, b=b, c=c))
        ts = set()
        for t in shape:
            picks = [frozenset()]
            for v in t:
                picks = [p | frozenset(q) for p in picks for q in part[v]]
            ts |= set(picks)
        games[f"s{i}"] = " + ".join(" ".join(map(str, sorted(t))) for t in sorted(minimal(ts), key=sorted))
    return games


def rounded(df, digits=6):
    return df.withColumn("sv", F.round("sv", digits))
