import hashlib
import math
import random

import numpy as np
import pytest

from fairlineage.llm import shallot
from fairlineage.llm.oracles import SQL

from ..compare import compare


def integer(x):
    return math.floor(x * 64) if abs(x) < 2.0 ** 53 else int(x) * 64


def brute(rows, k, rounds, dims=64):
    kept = [(key, [integer(x) for x in v]) for key, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    mark = lambda key: hashlib.sha256(f"1:{key}".encode()).hexdigest()
    starts = sorted(kept, key=lambda r: (r[0] is None, mark(r[0]) if r[0] is not None else "", r[1]))
    at = [list(v) for _, v in starts[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        at = [[sum(col) // len(own[j]) for col in zip(*own[j])] if j in own else c for j, c in enumerate(at)]
    found = [(key, *nearest(v)) for key, v in kept]
    most = (1 << 63) - 1
    sums = {j: sum(d for _, d, c in found if c == j) for j in range(k)}
    total = min(sum(sums.values()), most)
    return sorted(((key, j, min(d, most), min(sums[j], most), total, hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest())
                   for key, d, j in found), key=str)


def run(frame, k=16, rounds=3):
    return sorted((tuple(r) for r in shallot.clustered(frame, k, rounds).collect()), key=str)


def points(seed, n, groups=9):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 2) for _ in range(64)] for _ in range(groups)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.3))) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("k, rounds", [(16, 3), (5, 0), (1, 2), (40, 6)])
def test_against_all_distances(spark, k, rounds):
    rows = points(k, 300) + [(1000 + i, points(k, 1)[0][1]) for i in range(100)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), k, rounds) == brute(rows, k, rounds)


def test_ties_and_equal_starts(spark):
    """Vectors at equal distances from many centroids, and fewer distinct vectors than centroids."""
    rng = random.Random(2)
    rows = [(i, [rng.choice((0.0, 1 / 64, 2 / 64)) if j < 3 else 0.0 for j in range(64)]) for i in range(200)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)) == brute(rows, 16, 3)


def test_bounds_save_work_and_change_nothing():
    rng = np.random.default_rng(5)
    x = rng.integers(-60, 60, (2000, 64))
    x[:1000] = x[0] + rng.integers(-3, 4, (1000, 64))
    c = shallot.Centroids(x[rng.choice(2000, 12, replace=False)].copy())
    state = None
    for _ in range(5):
        state = shallot.assign(x, c, state)
        d = ((x[:, None] - c.at[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        others = np.where(np.arange(12) == state[0][:, None], np.iinfo(np.int64).max, d).min(1)
        assert (state[2] * (1 + 1e-6) + 1e-6 >= np.sqrt(d.min(1))).all() and (state[3] <= np.sqrt(others) * (1 + 1e-6) + 1e-6).all()
        new = np.array([x[state[0] == j].sum(0) // max((state[0] == j).sum(), 1) if (state[0] == j).any() else c.at[j] for j in range(12)])
        c = c.after(new)


def test_edges(spark, edge_vectors):
    frame, rows = edge_vectors
    assert run(frame) == brute(rows, 16, 3)
    assert run(frame.where("false")) == []
    assert run(frame.where("vec_id > 450"), 2, 1) == brute([r for r in rows if (r[0] or 0) > 450], 2, 1)


def test_unbounded_numbers_keep_their_form():
    x = np.array([[1e30] + [0.25] * 63, [-7.0] * 64])
    numbers = shallot.whole(x)
    assert numbers[0, 0] == int(1e30) * 64 and numbers[1, 5] == -448
    assert shallot.unpacked(shallot.packed(numbers), 64).tolist() == numbers.tolist()


def test_sql(spark, sf_dir):
    from fairlineage.llm.queries import QUERIES

    _, ok, why = compare(spark, sf_dir, "op12_shallot", QUERIES["op12_shallot"], SQL["op12_shallot"])
    assert ok, why
