import math
import random

import numpy as np
import pytest

from fairlineage.llm import block_join
from fairlineage.llm.oracles import SQL

from ..compare import compare


def cosine(a, b):
    ea, eb = (math.frexp(max(map(abs, v)))[1] for v in (a, b))
    dot = na = nb = 0.0
    for x, y in zip(a, b):
        x, y = math.ldexp(x, -ea), math.ldexp(y, -eb)
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    return max(-1.0, min(1.0, dot / math.sqrt(na * nb)))


def brute(rows, k, every):
    good = [(key, v) for key, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, (key, v) in enumerate(good):
        if key is None or key % every:
            continue
        near = sorted((-cosine(v, w), other is None, other or 0) for j, (other, w) in enumerate(good) if j != i and len(w) == len(v))[:k]
        out += [(key, r + 1, None if missing else other, -s) for r, (s, missing, other) in enumerate(near)]
    return sorted(out, key=str)


def run(frame, k=5, every=50):
    return sorted((tuple(r) for r in block_join.nearest_by_cosine(frame, k, every).collect()), key=str)


def vectors(seed, n, dims, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("spread", [1.0, 0.01, 1e-7])
def test_against_all_pairs(spark, monkeypatch, spread):
    """Far, near and almost equal vectors, in several blocks and slices."""
    monkeypatch.setattr(block_join, "LEAST_BLOCK", 64)
    monkeypatch.setattr(block_join, "BLOCK", 1)
    rows = vectors(1, 300, 20, spread)
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), 5, 10) == brute(rows, 5, 10)


def test_slices_of_a_tile():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(20, 16)), rng.normal(size=(400, 16))
    b[100:300] = b[5] + rng.normal(size=(200, 16)) * 1e-5
    order = [(i, i) for i in range(400)]
    want = block_join.tile(a, b, order, 6)
    block_join.CANDIDATE_SLICE, kept = 50, block_join.CANDIDATE_SLICE
    try:
        assert [sorted(h) for h in block_join.tile(a, b, order, 6)] == [sorted(h) for h in want]
    finally:
        block_join.CANDIDATE_SLICE = kept
    for i in range(20):
        best = sorted(((-cosine(a[i], b[j]), j) for j in range(400)))[:6]
        assert sorted((-s, j) for s, j in want[i]) == best


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for dims in (1, 3, 64, 2000):
        x = rng.normal(size=(40, dims)) * 10.0 ** rng.integers(-30, 30, size=(40, 1))
        s = block_join.Side(x)
        about = block_join.int8_product(s.codes, s.codes) * np.outer(s.scale, s.scale)
        unit = s.x / np.sqrt(s.squares)[:, None]
        slack = np.outer(s.length + s.error, s.error) + np.outer(s.error, s.length) + 1e-12
        assert (np.abs(unit @ unit.T - about) <= slack).all()
        assert (block_join.int8_product(s.codes, s.codes) == s.codes.astype(int) @ s.codes.astype(int).T).all()


def test_large_group_of_copies(spark):
    copy = [0.5, -0.25, 1.0]
    rows = [(i, copy if i % 3 else [float(i % 7) + 1, 1.0, float(i % 5)]) for i in range(600)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)) == brute(rows, 5, 50)


def test_edges(spark, edge_vectors):
    frame, rows = edge_vectors
    assert run(frame) == brute(rows, 5, 50)
    assert run(frame.where("false")) == []
    assert run(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")) == []
    assert run(spark.createDataFrame([(0, [1e200, 1e-200]), (1, [1e200, 0.0])], "vec_id long, embedding array<double>")) == [(0, 1, 1, 1.0)]


def test_sql(spark, sf_dir):
    from fairlineage.llm.queries import QUERIES

    _, ok, why = compare(spark, sf_dir, "op11_block_join", QUERIES["op11_block_join"], SQL["op11_block_join"])
    assert ok, why
