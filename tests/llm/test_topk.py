import random

import pytest

from fairlineage.llm import topk


def brute(rows, k, every):
    bits = lambda v, n: [x is not None and x > 0 for x in v] + [False] * (n - len(v))
    n = max((len(v) for _, v in rows if v is not None), default=0)
    coded = [(key, bits(v, n)) for key, v in rows if v is not None]
    out = []
    for key, code in coded:
        if key is None or key % every:
            continue
        near = sorted(((sum(a != b for a, b in zip(code, c)), other is None, other or 0) for other, c in coded if other != key))[:k]
        out += [(key, i + 1, None if missing else o, d) for i, (d, missing, o) in enumerate(near)]
    return sorted(out, key=str)


def run(spark, rows, k, every):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted((tuple(r) for r in topk.nearest_by_sign(frame, k, every).collect()), key=str)


@pytest.mark.parametrize("dims", [40, 20])
def test_against_all_pairs(spark, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(400)]
    copy = rows[50][1]
    rows += [(1000 + i, copy) for i in range(30)]
    assert run(spark, rows, 5, 50) == brute(rows, 5, 50)


def test_fewer_rows_than_asked_and_edges(spark):
    rows = [(0, [1.0, -1.0, 0.5]), (1, [1.0, -1.0]), (100, None), (None, [1.0, 1.0, 1.0]), (200, [None, float("nan"), -1.0]), (3, [])]
    want = brute([(k, None if v is None else [0 if x is None or x != x else x for x in v]) for k, v in rows], 10, 100)
    assert run(spark, rows, 10, 100) == want
    assert run(spark, [], 3, 100) == []
    assert run(spark, [(0, [1.0])], 3, 100) == []
