import math

import numpy as np
import pytest

from fairlineage.llm import whitening as W


def brute(rows, most):
    """key → (n, deviation, whitened up to sign, explained, e) by a direct eigendecomposition, lengths apart."""
    kept = [(key, [math.floor(x * 64) + W.SHIFT if abs(x) < 1e9 else (W.LONG if x > 0 else -W.LONG - 1) for x in v]) for key, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dims in sorted({len(v) for _, v in kept}):
        own = [(key, v) for key, v in kept if len(v) == dims]
        fit = sorted({tuple(v) for _, v in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        gap = lambda v: [n * a - s for a, s in zip(v, sums)]
        y = np.array([[g / n for g in gap(v)] for v in fit])
        values, vectors = np.linalg.eigh(y.T @ y / n)
        at = [i for i in np.argsort(-values)[:most] if values[i] > 1e-12 * values.sum()]
        for key, v in own:
            g = gap(v)
            out.append((key, n, min(sum(a * a for a in g), W.LONG), np.array([a / n for a in g]) @ vectors[:, at] / np.sqrt(values[at]),
                        values[at] / values.sum()))
    return out


def check(frame, rows, most=16, places=1e-6):
    got = {}
    for r in W.whitened(frame, most).collect():
        got.setdefault((r["vec_id"], r["n"], r["deviation"]), []).append(r)
    want = [w for w in brute(rows, most) if len(w[4])]
    assert set(got) == {w[:3] for w in want}
    for key, n, deviation, white, explained in want:
        mine = sorted(got[key, n, deviation], key=lambda r: r["component"])
        copies = len(mine) // len(explained)
        assert [r["component"] for r in mine] == [c + 1 for c in range(len(explained)) for _ in range(copies)]
        np.testing.assert_allclose([r["explained"] for r in mine[::copies]], explained, rtol=1e-4)
        np.testing.assert_allclose(np.abs([r["whitened"] for r in mine[::copies]]), np.abs(white), atol=places * max(1, np.abs(white).max()))
        assert all(r["identity_error"] <= 1e-4 for r in mine)


@pytest.mark.parametrize("rows_each", [2048, 30])
def test_against_direct_eigendecomposition(spark, monkeypatch, rows_each):
    """In one spectrum, and in many that are combined in several levels."""
    monkeypatch.setattr(W, "ROWS", rows_each)
    monkeypatch.setattr(W, "FAN_IN", 3)
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x = (rng.normal(size=(400, 64)) * np.geomspace(20, 0.1, 64)) @ turn.T
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6), rows)


def test_documents_vectors(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(frame, [(r["vec_id"], r["embedding"]) for r in frame.select("vec_id", "embedding").collect()])


def test_fewer_vectors_than_numbers_and_edges(spark, edge_vectors):
    frame, rows = edge_vectors
    plain = frame.where("vec_id is null or vec_id < 450")
    check(plain, [r for r in rows if r[0] is None or r[0] < 450])
    got = W.whitened(frame).select("vec_id", "deviation").distinct().collect()
    assert {r["vec_id"] for r in got} >= {450, 451, 452} and all(r["deviation"] >= 0 for r in got)
    assert W.whitened(frame.where("false")).collect() == []
    assert W.whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_rank_one_updates():
    rng = np.random.default_rng(2)
    for trial in range(300):
        k = int(rng.integers(1, 40))
        a = rng.normal(size=(k, k + 3)) if trial % 3 else rng.integers(-2, 3, size=(k, k + 3)).astype(float)
        if trial % 5 == 0:
            a[:, 1:] = 0
        values, vectors = np.linalg.eigh(a @ a.T)
        values = np.maximum(values, 0)
        v = rng.normal(size=k) * 10.0 ** rng.integers(-12, 6)
        if trial % 4 == 0:
            v[::2] = 0
        rho = float(rng.random() * 10)
        d, q = W.rank_one(values, vectors, vectors.T @ v, rho)
        want = (vectors * values) @ vectors.T + rho * np.outer(v, v)
        assert np.abs((q * d) @ q.T - want).max() <= 1e-12 * max(np.abs(want).max(), 1e-300)
        assert np.abs(q.T @ q - np.eye(k)).max() <= 1e-12 and (np.diff(d) >= 0).all()


def test_spectra_alone_are_close(spark):
    """The updates give the decomposition themselves; the Ritz pass only sharpens it."""
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (500, 24)) + W.SHIFT
    whole, other = W.Spectrum.empty(24), W.Spectrum.empty(24)
    whole.take(x[:200])
    other.take(x[200:])
    whole.join(other)
    y = x - x.mean(0)
    values = np.linalg.eigvalsh(y.T @ y)
    assert whole.n == 500 and (whole.sums == x.sum(0)).all()
    np.testing.assert_allclose(whole.values, values, rtol=1e-11)
    np.testing.assert_allclose((whole.vectors * whole.values) @ whole.vectors.T, y.T @ y, atol=1e-9 * values[-1])
