import math
import re
import zlib
from collections import Counter

import numpy as np

from fairlineage.llm import lm


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\n"]


def fold(key):
    return -1 if key is None else zlib.crc32(str(key).encode()) % 7


def counts(rows):
    one, two, before = Counter(), Counter(), Counter()
    for _, text in rows:
        w = words(text)
        one.update(w)
        two.update(zip(["", *w], w))
        before.update(["", *w[:-1]])
    return one, two, before


def bucket(n):
    return 1 + int(math.floor(math.log2(n))) if n else 0


def scored(monkeypatch, docs):
    kept = {}
    learn = lm.learn_weights

    def learn_and_keep(rows, types, rounds=60):
        kept["weights"] = learn(rows, types, rounds)
        return kept["weights"]

    monkeypatch.setattr(lm, "learn_weights", learn_and_keep)
    return lm.lm_scores(docs).collect(), kept["weights"]


def exact_weights(rows):
    """The same expectation-maximisation, word by word."""
    one, two, before = counts([r for r in rows if fold(r[0]) not in (2, 3)])
    n, types = sum(one.values()), len(one)
    seen = Counter()
    for key, text in rows:
        if fold(key) == 3:
            w = words(text)
            for v, x in zip(["", *w], w):
                c = before[v]
                seen[bucket(c), two[v, x] / c if c else 0.0, one[x] / max(n, 1)] += 1
    weights = np.tile(np.array([0.3, 0.5, 0.2]), (66, 1))
    weights[0] = (0.0, 0.7, 0.3)
    for _ in range(60):
        new = np.tile(np.array([0.3, 0.5, 0.2]), (66, 1))
        new[0, 0] = 0.0
        for (b, p2, p1), m in seen.items():
            share = weights[b] * (p2, p1, 1 / (types + 1))
            new[b] += m * share / share.sum()
        weights = new / new.sum(1, keepdims=True)
    return weights


def check(rows, got, weights):
    one, two, before = counts([r for r in rows if fold(r[0]) != 2])
    n, types = sum(one.values()), len(one)
    want = []
    for key, text in rows:
        w = words(text)
        score = 0.0
        for v, x in zip(["", *w], w):
            a, b, c = weights[bucket(before[v])]
            score += math.log10(a * (two[v, x] / before[v] if before[v] else 0) + b * one[x] / max(n, 1) + c / (types + 1))
        want.append((key, fold(key) == 2, len(w), sum(one[x] > 0 for x in w), n,
                     round(sum(math.log10((one[x] + 1) / (n + types + 1)) for x in w), 6), round(score, 6)))
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got), key=str) == sorted(want, key=str)


def test_documents(monkeypatch, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got, weights = scored(monkeypatch, documents)
    check(rows, got, weights)
    assert np.abs(weights - exact_weights(rows)).max() < 0.03
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_small_chunks_and_buckets(monkeypatch, documents):
    some = documents.where("n_chars < 900")
    whole = {r["doc_id"]: r for r in lm.lm_scores(some).collect()}
    monkeypatch.setattr(lm, "BUCKET", 500)
    pieces = {r["doc_id"]: r for r in lm.lm_scores(some.repartition(9)).collect()}
    for key, r in whole.items():
        assert math.isclose(r["score"], pieces[key]["score"], rel_tol=1e-6) and r["n_known"] == pieces[key]["n_known"]


def test_edges(monkeypatch, edge_docs, edge_rows, no_docs):
    got, weights = scored(monkeypatch, edge_docs)
    check([(r[0], r[1]) for r in edge_rows], got, weights)
    assert lm.lm_scores(no_docs).collect() == []


def test_packing():
    for numbers in ([], [0], [1, 2, 3, 2**63], list(range(1000))):
        assert lm.unpack(lm.pack(np.array(numbers, dtype=np.uint64))).tolist() == numbers
