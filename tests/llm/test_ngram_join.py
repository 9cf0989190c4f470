import random
import re

import numpy as np
import pytest

from fairlineage.llm import ngram_join
from fairlineage.llm.common import components

from .conftest import prose


def shingles(text, k):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    """(n, smallest key reachable) of every row, rows by position."""
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), key) if x is not None), default=None)
    return sorted(((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)), key=str)


def run(spark, rows, k=3, percent=90):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in ngram_join.near_groups(docs, k, percent).collect()), key=str)


def near_copies(rng, n, families, size):
    rows = []
    for f in range(families):
        words = prose(rng, size + f).split()
        for _ in range(n):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, size // 60))):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_against_all_pairs(spark, k, percent):
    rng = random.Random(k)
    rows = near_copies(rng, 12, 6, 40) + [(1000 + i, t) for i, (_, t) in enumerate(near_copies(rng, 8, 4, 150))]
    rows += [(2000 + n, prose(rng, n)) for n in range(1, 30)] + [(3000 + n, "same tiny text") for n in range(3)]
    assert run(spark, rows, k, percent) == brute(rows, k, percent)


def test_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows, 3, 90)


def test_large_family_in_blocks(spark, monkeypatch):
    rows = near_copies(random.Random(9), 40, 2, 80)
    want = brute(rows, 3, 90)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(ngram_join, "BUCKET", 100)
    monkeypatch.setattr(ngram_join, "FULL", 5)
    monkeypatch.setattr(ngram_join, "small_side", lambda side, rows: side)
    assert run(spark, rows) == want


def test_least_copy_stands_for_a_slice(spark):
    bits = bytes(16)
    rows = [(2, 9, b"copies", 0, [7, 8], [], bits), (0, 9, b"copies", 0, [7, 8], [], bits), (1, 9, b"near", 0, [7, 9], [], bits)]
    frame = spark.createDataFrame(rows, "row_no long, n long, print binary, level int, boxes array<long>, above array<long>, parities binary")
    assert [tuple(r) for r in ngram_join.box_edges(frame.coalesce(1), 80).collect()] == [(1, 0)]


def test_near_copies_of_a_large_copy_group(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        text = prose(rng, 120)
        rows += [text] * 60 + [f"extra {text}", f"{text} extra"]
    rows += [prose(rng, rng.randint(1, 900)) for _ in range(120)]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 1))
    # files reread as on two cores, so that many lie in one slice, by falling size
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
        got = sorted((tuple(r) for r in ngram_join.near_groups(docs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert got == brute(rows, 3, 90)


def test_similar_sets_share_a_box():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        bounds = ngram_join.class_bounds(percent)
        for _ in range(300):
            n = int(rng.integers(9, 400))
            pool = rng.integers(1, 1 << 62, 2 * n, dtype=np.uint64)
            a = np.unique(pool[:n])
            gone, more = rng.integers(0, n // 4 + 1), rng.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate([a[gone:], pool[n:n + more]]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and len(a) != both:
                (x, own), (y, other) = ngram_join.boxes(a, bounds, percent), ngram_join.boxes(b, bounds, percent)
                shared = set(np.concatenate(own)) & set(np.concatenate(other))
                assert shared and abs(x - y) <= 1
                for wide in (16, 128):
                    bits = np.stack([np.frombuffer(ngram_join.parities(s, wide), np.uint64) for s in (a, b)])
                    root = ngram_join.met_pairs(np.array([5, 5], np.uint64), np.array([0, 1]), np.array([len(a), len(b)]), bits, percent)
                    assert root.tolist() == [0, 0]


def test_unlike_sets_do_not_meet(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(1, 1 << 62, 200, dtype=np.uint64)) for _ in range(30)]
    sets.append(np.unique(np.append(sets[3][5:], sets[4][:3])))
    bits = np.stack([np.frombuffer(ngram_join.parities(s, 32), np.uint64) for s in sets])
    size = np.array([len(s) for s in sets])
    box, at = np.zeros(len(sets), np.uint64), np.arange(len(sets))
    want = np.arange(31)
    want[30] = 3
    assert ngram_join.met_pairs(box, at, size, bits, 80).tolist() == want.tolist()
    folded = np.stack([np.bitwise_xor(bits[:, 0:2], bits[:, 2:4])])[0]
    assert (folded == np.stack([np.frombuffer(ngram_join.parities(s, 16), np.uint64) for s in sets])).all()
    monkeypatch.setattr(ngram_join, "FULL", 10)
    assert not ngram_join.met_pairs(box, at, size, bits, 80).any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (3, 1), (7, 9), (9, 8), (5, 5)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = sorted((tuple(r) for r in ngram_join.near_groups(edge_docs).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in edge_rows], 3, 90)
    stays = ngram_join.one_per_group(edge_docs)
    assert stays.columns == edge_docs.columns
    groups = {}
    for key, n, component in brute([(r[0], r[1]) for r in edge_rows], 3, 90):
        groups.setdefault((component, n > 0 and component is not None), []).append(key)
    want = sorted((g[0] for g in ([[None]] * 2 + [[2], [3], [9]] + [[1], [4], [7], [8], [10], [11], [20]])), key=str)
    assert sorted((r["doc_id"] for r in stays.select("doc_id").collect()), key=str) == want
    assert ngram_join.near_groups(no_docs).collect() == []
    assert ngram_join.one_per_group(no_docs).collect() == []
