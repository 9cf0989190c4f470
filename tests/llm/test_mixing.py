import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fairlineage.llm import mixing


def wanted(sizes):
    """Targets by the words of the contract: share by weight, stop at twice, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if total * weight[s] / w > 2 * sizes[s]}
        if not over:
            target |= {s: total * weight[s] / w for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
        total -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(rows, sources, slack):
    sizes = defaultdict(int)
    for r, s in zip(rows, sources):
        sizes[s] += r["size"]
    target, taken = wanted(sizes), defaultdict(int)
    for r, s in zip(rows, sources):
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack + 1, (s, taken[s], target[s])


def test_targets_and_taken(documents):
    mixed = mixing.mix(documents, carried=("doc_id", "source"))
    rows = mixing.taken_words(mixed).collect()
    assert len(rows) == documents.count()
    check(rows, [r["source"] for r in rows], 128)
    again = mixing.taken_words(mixing.mix(documents.repartition(5))).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}
    # a shard's slots are full, but for the last one's
    slots = mixed.counts.groupBy("shard").agg(F.sum("blocks").alias("n")).orderBy("shard").collect()
    assert all(s["n"] == 1024 for s in slots[:-1])


def test_texts_are_the_pieces(documents):
    mixed = mixing.mix(documents, carried=documents.columns)
    texts = mixing.mixed_texts(mixed).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    taken = Counter()
    for r in texts:
        taken[r["doc_id"]] += len(words(r["text"]))
    assert taken == Counter({r["doc_id"]: r["taken"] for r in mixing.taken_words(mixed).collect() if r["taken"]})
    source = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(r["text"] in source[r["doc_id"]] for r in texts)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 257, 1000])
def test_permutation(spark, size):
    got = [r[0] for r in spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size), 3, "x")).collect()]
    assert sorted(got) == list(range(size))
    assert size < 10 or got != list(range(size))


def test_edges(edge_docs, edge_rows, no_docs):
    mixed = mixing.mix(edge_docs, carried=edge_docs.columns)
    rows = mixing.taken_words(mixing.mix(edge_docs, carried=("doc_id", "source"))).collect()
    assert len(rows) == len(edge_rows)
    check(rows, [r["source"] for r in rows], 128)
    assert set(mixing.mixed_texts(mixed).columns) >= set(edge_docs.columns)
    assert mixing.taken_words(mixing.mix(no_docs)).collect() == []
    assert mixing.mixed_texts(mixing.mix(no_docs, carried=no_docs.columns)).collect() == []


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    rows = mixing.taken_words(mixing.mix(docs)).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in rows] == [(0, 0, 0.0, 0)] * 2


def test_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(i, "one two three " * 40, "ab"[i % 2], "kept", "too", "also") for i in range(8)],
                                 "doc_id long, text string, source string, _text string, _shard string, _place string")
    rows = mixing.mixed_texts(mixing.mix(docs, carried=docs.columns)).select(*docs.columns).collect()
    assert rows and {(r["_text"], r["_shard"], r["_place"]) for r in rows} == {("kept", "too", "also")}
