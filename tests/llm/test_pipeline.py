import re

from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from fairlineage.llm.queries import QUERIES, tokenizer_file

from ..compare import compare
from .test_ngram_join import brute as near_brute
from .test_quality import brute as quality_brute
from .test_secrets import brute as secret_brute


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11)) and len(P.STAGES) == 5


def test_sql(spark, sf_dir):
    from fairlineage.llm.oracles import SQL
    for name, sql in SQL.items():
        _, ok, why = compare(spark, sf_dir, name, E.queries()[name], sql)
        assert ok, (name, why)


def test_stages(spark, sf_dir, tmp_path):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = documents, {}
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "encode":
            assert docs.columns == documents.columns
    before = documents.collect()
    good = kept["quality_rules"]
    assert {tuple(r) for r in good} <= {tuple(r) for r in before}
    assert not any(quality_brute(r["text"])[-1] for r in good)
    groups = near_brute([(r["doc_id"], r["text"]) for r in good], 5, 80)
    assert sorted(r["doc_id"] for r in kept["near_duplicates"]) == sorted(k for k, n, c in groups if k == c or not n)
    texts = {r["doc_id"]: r["text"] for r in kept["near_duplicates"]}
    for r in kept["secret_scan"]:
        assert not [s for s in secret_brute(r["text"]) if s[3] == "hex"] and (r["text"] == texts[r["doc_id"]]) == (not secret_brute(texts[r["doc_id"]]))
    masked = {r["doc_id"]: r["text"] for r in kept["secret_scan"]}
    assert all(r["text"] in masked[r["doc_id"]] for r in kept["mix_sources"])
    n = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
    assert abs(n(kept["mix_sources"]) - 1.5 * n(kept["secret_scan"])) <= 128 * 20
    library = Tokenizer.from_file(tokenizer_file())
    want = sorted((r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in kept["mix_sources"])
    assert sorted((r["doc_id"], r["ids"]) for r in kept["encode"]) == want
    assert len(P.run(spark, sf_dir).collect()) == len(want)


def test_empty_and_edge_documents(spark, no_docs, edge_docs, tmp_path):
    for label, docs in (("none", no_docs), ("edge", edge_docs)):
        for name, stage in P.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / label / name))
            docs = spark.read.parquet(str(tmp_path / label / name))
        assert label == "edge" or docs.count() == 0
