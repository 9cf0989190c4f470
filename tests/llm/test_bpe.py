import hashlib

from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from fairlineage.llm import bpe
from fairlineage.llm.queries import tokenizer_file

PATH = tokenizer_file()
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=60))
def test_same_ids_as_library(text):
    own = bpe.codec(PATH)
    ids = own.encode(text).tolist()
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_special_tokens_and_signs():
    own = bpe.codec(PATH)
    for text in ("a<|endoftext|> b<|startoftext|>", "ΑΣ it's WE'LL 123 !!! 'sé é", "  \n ", "日本語 emoji 😀 x", "a" * 3000):
        assert own.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_documents(documents):
    got = {r["doc_id"]: r for r in bpe.digests(bpe.encode_texts(documents, PATH)).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(edge_docs, edge_rows, no_docs):
    rows = bpe.encode_texts(edge_docs, PATH).collect()
    assert len(rows) == len(edge_rows)
    empty = [r for r in rows if not r["ids"]]
    assert len(empty) == sum(not (t or "").strip() for _, t, *_ in edge_rows) and all(r["decoded"] == "" for r in empty)
    assert bpe.digests(bpe.encode_texts(no_docs, PATH)).collect() == []


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.WordBpe(PATH)
    text = "some words and some more words and others again"
    assert own.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
