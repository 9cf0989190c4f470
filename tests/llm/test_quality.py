import random
import re
from collections import Counter
from math import log2, sqrt

from fairlineage.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)


def histograms(text, lists):
    """Shares of character classes, and for each language of its common words and of all others."""
    def kind(c):
        for name, members in (("stop", ".,;:!?"), ("quote", "'\"()-"), ("symbol", "#*$%&|<>"), ("line", "\n"), ("blank", "\t\x0b\f\r ")):
            if c in members:
                return name
        return ("small" if "a" <= c <= "z" else "capital" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9"
                else "beyond" if ord(c) > 127 else "other")
    of = Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    return Counter(map(kind, text)), {n: Counter({w: of[w] for w in ws.split()}) + Counter(
        {None: sum(c for w, c in of.items() if w not in ws.split())}) for n, ws in lists.items()}


def distance(p, q):
    total, all_ = sum(p.values()), sum(q.values())
    if not total:
        return 1.0
    out = 0.0
    for k in set(p) | set(q):
        a, b = p[k] / total, q[k] / all_
        out += sum(x / 2 * log2(2 * x / (a + b)) for x in (a, b) if x)
    return sqrt(max(out, 0.0))


def verdicts(judged, fitted, lists):
    """doc_id → (class distance, word distance, nearest, kept), by plain loops over whole texts."""
    classes, words = {}, {}
    for _, text, lang in fitted:
        if lang in lists and text and text.split():
            c, w = histograms(text, lists)
            classes.setdefault(lang, Counter()).update(c)
            words.setdefault(lang, Counter()).update(w[lang])
    out = {}
    for i, text, lang in judged:
        c, w = histograms(text or "", lists)
        n, chars, *_, failed = brute(text)
        best = min(((max(distance(c, classes[k]) / (0.14 + 1.4 / sqrt(max(n, 1))),
                         0.0 if lang is not None and lang not in classes else distance(w[k], words[k]) / (0.20 + 1.2 / sqrt(max(n, 1)))),
                     distance(c, classes[k]), distance(w[k], words[k]), k) for k in classes), default=(0.0, 0.0, 0.0, None))
        out[i] = (*best[1:], not failed and (chars < 150 or best[0] <= 1))
    return out


def test_verdicts_against_brute_force(spark, documents):
    """Distances, the one nearest language and the verdict of every document, with references of the table itself and with given ones."""
    docs = [(d["doc_id"], d["text"], d["lang"]) for d in documents.collect()]
    english = documents.where("lang = 'en'")
    for settings, fitted in (({}, docs), ({"known": quality.fit(english)}, [d for d in docs if d[2] == "en"])):
        want = verdicts(docs, fitted, quality.COMMON_WORDS)
        for r in quality.quality_rules(documents, **settings).collect():
            c, w, nearest, kept = want[r["doc_id"]]
            assert abs(r["class_distance"] - c) < 1e-9 and abs(r["word_distance"] - w) < 1e-9
            assert (r["nearest"], r["kept"]) == (nearest, kept)


def test_one_language_must_fit_in_both_histograms(spark):
    """Characters of one language with common words of another are no text of either."""
    words = {"a": "the of and to", "b": "der die das und"}
    one, two = "the of and to some more words here " * 20, "DER DIE DAS UND EIN PAAR WORTE 12345 " * 20
    mixed = "der die das und ein paar worte hier " * 20
    known = quality.fit(spark.createDataFrame([(1, one, "a"), (2, two, "b")], "doc_id long, text string, lang string"), words)
    docs = spark.createDataFrame([(3, mixed, "a")], "doc_id long, text string, lang string")
    row = quality.judge(docs, ["doc_id"], words, known=known, class_limit=(0.2, 0.0), word_limit=(0.2, 0.0)).first()
    assert min(row["_fits"], key=lambda f: f["c"])["nearest"] == "a" and min(row["_fits"], key=lambda f: f["w"])["nearest"] == "b"
    assert not row["kept"]


def test_counts_and_verdicts(spark, documents, sf_dir):
    rows = {r["doc_id"]: r for r in quality.quality_rules(documents).collect()}
    for d in documents.collect():
        r = rows[d["doc_id"]]
        assert brute(d["text"]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                                    r["base_failed"])
        assert not (r["base_failed"] and r["kept"])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [l["doc_id"] for l in labels if l["quality"] == 1 and not rows[l["doc_id"]]["base_failed"]]
    bad = [l["doc_id"] for l in labels if l["quality"] == 0]
    assert all(rows[i]["kept"] for i in good)
    assert sum(not rows[i]["kept"] for i in bad) >= 0.9 * len(bad)


def test_edges(edge_docs, edge_rows, no_docs):
    rows = quality.quality_rules(edge_docs).collect()
    want = Counter((i, *brute(t)) for i, t, *_ in edge_rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                    r["base_failed"]) for r in rows) == want
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == sum(r["kept"] for r in rows)
    assert quality.quality_rules(no_docs).collect() == []
    assert quality.keep_good(no_docs).collect() == []


def test_language_without_reference_is_not_rejected_by_words(spark):
    rng = random.Random(1)
    text = "\n".join(" ".join("".join(rng.choice("kostelnyvam") for _ in range(rng.randint(2, 8))) for _ in range(9))
                     for _ in range(9))
    english = "the of and to in that was for it with as on be at by this from an not have which " * 2
    docs = spark.createDataFrame([(1, text, "cs"), (2, text, "en"), (3, english, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(docs).collect()}
    assert got[1] == (False, True) and got[2] == (False, False)


def test_distance_is_zero_for_the_reference_itself(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(F.array(F.lit(3), F.lit(1)).alias("a")).select(
        quality._divergence(F.col("a"), F.lit(4), [0.75, 0.25]).alias("same"),
        quality._divergence(F.array(F.lit(0), F.lit(4)), F.lit(4), [1.0, 0.0]).alias("apart")).first()
    assert abs(row["same"]) < 1e-9 and abs(row["apart"] - 1) < 1e-9
