"""Quality rules: counts per text, and how far its histograms lie from those of known languages.

Method: a text's histogram of character classes, and its histogram over a language's most common words
(all others together), are compared with the same histograms of a reference of that language. The measure is the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). Each distance has a limit; a language fits
as badly as the larger of its two distances, each over its limit. The language that fits best counts, in both
histograms; a text beyond either limit there is rejected. Short texts have noisy histograms: the limits widen as
the number of words falls, and below ``least_chars`` or ``least_words`` the comparison is not made.

References are an input: :func:`fit` takes them from documents of one's choice. Where none are given they are
the sums over all documents judged, by language.

One pass over the texts writes a narrow table of counts; references and verdicts come from that table.
References are as many as the languages given, so they fit into the plan as literals.

Defined results: null text counts as empty; empty text has no words and fails the base rule; repeated
rows are all judged; a null language adds to no reference but is compared with all of them; a language
without a reference is judged by its character classes only; with no reference at all the verdict is
true unless the base rule failed; further columns are ignored, or carried by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, ship_package
from .common import slices

#: Common words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it with as was on be at by this are or from an not have had which",
    "de": "der die das und ist in zu den von mit sich auf für ein eine dem des im nicht auch als es an er sie",
    "fr": "le la les de des du et un une en est que qui dans pour par sur au ne pas ce il se plus avec",
    "es": "el la los las de del y en un una que es se no con por para su al lo como más o pero sus",
}
SYMBOLS = b"#*$%&|<>"
CLASSES = ("small", "capital", "digit", "blank", "line", "stop", "quote", "symbol", "other", "beyond")


def _class_table() -> np.ndarray:
    """Class of each byte of UTF-8; bytes inside a longer character get the extra class at the end."""
    table = np.full(256, CLASSES.index("other"), dtype=np.uint8)
    for name, members in (("small", range(97, 123)), ("capital", range(65, 91)), ("digit", range(48, 58)),
                          ("blank", (9, 11, 12, 13, 32)), ("line", (10,)), ("stop", b".,;:!?"), ("quote", b"'\"()-"),
                          ("symbol", SYMBOLS), ("beyond", range(192, 256))):
        table[list(members)] = CLASSES.index(name)
    table[128:192] = len(CLASSES)
    return table


_TABLE = _class_table()
_BLANKS = list(range(9, 14)) + [32]


def text_counts(data: bytes, common: Sequence[bytes]) -> tuple[int, int, int, int, int, np.ndarray, list[int]]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows, classes, common words)."""
    words = data.split()
    codes = np.frombuffer(data, dtype=np.uint8)
    by_byte = np.bincount(codes, minlength=256)
    classes = np.bincount(_TABLE, weights=by_byte, minlength=len(CLASSES) + 1)[:-1].astype(np.int64)
    word_chars = int(classes.sum() - by_byte[_BLANKS].sum())
    symbols = int(by_byte[list(SYMBOLS)].sum())
    lines, seen = 0, set()
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line in seen:
                lines += 1
            elif line and line.split(None, 1):
                seen.add(line)
    n, repeated = len(words), 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        inside = bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                inside[i:i + 3] = b"\1\1\1"
        repeated = inside.count(1)
    of = Counter(data.lower().split())
    return n, word_chars, symbols, lines, repeated, classes, [of[w] for w in common]


def count_texts(docs: DataFrame, common_words: Mapping[str, str], carried: Sequence[str], text: str = "text",
                lang: str | None = "lang") -> DataFrame:
    """Counts of every text beside the columns to carry, which sit in one struct so that no names clash.

    (row struct, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common)
    """
    ship_package(docs.sparkSession)
    common = [w.encode() for words in common_words.values() for w in words.split()]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
        (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            found = [text_counts(t, common) for t in part.column(2).to_pylist()]
            if not found:
                continue
            columns = [part.column(0), part.column(1)]
            columns += [pa.array([f[i] for f in found], type=pa.int64()) for i in range(5)]
            columns.append(pa.array([f[5] for f in found], type=pa.list_(pa.int64())))
            columns.append(pa.array([f[6] for f in found], type=pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang", *numbers, "classes", "common"])

    kind = rows.schema["row"].dataType.simpleString()
    schema = ", ".join([f"row {kind}", "lang string", *(f"{n} long" for n in numbers), "classes array<long>",
                        "common array<long>"])
    return rows.mapInArrow(work, schema)


def _divergence(own: Column, total: Column, reference: Sequence[float]) -> Column:
    """Jensen-Shannon distance of counts ``own`` (sum ``total``) and literal shares; 1 where ``total`` is 0."""
    half = F.lit(0.5)

    def term(n: Column, q: Column) -> Column:
        p = n / total
        m = half * (p + q)
        part = lambda x: F.when(x > 0, half * x * F.log2(x / m)).otherwise(0.0)
        return part(p) + part(q)

    terms = F.zip_with(own, F.array(*[F.lit(float(q)) for q in reference]), term)
    summed = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(summed, F.lit(0.0)))).otherwise(1.0)


def references(counts: DataFrame, common_words: Mapping[str, str]) -> dict[str, tuple[list[float], list[float]]]:
    """Language → (shares of classes, shares of its common words and of all others), over all its documents.

    At most one row per language given comes to the driver.
    """
    spans, start = {}, 0
    for name, words in common_words.items():
        spans[name] = start, start + len(words.split())
        start = spans[name][1]
    rows = (
        counts.where(F.col("lang").isin(list(common_words)))
        .groupBy("lang")
        .agg(F.sum("n_words").alias("words"),
             F.array(*[F.sum(F.col("classes")[i]) for i in range(len(CLASSES))]).alias("classes"),
             F.array(*[F.sum(F.col("common")[i]) for i in range(start)]).alias("common"))
        .collect())
    found = {}
    for r in rows:
        a, b = spans[r["lang"]]
        chars = sum(r["classes"])
        if r["words"] and chars:
            own = r["common"][a:b]
            found[r["lang"]] = (
                [n / chars for n in r["classes"]], [n / r["words"] for n in own] + [1 - sum(own) / r["words"]])
    return found


References = Mapping[str, tuple[Sequence[float], Sequence[float]]]


def fit(docs: DataFrame, common_words: Mapping[str, str] = COMMON_WORDS, text: str = "text", lang: str = "lang") -> References:
    """References of all languages that ``docs`` has words of, over all its rows; for ``known`` of :func:`judge`."""
    return references(count_texts(docs, common_words, [], text, lang), common_words)


def judge(docs: DataFrame, carried: Sequence[str], common_words: Mapping[str, str] = COMMON_WORDS,
          class_limit: tuple[float, float] = (0.14, 1.4), word_limit: tuple[float, float] = (0.20, 1.2),
          least_chars: int = 150, least_words: int = 50, text: str = "text", lang: str | None = "lang",
          known: References | None = None) -> DataFrame:
    """Counts, distances, the nearest language and verdicts of every row, beside the carried columns in ``row``.

    A limit (a, b) means a + b / sqrt(n_words): the distance of a short text from its own language's
    histogram is larger by chance, in that proportion. ``known`` are references fitted before, by the same common words.
    """
    counts = cut(count_texts(docs, common_words, carried, text, lang))
    spans, start = {}, 0
    for name, words in common_words.items():
        spans[name] = start, len(words.split())
        start += spans[name][1]
    known = references(counts, common_words) if known is None else known
    summed = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    # a text without words has no limits; the base rule has rejected it
    allowed = lambda limit: limit[0] + limit[1] / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    other_language = F.col("lang").isNotNull() & ~F.col("lang").isin(list(known))
    fits = []
    for name, (classes, words) in sorted(known.items()):
        own = F.slice("common", spans[name][0] + 1, spans[name][1])
        by_class = _divergence(F.col("classes"), summed("classes"), classes)
        by_word = _divergence(F.concat(own, F.array(F.col("n_words") - summed(own))), F.col("n_words"), words)
        fits.append(F.struct(by_class.alias("c"), by_word.alias("w"), F.lit(name).alias("nearest")))
    none = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("w"), F.lit(None).cast("string").alias("nearest"))
    short = (F.col("n_words") < least_words) | (F.col("word_chars") < least_chars)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ranked = F.transform("_fits", lambda x: F.struct(
        F.greatest(x["c"] / allowed(class_limit), F.when(other_language, F.lit(0.0)).otherwise(
            x["w"] / allowed(word_limit))).alias("over"), x.alias("fit")))
    return (
        counts.withColumn("_fits", F.array(*(fits or [none])))
        .withColumn("_best", F.array_min(ranked))
        .withColumn("class_distance", F.col("_best.fit.c"))
        .withColumn("word_distance", F.col("_best.fit.w"))
        .withColumn("nearest", F.col("_best.fit.nearest"))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (short | (F.col("_best.over") <= 1))))


def quality_rules(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """One row per document: key, its counts, ``class_distance``, ``word_distance`` and ``nearest`` (language), base_failed and kept."""
    return judge(docs, [key], **settings).select(
        F.col(f"row.{key}").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "class_distance", "word_distance", "nearest", "base_failed", "kept")


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """The documents whose verdict is true, with all their columns; each row is judged by its own text."""
    return judge(docs, docs.columns, **settings).where("kept").select("row.*")
