"""Main text of web pages, by a linear-chain conditional random field over the leaf blocks of the page.

Method. A page's markup is read into leaf blocks: runs of text between block-level tags, each with its chain of
ancestors. A block's features are its tags and ancestor tags, what the classes and ids above it say, and its text
(length, share of links, end, telling words). The field scores a labelling of all blocks by a weight
per feature and one per pair of neighbouring labels; Viterbi finds the best labelling, and the blocks labelled as main text are kept.

Training maximises the likelihood of labelled pages by gradient steps on exact marginals (forward-backward). Labelled
pages are ``made`` layouts with known labels and at most ``own`` pages of the table that mark their article themselves
(``article`` or ``main``, without menus, asides and the like inside); in half of the latter the mark is hidden, so that the other features are
learned, too. Both numbers are bounds of the sample, which the driver trains on. Applying it is row by row; nothing is shuffled.

Defined results: null and empty pages, and pages without main text, have an empty text; broken or cut-off markup is read as far
as it goes; repeated rows are all returned; pages of any length are read whole; null keys are kept; further columns are ignored.
Reading a page: character references are decoded, white space in a block becomes one blank, blocks are
joined by an empty line; scripts, styles, comments and form controls have no text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .common import slices
from .html_pages import page as made_page

#: Tags of HTML by what they do to blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt s samp small span strike strong "
    "sub sup time tt u var wbr label".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object textarea select button title".split())
_END_OF = {tag: re.compile(rf"</{tag}[^>]*(?:>|$)", re.I) for tag in SILENT}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul li dd dt".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",)}
#: What words in classes and ids, and in short texts, tell.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs".split(),
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner".split(),
    "comment": "comment comments commentlist reply replies respond disqus discussion responses".split(),
    "side": "side sidebar aside widget related rail recommended popular trending".split(),
    "foot": "foot footer copyright legal bottom colophon".split(),
    "head": "header masthead logo top topbar branding".split(),
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay subscribe newsletter signup paywall".split(),
    "share": "share sharing social follow buttons".split(),
    "form": "form search login register contact".split(),
    "main": "article content entry post story main body text page".split(),
}
TELLING = re.compile(
    r"(©|copyright|all rights reserved)|(cookie|privacy policy|terms of)|(subscribe|newsletter|sign up|log in|login)|(comment|reply|replies)|"
    r"(advert|sponsored)|(share|tweet|follow us)|(read more|related|see also)", re.I)
_NAMES = {word: name for name, words in NAMES.items() for word in words}
#: A quote that is never closed is a character of its tag, so every tag ends at its first > outside of quotes or with the page, and nothing
#: is read twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _says(attributes: str) -> frozenset[str]:
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            out.update(f"says:{_NAMES[w]}" for w in map(str.lower, _NAME_WORDS.findall(value)) if w in _NAMES)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or re.search(r"display\s*:\s*none", value):
            out.add("hidden")
    return frozenset(out)


_NONE: frozenset[str] = frozenset()


def leaf_blocks(source: str) -> list[tuple[str, str, tuple, int, int]]:
    """(text, tag, ancestors as (tag, what it says), letters in links, letters) of every leaf block with text."""
    blocks, stack, runs = [], [], []
    endless: set[str] = set()  # tags that no end tag follows any more
    in_link, linked, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                blocks.append((text, stack[-1][0] if stack else "body", tuple(stack), linked, len(text)))
            runs.clear()
        linked = 0

    while m := _TOKEN.search(source, at):
        if m.start() > at:
            run = source[at:m.start()]
            if "&" in run:
                run = html.unescape(run)
            runs.append(run)
            if in_link:
                linked += len(run.strip())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in SILENT:
            # what is inside is no text of the page; a tag that is never closed is taken for a slip, but not a script
            if not m[1] and not m[3].endswith("/"):
                end = None if tag in endless else _END_OF[tag].search(source, at)
                if end is None:
                    endless.add(tag)
                if end or tag in ("script", "style"):
                    at = end.end() if end else len(source)
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
        if tag in INLINE:
            continue
        if tag == "br":
            runs.append(" ")
            continue
        close()
        in_link = 0
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in ITEMS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ITEMS[tag]:
                    break
                if stack[i][0] == tag or tag in ("td", "th") and stack[i][0] in ("td", "th") or {tag, stack[i][0]} == {"dd", "dt"}:
                    del stack[i:]
                    break
        if tag not in EMPTY and tag not in ("html", "body"):
            stack.append((tag, _says(m[3]) if "=" in m[3] or "hidden" in m[3] else _NONE))
    if at < len(source):
        runs.append(html.unescape(source[at:]))
    close()
    return blocks


_SIZES = (3, 6, 11, 21, 51)


def _size(words: int) -> int:
    return sum(words >= s for s in _SIZES)


def place_features(tag: str, ancestors: tuple) -> list[str]:
    """Features of where a block stands."""
    features = {"always", f"tag:{tag}"}
    for name, says in ancestors:
        features.add(f"in:{name}")
        features |= says
    return sorted(features)


def text_features(block: tuple, first: bool, last: bool) -> list[str]:
    """Features of what a block holds."""
    text, tag, _, linked, letters = block
    words = text.count(" ") + 1
    size, end = _size(words), text[-1]
    features = [f"words:{size}", f"end:{end}" if end in ".!?:" else "end:none", f"links:{min(3, 4 * linked // letters)}",
                f"small:{tag}:{size // 2}"]
    if first:
        features.append("first")
    if last:
        features.append("last")
    if words <= 40:
        features += {f"tells:{m.lastindex}" for m in TELLING.finditer(text)}
    return features


def block_features(blocks: Sequence[tuple]) -> list[list[str]]:
    """Features of every block of a page, as names."""
    end = len(blocks) - 1
    return [place_features(b[1], b[2]) + text_features(b, i == 0, i == end) for i, b in enumerate(blocks)]


class ChainField:
    """Weights of features for label 1, of neighbouring labels, and of the first label."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.weights = np.zeros(len(names) + 1)  # the last stands for unknown features and stays 0
        self.pairs = np.zeros((2, 2))

    def indices(self, features: Sequence[Sequence[str]]) -> list[list[int]]:
        get = self.names.get
        return [[i for f in block if (i := get(f)) is not None] for block in features]

    def scores(self, blocks: Sequence[tuple]) -> list[float]:
        """Score of label 1 for every block of a page; places recur, so theirs are remembered."""
        known, weight, end, out = self._known, self._weight, len(blocks) - 1, []
        for i, block in enumerate(blocks):
            place = block[1], block[2]
            if place not in known:
                if len(known) > 100_000:
                    known.clear()
                known[place] = sum(weight.get(f, 0.0) for f in place_features(*place))
            out.append(known[place] + sum([weight.get(f, 0.0) for f in text_features(block, i == 0, i == end)]))
        return out

    def decode(self, scores: Sequence[float]) -> list[int]:
        """The best labelling (Viterbi) for scores of label 1."""
        (s00, s01), (s10, s11) = self.pairs.tolist()
        zero, one, back = 0.0, scores[0], []
        for own in scores[1:]:
            a0, b0, a1, b1 = zero + s00, one + s10, zero + s01, one + s11
            back.append((b0 > a0, b1 > a1))
            zero, one = max(a0, b0), max(a1, b1) + own
        labels = [int(one > zero)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def ready(self) -> "ChainField":
        """The same field, set up for decoding."""
        self._known, self._weight = {}, dict(zip(self.names, self.weights.tolist()))
        return self


def train(pages: Sequence[tuple[list[list[str]], list[int]]], rounds: int = 90, rate: float = 0.2, decay: float = 1e-3) -> ChainField:
    """Field of greatest likelihood of (features, labels) of pages, by gradient steps on exact marginals."""
    seen: dict[str, int] = {}
    for features, _ in pages:
        for block in features:
            for f in block:
                seen[f] = seen.get(f, 0) + 1
    field = ChainField({f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))})
    pad = len(field.names)
    long, wide = max(len(y) for _, y in pages), max(len(b) for x, _ in pages for b in x)
    x = np.full((len(pages), long, wide), pad)
    y, there = np.zeros((len(pages), long), int), np.zeros((len(pages), long), bool)
    for n, (features, labels) in enumerate(pages):
        for t, block in enumerate(field.indices(features)):
            x[n, t, :len(block)] = block
        y[n, :len(labels)], there[n, :len(labels)] = labels, True
    both = there[:, 1:, None, None]
    truth = np.zeros((2, 2))
    np.add.at(truth, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1)
    moments = [np.zeros(pad + 5), np.zeros(pad + 5)]
    for step in range(1, rounds + 1):
        own = np.zeros((len(pages), long, 2))
        own[:, :, 1] = field.weights[x].sum(2)
        own[~there] = 0
        forward, backward = np.zeros_like(own), np.zeros_like(own)
        forward[:, 0] = own[:, 0]
        for t in range(1, long):
            new = own[:, t] + np.logaddexp(forward[:, t - 1, :1] + field.pairs[0], forward[:, t - 1, 1:] + field.pairs[1])
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        for t in range(long - 2, -1, -1):
            ahead = own[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(ahead[:, :1] + field.pairs[:, 0], ahead[:, 1:] + field.pairs[:, 1])
            backward[:, t] = np.where(there[:, t + 1, None], new, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p_one = np.exp(np.minimum(0, forward[:, :, 1] + backward[:, :, 1] - total[:, None]))
        together = forward[:, :-1, :, None] + field.pairs + (own + backward)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(0, together)) * both).sum((0, 1))
        slope = np.bincount(x.ravel(), weights=np.repeat(((y - p_one) * there).ravel(), wide), minlength=pad + 1)
        slope = np.append(slope, (truth - expected).ravel()) / len(pages) - decay * np.append(field.weights, field.pairs.ravel())
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope ** 2]
        change = rate * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-8)
        field.weights += change[:pad + 1]
        field.weights[pad] = 0
        field.pairs += change[pad + 1:].reshape(2, 2)
    return field.ready()


#: Tags that mark an article, and what is no main text inside one.
_MARKS = frozenset(("article", "main"))
_NOT_IN = frozenset("nav aside footer form".split())
_SAYS_NOT = frozenset(f"says:{n}" for n in ("menu", "advert", "comment", "side", "share", "form", "notice"))


def marked_labels(blocks: Sequence[tuple]) -> list[int]:
    """Labels that a page with an article mark gives itself."""
    out = []
    for _, _, ancestors, _, _ in blocks:
        names = {n for n, _ in ancestors}
        out.append(int(bool(names & _MARKS) and not names & _NOT_IN and not any(says & _SAYS_NOT for _, says in ancestors)))
    return out


def labelled_pages(sources: Sequence[str], made: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    """(features, labels) of made pages and of those sources that mark an article; half of the latter without the mark."""
    rng, out = random.Random(seed), []
    for _ in range(made):
        source, labels = made_page(rng)
        blocks = leaf_blocks(source)
        if len(blocks) == len(labels):
            out.append((block_features(blocks), labels))
    for source in sources:
        blocks = leaf_blocks(source)
        labels = marked_labels(blocks)
        if any(labels):
            hidden = {"in:article", "in:main"} if rng.random() < 0.5 else set()
            out.append(([[f for f in b if f not in hidden] for b in block_features(blocks)], labels))
    return out


def fit(pages: DataFrame, made: int = 400, own: int = 100, longest: int = 200_000, key: str = "page_id", html_column: str = "html",
        seed: int = 11) -> ChainField:
    """A field trained on ``made`` pages of known labels and up to ``own`` pages of the table, chosen by a hash.

    Only whole pages of at most ``longest`` characters are in that sample, so the driver holds ``own`` times as much at most;
    pages are chosen by their hashes alone and then fetched.
    """
    marked = pages.where(F.lower(html_column).rlike("<(article|main)[ >]") & (F.char_length(html_column) <= longest)).select(
        F.xxhash64(F.lit(seed), F.col(key), F.col(html_column)).alias("order"), F.col(html_column).alias("html"))
    chosen = [r["order"] for r in marked.select("order").distinct().orderBy("order").limit(own).collect()]
    sources = [r["html"] for r in marked.where(F.col("order").isin(chosen)).dropDuplicates(["order"]).collect()] if chosen else []
    return train(labelled_pages(sorted(sources), made, seed))


def main_text(pages: DataFrame, field: ChainField, keys: Sequence[str] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """(keys, text, n_blocks, n_main) of every row."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("row"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, all_, main = [], [], []
            for source in part.column(1).to_pylist():
                blocks = leaf_blocks(source)
                labels = field.decode(field.scores(blocks)) if blocks else []
                kept = [b[0] for b, y in zip(blocks, labels) if y]
                texts.append("\n\n".join(kept))
                all_.append(len(blocks))
                main.append(len(kept))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string()), pa.array(all_, pa.int64()), pa.array(main, pa.int64())],
                ["row", "text", "n_blocks", "n_main"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(work, f"row {kind}, text string, n_blocks long, n_main long").select(
        "row.*", "text", "n_blocks", "n_main")
