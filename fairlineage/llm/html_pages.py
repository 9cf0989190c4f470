"""Labelled pages to train on: layouts whose blocks are known to be main text or not, filled with words at random.

Each layout is a list of (html, label of the text inside); label None is markup without text of its own.
"""

from __future__ import annotations

import random

_SYLLABLES = "ra to mi ne lu sa vo ke di pa or en ist al un the ver ci mar lon".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3))))


def _phrase(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_word(rng) for _ in range(rng.randint(low, high)))


def _sentences(rng: random.Random, low: int, high: int) -> str:
    words, out = rng.randint(low, high), []
    while words > 0:
        n = min(words, rng.randint(1, 16))
        out.append(_phrase(rng, n, n).capitalize() + rng.choice((".", ".", ".", "?", "!")))
        words -= n
    return " ".join(out)


def _paragraphs(rng: random.Random, tag: str = "p") -> list[tuple[str, int]]:
    out = []
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.08:
            out.append((f"<h2>{_phrase(rng, 1, 6).capitalize()}</h2>", 1))
        elif kind < 0.14:
            out += [(f"<ul><li>{_sentences(rng, 2, 14)}</li>", 1), (f"<li>{_phrase(rng, 1, 9)} <a href='/x'>{_word(rng)}</a></li></ul>", 1)]
        elif kind < 0.18:
            out.append((f"<blockquote>{_sentences(rng, 4, 40)}</blockquote>", 1))
        elif kind < 0.25:
            out.append((f"<{tag}>{_sentences(rng, 1, 3)}</{tag}>", 1))
        else:
            link = f" <a href='/l'>{_phrase(rng, 1, 3)}</a> {_sentences(rng, 1, 9)}" if rng.random() < 0.3 else ""
            bold = rng.choice(("", "", "<b>"))
            out.append((f"<{tag}>{bold}{_sentences(rng, 6, 130)}{link}</{tag}>", 1))
    return out


def _menu(rng: random.Random, before: str, after: str) -> list[tuple[str, int | None]]:
    items = [(f"<li><a href='/{_word(rng)}'>{_phrase(rng, 1, 2)}</a></li>", 0) for _ in range(rng.randint(2, 8))]
    return [(before + "<ul>", None), *items, ("</ul>" + after, None)]


def _around(rng: random.Random, before: str, after: str, low: int = 2, high: int = 25, times: int = 1) -> list[tuple[str, int]]:
    return [(f"{before}{_sentences(rng, low, high)}{after}", 0) for _ in range(times)]


def _comments(rng: random.Random, box: str, each: str) -> list[tuple[str, int | None]]:
    out = [(f"<{box}><h3>{rng.randint(1, 40)} {rng.choice(('Comments', 'Replies', 'Responses'))}</h3>", 0)]
    for _ in range(rng.randint(1, 5)):
        out.append((f"<{each}><p>{_sentences(rng, 3, 60)}</p></{each.split()[0]}>", 0))
    return [*out, (f"</{box.split()[0]}>", None)]


def page(rng: random.Random) -> tuple[str, list[int]]:
    """One page and the labels of its blocks in order."""
    parts: list[tuple[str, int | None]] = [("<!DOCTYPE html><html><head><title>x</title></head><body>", None)]
    if rng.random() < 0.5:
        parts += _around(rng, rng.choice(("<header class='site-header'>", "<div id='masthead'>", "<header>", "<div class='topbar'>")),
                         rng.choice(("</header>", "</div>")), 1, 8)
    nav = rng.choice((("<nav>", "</nav>"), ("<div class='menu'>", "</div>"), ("<div id='navigation'>", "</div>"),
                      ("<nav class='breadcrumb'>", "</nav>"), ("<div class='navbar'>", "</div>")))
    if rng.random() < 0.9:
        parts += _menu(rng, *nav)
    if rng.random() < 0.35:
        parts += _around(rng, rng.choice((
            "<div class='cookie-notice'>We use cookies. ", "<div class='consent'>", "<div role='alert' class='notice'>",
            "<div class='newsletter'>Subscribe to our newsletter. ")), "</div>", 3, 30)
    if rng.random() < 0.5:
        parts += _around(rng, rng.choice(("<div class='ad'>", "<div class='advert'>", "<div class='sponsored'>", "<aside class='promo'>",
                                          "<div id='banner-ad'>")), rng.choice(("</div>", "</aside></div>")), 2, 30)
    body = rng.choice((
        ("<article>", "</article>"), ("<article class='post'>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
        ("<div class='article-body'>", "</div>"), ("<div id='content'>", "</div>"), ("<div class='entry-content'>", "</div>"),
        ("<div class='story'>", "</div>"), ("<div>", "</div>"), ("<section class='post-text'>", "</section>"), ("<table><tr><td>", "</td></tr></table>")))
    head = [(f"<h1>{_phrase(rng, 2, 12).capitalize()}{rng.choice(('', '.'))}</h1>", 1)] if rng.random() < 0.9 else []
    text = _paragraphs(rng, "div" if rng.random() < 0.08 else "p")
    if rng.random() < 0.25:
        text[rng.randint(0, len(text)):0] = _around(
            rng, rng.choice(("<div class='ad'>", "<aside>", "<div class='related'>", "<div class='share-buttons'>",
                             "<form action='/s'>", "<div class='subscribe'>")),
            rng.choice(("</div>", "</aside></div>")).replace("</div>", "</div></aside></form>"), 2, 20)
    inner = _comments(rng, *rng.choice((("section class='comments'", "div class='comment'"), ("div id='comments'", "div"),
                                        ("div class='reader-comments'", "article class='comment'"), ("ol class='commentlist'", "li class='reply'")))) \
        if rng.random() < 0.4 else []
    inside = rng.random() < 0.4
    parts += [(body[0], None), *head, *text, *(inner if inside else []), (body[1], None), *([] if inside else inner)]
    if rng.random() < 0.4:
        parts += _menu(rng, rng.choice(("<aside class='sidebar'>", "<div id='sidebar'>", "<aside>", "<div class='widget related-posts'>")),
                       rng.choice(("</aside>", "</div>")))
    if rng.random() < 0.3:
        parts += _around(rng, rng.choice(("<form class='search'>", "<form id='login'><p>", "<form><label>")), "</form>", 1, 8)
    if rng.random() < 0.2:
        parts += _around(rng, rng.choice(("<aside>", "<div class='sidebar'>")), rng.choice(("</aside>", "</div>")), 5, 40)
    if rng.random() < 0.9:
        parts += _around(rng, rng.choice(("<footer>", "<div class='footer'>", "<div id='site-footer'>", "<footer><p>"))
                         + rng.choice(("&copy; ", "Copyright 2020 ", "", "All rights reserved. ")), rng.choice(("</footer>", "</div>")), 1, 20)
    parts.append(("</body></html>", None))
    return "".join(h for h, _ in parts), [y for _, y in parts if y is not None]
