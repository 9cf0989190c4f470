import itertools
import random

import numpy as np
import pytest

from fairlineage.llm import html_crf as H
from fairlineage.llm.html_pages import page


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return H.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def texts(source):
    return [b[0] for b in H.leaf_blocks(source)]


def test_reader():
    assert texts("<p>a &amp; b<br>c <b>d</b>e<p>f<!-- g --><script>'</p>'</script>h</p>tail") == ["a & b c de", "fh", "tail"]
    assert texts("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == ["one", "two", "x", "y"]
    assert texts("<div>a<select><option>no</select> b<textarea><p>no</textarea></div><style>no") == ["a b"]
    assert texts("") == texts("<p> \n </p>") == [] and texts("plain &lt;x&gt; &am &copy") == ["plain <x> &am ©"]
    assert texts("<p class='a>b'>x</p><p") == ["x"]
    tags = [(b[1], [t for t, _ in b[2]]) for b in H.leaf_blocks("<article><h1>t</h1><p>x<div>y</div></article><p>z")]
    assert tags == [("h1", ["article", "h1"]), ("p", ["article", "p"]), ("div", ["article", "div"]), ("p", ["p"])]


def test_decode_is_the_best_labelling(field):
    rng = random.Random(2)
    for _ in range(50):
        scores = [rng.gauss(0, 3) for _ in range(7)]
        worth = lambda y: sum(s * l for s, l in zip(scores, y)) + sum(field.pairs[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=7), key=worth)
        assert worth(field.decode(scores)) == pytest.approx(worth(best))


def test_training_slope_is_of_the_likelihood():
    """One step from zero moves weights along the difference of seen and expected features."""
    pages = [([["x"], ["z"], ["x"]], [1, 0, 1])] * 3
    field = H.train(pages, rounds=40)
    w = dict(zip(field.names, field.weights))
    assert w["x"] > 0 > w["z"]
    assert field.decode(field.weights[[field.names["x"], field.names["z"], field.names["x"]]].tolist()) == [1, 0, 1]


def test_held_out_layouts(field):
    rng, right, whole = random.Random(77), [], []
    for _ in range(200):
        source, labels = page(rng)
        blocks = H.leaf_blocks(source)
        assert len(blocks) == len(labels)
        got = field.decode(field.scores(blocks))
        right += [a == b for a, b in zip(got, labels)]
        whole.append(got == labels)
    assert np.mean(right) > 0.98 and np.mean(whole) > 0.85


def test_pages(spark, sf_dir, field):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in H.main_text(pages, field).collect()}
    for r in pages.collect():
        blocks = H.leaf_blocks(r["html"])
        want = [b[0] for b in blocks if any(t == "article" for t, _ in b[2])]
        assert got[r["page_id"]]["text"] == "\n\n".join(want) and got[r["page_id"]]["url"] == r["url"]
        assert got[r["page_id"]]["n_blocks"] == len(blocks)


def test_edges(spark, field):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<nav><a href='/'>Home</a></nav>", "x"), (2, "u", "<p>" + "Long words here. " * 20_000, "x"),
            (2, "u", "<p>" + "Long words here. " * 20_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row string")
    got = H.main_text(pages, field).collect()
    assert len(got) == 5 and sorted(len(r["text"]) for r in got) == [0, 0, 0, 339_999, 339_999]
    assert H.main_text(pages.where("false"), field).collect() == []
    assert H.fit(pages.where("false"), made=30).names


def test_no_page_holds_a_worker():
    import time

    start = time.time()
    for source in ("<a " * 300_000 + '"', "<a '" * 200_000, "<title>" * 150_000, "<!-" * 300_000, "<p x=\"" * 150_001, "<svg><button>" * 80_000):
        H.leaf_blocks(source)
    assert time.time() - start < 20
    assert texts('<p a="b>c</p>d<p>e') == ["c", "d", "e"] and texts("<p>a<title>b<p>c") == ["ab", "c"]


def test_longer_pages_are_no_training_pages(spark):
    rng = random.Random(4)
    rows = [(i, "<article>" + "word " * 50 + "</article>" + "<p>x</p>" * rng.randint(0, 3)) for i in range(6)]
    rows.append((9, "<article>" + "long " * 50_000 + "</article>"))
    frame = spark.createDataFrame(rows, "page_id long, html string")
    seen = []
    kept, H.labelled_pages = H.labelled_pages, lambda sources, made, seed: seen.append(list(sources)) or kept([], made, seed)
    try:
        H.fit(frame, made=3, own=4)
    finally:
        H.labelled_pages = kept
    assert len(seen[0]) == 4 and all(s in [h for _, h in rows[:6]] for s in seen[0])
