import itertools
import math
import random
import time

from tessera.llm import html_extract as hx

SEMANTIC = """<!DOCTYPE html><html><head><title>T - Site</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="top"><a href="/">Site</a><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav></header>
<div id="cookie-notice"><p>We use cookies to improve this site. Please accept them all.</p><button>OK</button></div>
<main><article class="post"><header><h1>A  title &amp;
more</h1></header><p>First <b>bold</b> words&nbsp;here, and&#33; more<br>after a break.<p>Second paragraph <a href=x>with a link</a> in it.
<aside class="related"><p>Related: another story that you may like to read today.</p></aside>
<div class="ad-banner">Buy now, the best offer of the year for everyone who reads this.</div>
<blockquote>Quoted words from somebody.</blockquote><pre>x =  1</pre>
<form><label>Mail</label><input name=q>Sign up for our letters every week.</form>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I read this whole story and I think that it is a very fine one, thank you for it.</p></div></section>
</article></main><aside><p>Side text that goes on for a while, with some words of its own here.</p></aside>
<footer><p>Copyright 2024. All rights reserved by the people of the site.</p></footer></body></html>"""
WANT = ["A title & more", "First bold words here, and! more after a break.", "Second paragraph with a link in it.", "Quoted words from somebody.", "x = 1"]

DIVS = """<body><div class="navbar"><a href=1>One</a> | <a href=2>Two</a></div><div id="wrapper"><div class="content">
<h2>Heading</h2><p>A paragraph with a good number of words in it, so that it reads as text.</p><p>Short.</p><p>Another paragraph of the same story, long enough to stand alone.</p>
<div class="share-buttons">Share this on all the networks that you know</div></div><div class="sidebar"><ul><li><a href=3>Three</a></li></ul></div></div><div id="footer">Imprint and contact</div>"""

PLAIN = "<p>Just some text without any frame, which is all that there is on this page.<p>And one more paragraph of it, as plain as the first one."


def test_pages():
    assert hx.main_text(SEMANTIC) == "\n\n".join(WANT)
    assert hx.main_text(DIVS).split("\n\n") == ["Heading", "A paragraph with a good number of words in it, so that it reads as text.", "Short.", "Another paragraph of the same story, long enough to stand alone."]
    assert len(hx.main_text(PLAIN).split("\n\n")) == 2
    assert hx.main_text("<nav>a</nav><footer>b</footer>") == ""
    assert hx.main_text("<article><p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert hx.main_text("<article>" + "<div>" * 3000 + "deep words") == "deep words"
    assert hx.main_text("<article><p>a < b &lt;i&gt; &bogus; <!-- c --> <p>d</article") .startswith("a < b <i> &bogus;")


STORY = "This is a long paragraph of the story, with many words in it, and it goes on and on to its end. " * 3
NAMED = f"""<body><nav><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></nav><div class="%s"><h1>Some title here</h1><p>{STORY}</p>
<p>Yes.</p><p>{STORY}</p></div><footer>&copy; the site</footer></body>"""


def test_no_name_takes_an_article_away():
    for name in ("print", "tags", "post meta", "legal", "discussion", "page form", "side", "story share", "comments", "sidebar", "ad", ""):
        got = hx.main_text(NAMED % name)
        assert STORY.strip() in got and "One" not in got and "the site" not in got, name
    assert hx.main_text(f"<body><p><a href=x>{STORY}</a></p>") == STORY.strip()
    for tag in ("svg", "math"):
        assert STORY.strip() in hx.main_text(f"<body><{tag}><path><p>{STORY}<p>{STORY}")


def test_the_cut_mends_what_the_classifier_gets_wrong_alone():
    model = hx.fit()
    pages = [(hx.parse(html), truth) for html, truth in hx.labelled_pages(200, 4321)]  # seen by no fit
    wrong = lambda smooth: sum(a != b for blocks, truth in pages for a, b in zip(hx.labels(blocks, hx.Model(model.weights, smooth)), truth))
    alone, cut, n = wrong(0.0), wrong(model.smooth), sum(len(t) for _, t in pages)
    assert model.smooth > 0 and cut < alone and cut < 0.06 * n


def test_labels_are_the_cheapest_labelling():
    """The whole result against all labellings, costs and edges written out again."""
    model = hx.fit()
    for html, _ in hx.labelled_pages(400, 77):
        blocks = hx.parse(html)
        if len(blocks) > 11:
            continue
        odds = [sum(w * x for w, x in zip(model.weights, f)) for f in hx.features(blocks)]
        edges = [(i - 1, i, int(1000 * model.smooth / blocks[i].apart)) for i in range(1, len(blocks))]
        for i in range(len(blocks)):
            same = [j for j in range(i) if blocks[j].node is blocks[i].node]
            if same and same[-1] < i - 1:
                edges.append((same[-1], i, int(1000 * model.smooth / 2)))
        cost = lambda x: int(1000 * math.log1p(math.exp(x)))
        price = lambda s: sum(cost(-o) if k else cost(o) for o, k in zip(odds, s)) + sum(c for i, j, c in edges if s[i] != s[j])  # noqa: B023, E731
        assert price(hx.labels(blocks, model)) == min(map(price, itertools.product([True, False], repeat=len(blocks))))


def test_hostile_pages_take_linear_time():
    for f in ("<div>" * 8000 + "x", "<span>" * 20_000 + "hello there", "<div>t " * 8000, "<ul>" + "<div>" * 5000 + "<li>a b" * 5000):
        began = time.process_time()
        hx.main_text(f)
        assert time.process_time() - began < 5


def test_minimum_cut_matches_all_labellings():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        a, b = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda s: sum(b[i] if s[i] else a[i] for i in range(n)) + sum(c for i, j, c in edges if s[i] != s[j])  # noqa: B023, E731
        assert cost(hx.min_cut(n, a, b, edges)) == min(map(cost, itertools.product([True, False], repeat=n)))


def test_rows(spark):
    rows = [(1, "u", SEMANTIC, "c"), (1, "u", SEMANTIC, "c"), (2, None, None, "c"), (None, "v", "", None), (3, "w", PLAIN, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = hx.extract(df).collect()
    assert [r["page_id"] for r in got] == [1, 1, 2, None, 3]
    assert [r["text"] for r in got[:4]] == ["\n\n".join(WANT)] * 2 + ["", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert hx.extract(df.limit(0)).count() == 0
