"""HTML extraction: held-out accuracy, brute-force decoding, odd pages."""

import html
import itertools
import random
import re

from tallyspark.llm import html_extraction as X
from tallyspark.llm.html_pages import labelled_pages, leaf_blocks

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def test_held_out_accuracy():
    label = X.trained_field().scorer()
    right = n = 0
    for page, want in labelled_pages(400, X.TEST_SEED):
        got = label(leaf_blocks(page))
        assert len(got) == len(want)
        right, n = right + sum(a == b for a, b in zip(got, want)), n + len(want)
    assert right >= 0.98 * n


def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(1)
    for _ in range(60):
        s = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 7))]
        pairs = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        start = [rng.uniform(-1, 1) for _ in range(2)]

        def value(y):
            return start[y[0]] + sum(a for a, b in zip(s, y) if b) + sum(pairs[a][b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=len(s)), key=value)
        assert X.viterbi(s, pairs, start) == list(best)


def test_whole_table(spark):
    """The pages' articles, taken out by their tag."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in X.extracted(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inside))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_blocks():
    def texts(page):
        return [b.text for b in leaf_blocks(page)]

    assert texts("") == texts("  \n") == texts("<!-- a") == texts("<script>var t='</p>';") == []
    assert texts("<p>a</p><script src='a.js'/>var x=1;</script><p>b<style/>p{}</style>") == ["a", "b"]
    assert texts("<p>a<svg viewBox='0 0 1 1'><path d='m'/><text>no</text></svg>b</p>") == ["ab"]
    assert texts("<article><p>a</p><svg><path d='m'><p>b</p><div>c</div></article>d") == ["a", "b", "c", "d"]
    assert texts("<p>a<math><mi>x</p><p>b<svg/>c<math/>d<SVG><g>e</p>f") == ["a", "bcd", "f"]
    assert texts("a &amp;amp; b&nbsp;&nbsp;c &lt;p&gt; &#233; &bogus; 1 < 2") == ["a &amp; b c <p> é &bogus; 1 < 2"]
    assert texts("<p><b>one<br><p>two<i>x</i>y</b> z") == ["one", "twoxy z"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<P CLASS='x>y'>q</P><div title=\"a\n<b>\">r</div><p unclosed='>s</p>t") == ["q", "r", "s", "t"]
    assert texts("<head><title>no</title></head><body>yes<style>p{}</style>\n no</body>") == ["yes no"]
    assert texts("<head><title>no<body>yes") == ["yes"]
    assert texts("<head><meta charset=x><title>no</title><link rel=y><p>yes") == ["yes"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert [b.link_chars for b in leaf_blocks("<p><a href=x>ab</a>c</p>")] == [2]
    deep = leaf_blocks("<div>" * 5000 + "x" + "</div>" * 5000)
    assert [b.text for b in deep] == ["x"] and len(deep[0].path) <= 400
    assert texts("<" * 20000) == ["<" * 20000]


PAGE = """<html><head><title>T</title></head><body><header class="site-header"><h1>The Site</h1></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p><button>Accept all</button></div>
<div class="layout"><div class="post-content"><h1>Title</h1><p>First of all, a long paragraph that tells what happened in the town.</p>
<div class="ad">Buy now and save</div><p>Short one.</p><ul><li>point one of the list</li><li>point two of the list</li></ul></div>
<div class="sidebar"><h3>Related articles</h3><ul><li><a href="/1">Another story</a></li></ul></div></div>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this very much, thank you for writing it.</p></div></section>
<form class="search"><label>Search</label><input><button>Go</button></form><footer>&copy; 2024 All rights reserved.</footer></body></html>"""


def test_page_without_article_tag(spark):
    rows = [(1, "u", PAGE, "x", "y"), (2, None, None, "x", "y"), (None, "u", "", None, None), (1, "u", PAGE, "x", "y"),
            (3, "u", "<article>" + "<p>word here.</p>" * 20000 + "</article>", "x", "y")]
    got = X.extracted(spark.createDataFrame(rows, SCHEMA)).collect()
    want = ("Title\nFirst of all, a long paragraph that tells what happened in the town.\nShort one.\n"
            "point one of the list\npoint two of the list")
    assert sorted(((r.page_id or 0), r.url, r.text, r.n_chars) for r in got if r.page_id != 2 and r.page_id != 3) == [
        (0, "u", "", 0), (1, "u", want, len(want)), (1, "u", want, len(want))]
    by_id = {r.page_id: r for r in got}
    assert by_id[2].text == "" and by_id[2].url is None and by_id[3].text == "\n".join(["word here."] * 20000)
    assert X.extracted(spark.createDataFrame([], SCHEMA)).count() == 0


#: Pages labelled by hand, of layouts that `html_pages` does not make: (page, text of the article).
BY_HAND = [
    (
        """<!doctype html><html><head><title>T</title></head><body class=home><div id=top><a href=/>Site</a> | <a href=/a>A</a> | <a href=/b>B</a></div>
        <table><tr><td class=leftcol><b>Sections</b><br><a href=/1>One</a><br><a href=/2>Two</a></td><td class=story><h1>Storm closes harbour</h1>
        <p>The harbour closed on Monday after a storm damaged two piers and a crane, the port said.</p><p>Ferries were moved to the next town, where passengers waited for hours.</p>
        <p>Repairs will take until spring, according to the engineers who inspected the site.</p></td></tr></table>
        <div class=bottom>&copy; 1999 The Site. <a href=/legal>Legal</a></div></body></html>""",
        ["Storm closes harbour", "The harbour closed on Monday after a storm damaged two piers and a crane, the port said.",
         "Ferries were moved to the next town, where passengers waited for hours.", "Repairs will take until spring, according to the engineers who inspected the site."],
    ),
    (
        """<body><div class="cookie-bar">We value your privacy. <button>OK</button></div><header role=banner><nav><ul><li><a href=/>Home</a><li><a href=/r>Recipes</a></ul></nav></header>
        <main><div class=entry-content><h2>Bread in three steps</h2><ol><li>Mix flour, water and salt, and let the dough rest for an hour.<li>Fold it twice and leave it in the cold overnight.
        <li>Bake it in a hot oven until the crust is dark.</ol><div class="ad-slot">Advertisement</div><blockquote>Good bread needs time more than anything else.</blockquote></div></main>
        <section id=comments><h3>2 comments</h3><div class=comment><p>Anna</p><p>I tried this and my loaf came out far too dense, what did I do wrong?</p></div></section>
        <footer><p>All rights reserved.</p></footer></body>""",
        ["Bread in three steps", "Mix flour, water and salt, and let the dough rest for an hour.", "Fold it twice and leave it in the cold overnight.",
         "Bake it in a hot oven until the crust is dark.", "Good bread needs time more than anything else."],
    ),
    (
        """<html><body><div class="page-wrap"><div class="sidebar-left"><h4>Tags</h4><a href=/t1>sea</a> <a href=/t2>wind</a></div><div class="post-body" itemprop="articleBody">
        <p>Seen from above, the delta looks like a tree whose branches end in the sea.</p><figure><img src=d.jpg><figcaption>The delta in May</figcaption></figure>
        <p>Each flood moves the branches a little, and old maps are soon of no use.</p></div><div class="share-links">Share Tweet Mail</div>
        <div class="related-posts"><h3>You may also like</h3><ul><li><a href=/x>Rivers of the north</a></li><li><a href=/y>Maps and their makers</a></li></ul></div></div></body></html>""",
        ["Seen from above, the delta looks like a tree whose branches end in the sea.", "The delta in May", "Each flood moves the branches a little, and old maps are soon of no use."],
    ),
]


def test_pages_labelled_by_hand():
    """Layouts that the training pages do not have, reported apart: nine blocks in ten are right."""
    label = X.trained_field().scorer()
    right = n = 0
    for page, article in BY_HAND:
        blocks = leaf_blocks(page)
        assert set(article) <= {b.text for b in blocks}
        for b, got in zip(blocks, label(blocks)):
            right += bool(got) == (b.text in article)
            n += 1
    print(f"{right} of {n}")
    assert right >= 0.9 * n
