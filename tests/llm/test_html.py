import itertools
import random
import re
import time
from html import unescape

from folioscope.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="ad-free">
<header>Site head</header><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- c --><div class="ad">Buy this great thing now, it is on sale today for everyone.</div>
<div id="cookie-notice"><p>We use cookies to make this site work well for you and for all.</p></div>
<article><h1>Title &amp; more</h1><p><b>First para.<br>second   line&nbsp;x<p>Short.</p><ul><li>One<li>Two</ul><p>Another long paragraph of the article that has a <a href="#">link</a> in it.</p>
<form><p>Please enter your mail address here to get our letters each week.</p></form>
<section class="comments"><article><p>Reader: I liked this article so much that I read it twice today.</p></article></section></article>
<aside><p>Other stories that you may like to read on this site today.</p></aside><footer>&copy; site</footer>"""


def test_page():
    assert H.main_text(PAGE) == "Title & more\n\nFirst para. second line x\n\nShort.\n\nOne\n\nTwo\n\nAnother long paragraph of the article that has a link in it."


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p>") == H.main_text("<script>x") == H.main_text("<article><p") == H.main_text("<!-- x") == ""
    assert H.main_text("<body><p>A page without an article but with one long paragraph of text.") == "A page without an article but with one long paragraph of text."
    assert H.main_text("a < b and c > d holds for every pair of numbers in this text here.") == "a < b and c > d holds for every pair of numbers in this text here."
    assert H.main_text("<p title='a>b'>Text with an attribute that holds a sign, long enough to count here.</p>").startswith("Text with")
    assert len(H.main_text("<article>" + "<p>word word word word.</p>" * 20_000 + "</article>").split("\n\n")) == 20_000


def test_names_that_only_look_like_boilerplate():
    keep = "The paragraph about search in lists, which is part of the article, has words enough."
    for page in (f'<div class="main-content header-fixed"><p>{keep}</p></div>', f'<article><section id="search"><p>{keep}</p></section></article>', f'<article><h1>Title</h1><p class="notice">{keep}</p></article>', f'<article><h1>Title</h1><div class="copyright-law">{keep}</div></article>'):
        assert H.main_text(page).endswith(keep)


def test_scanning_is_one_pass():
    for page in ("<a x" * 20_000, '<a x="' * 20_000, "<!--" * 20_000, "<script>" * 20_000, "<div>" * 10_000 + "</section>" * 10_000, "<p x='\">" * 20_000, "<" * 80_000, "</" * 40_000):
        began = time.process_time()
        H.blocks_of(page)
        assert time.process_time() - began < 2, page[:20]


def test_quotes_and_references():
    texts = lambda page: [b.text for b in H.blocks_of(page)]
    assert texts('<p>one <a href="x>two</a> three</p>') == ["one two three"]
    assert texts("<p title=\"a>b\" class='c>d'>x &lt; y &#x41;&#66;&eacute;&nbsp;z</p>") == ["x < y ABé z"]
    assert texts("<p>it's <b>5\" long</b>, isn't it") == ["it's 5\" long, isn't it"]
    assert texts("a<br>b<SCRIPT>no</Script >c<style>p{}</style><p>d</p><textarea>no</textarea>") == ["a bc", "d"]
    assert texts("<ul><li>one<li>two <b>bold</ul>three") == ["one", "two bold", "three"]


def test_the_cut_changes_labels_for_the_better():
    model, rnd = H.fitted(), random.Random(77)
    total = sign = cut = flipped = 0
    for _ in range(150):
        blocks, labels = H.sample_page(rnd)
        costs, kept = model.costs(blocks), model.keep(blocks)
        total += len(blocks)
        sign += sum((c > 0) != t for c, t in zip(costs, labels))
        cut += sum(k != t for k, t in zip(kept, labels))
        flipped += sum((c > 0) != k for c, k in zip(costs, kept))
    assert flipped > 20 and cut < sign and cut < 0.05 * total


def test_min_cut_is_cheapest():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randrange(1, 9)
        costs = [rnd.choice([-1, 1]) * rnd.random() * 3 for _ in range(n)]
        edges = [(i, j, rnd.random()) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
        price = lambda x: sum(-c if k and c < 0 else c if not k and c > 0 else 0 for c, k in zip(costs, x)) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: E731, B023
        assert abs(price(H.min_cut(costs, edges)) - min(map(price, itertools.product([False, True], repeat=n)))) < 1e-9


def plain_article(html):
    """Text of the article element of these simple pages, without the parser of the operator."""
    inner = html.split("<article>")[1].split("</article>")[0]
    blocks = [re.sub("<[^>]*>", "", x.replace("<br>", " ")) for x in re.split("</?(?:p|h1)>", inner)]
    return "\n\n".join(filter(None, (" ".join(unescape(x).split()) for x in blocks)))


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t", 3), (2, None, None, "t", 3), (None, "v", "", "t", 3), (1, "u", PAGE, "t", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and got[0] == got[3] and got[1].text == ""
    assert H.extract(pages.limit(0)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in real:  # these pages hold an article element; its blocks are the main text
        assert H.main_text(r.html) == plain_article(r.html)
