"""Reading of odd and deep pages in time, and the labeller on pages that its generator did not make."""

import re
import time

import numpy as np
import pytest

from seqlake.llm import html_text as h

#: Pages written by hand after common layouts; main text is between the comments <!--+--> and <!------> .
PAGES = [
    """<!doctype html><html><head><title>Bridge repairs</title><style>p{margin:0}</style></head><body><header class="site-header"><a href="/">City Gazette</a><nav><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/mail">Contact</a></li></ul></nav></header>
    <main><article class="story"><!--+--><h1>Old bridge to close for repairs</h1><p>The council said on Monday that the old stone bridge will be closed for six weeks while its arches are repaired.</p><p>Buses will take the longer road along the river, which adds about ten minutes to the way into town.</p><ul><li>Closed from the first of May</li><li>Open again in the middle of June</li></ul><p>Work of this kind was last done in 1987, when two of the pillars were replaced.</p><!------><div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div></article></main>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/a">Market opens</a></li><li><a href="/b">Rain again</a></li></ul></aside><footer><p>Copyright City Gazette. All rights reserved. Privacy policy</p></footer></body></html>""",
    """<html><body><div id="cookie-banner"><p>We use cookies to improve your experience.</p><button>Accept all</button></div><div class="topnav"><a href=/>Home</a> <a href=/recipes>Recipes</a> <a href=/about>About</a></div>
    <div class="post"><!--+--><h2>Bread with little work</h2><p>Mix flour, water, salt and a little yeast in a bowl, cover it and leave it on the table over night.</p><p>In the morning fold the dough a few times, let it rest for half an hour and heat the oven.</p><blockquote>A wet dough gives the best crust, my grandmother used to say.</blockquote><p>Bake it in a hot pot with the lid on for thirty minutes, then without the lid until it is brown.</p><!------></div>
    <div class="comments"><h3>3 comments</h3><div class="comment"><b>Lea</b><p>Great recipe, thanks for sharing it with us!</p></div><div class="comment"><b>Jon</b><p>I used rye flour and it worked as well.</p></div></div><form action=/sub><label>Subscribe to our newsletter</label><input name=mail><button>Send</button></form><div class="footer">© 2024 Bread blog</div></body></html>""",
    """<body><div class=wrap><div class="menu"><ul><li><a href=1>Start</a><li><a href=2>Archive</a><li><a href=3>Imprint</a></ul></div><div class="ad">Sponsored: buy two shoes and get one free</div>
    <section class="content"><!--+--><h1>Notes on tides</h1><p>The tide rises and falls about twice a day because the moon pulls the water on the near side more than the earth itself.<p>Where a bay narrows, the same water has to go through a smaller opening, so the difference between high and low water grows.<p>Sailors have kept tables of the tides for many hundred years, and some of these are still exact to a few minutes.<!------></section>
    <div class="related"><h4>You may also like</h4><a href=x>On waves</a> <a href=y>On wind</a></div><footer>Terms of use</footer></div></body>""",
]


def main_text(page):
    return " ".join(re.sub("<[^>]*>", " ", page[page.index("<!--+-->") : page.index("<!------>")]).split())


@pytest.fixture(scope="module")
def model():
    return h.train()


def test_pages_of_another_hand(model):
    for page, text in zip(PAGES, h.main_texts(PAGES, model), strict=True):
        have, want = text.split(), main_text(page).split()
        common = sum(min(have.count(w), want.count(w)) for w in set(want))
        assert common / len(want) > 0.95 and common / max(1, len(have)) > 0.95, text


def test_deep_and_long_pages_take_linear_time(model):
    took = {}
    for n in (25_000, 100_000):
        for kind, page in {
            "nested": "<div class=a>x" * n, "nested inline": "<b>x" * n + "</i></b>" * n, "closed": "<div>" * n + "text" + "</div>" * n, "strange ends": "<div>" * n + "</p></span>" * n,
            "no end": "<a " * n, "quotes": "<a 'x" * n + ">", "flat": "<p>some words of prose in a row" * n, "comment": "<!-- " * n, "references": "&amp;" * n,
        }.items():
            start = time.perf_counter()
            blocks = h.read_blocks(page)
            took[kind, n] = time.perf_counter() - start
            if kind == "nested":
                assert len(blocks) == n
    assert all(took[k, 100_000] < max(2.0, 9 * took[k, 25_000]) for k, n in took if n == 25_000), took
    deep = "<div class=a>" * 100_000 + "The one sentence of this page, and it is not a short one." + "</div>" * 100_000
    assert h.main_texts([deep, "<p>some words of prose in a row, and then some more" * 20_000], model)[1].count("prose") > 0


def test_parts_of_a_long_page_give_the_same_scores(model):
    _, _, blocks = h.Pages(3).page()
    blocks = (blocks * 40)[:500]
    x, mask = h.padded([h.vectors(blocks)])
    assert np.allclose(model.scores(x, mask)[:, 0], model.long_scores(blocks, 64), atol=1e-5)


def test_unfinished_markup():
    texts = lambda page: [t for _, _, t, _ in h.read_blocks(page)]
    assert texts("<p>a<b>b</b> < c & d<script>var x = 1") == ["ab < c & d"]
    assert texts("<p>a</p><!-- never closed <p>b") == ["a"]
    assert texts("one<p>two<br>three</p tail") == ["one", "two", "three</p tail"]
    assert texts("a > b <!-- x") == ["a > b"] and texts("") == [] and texts("plain") == ["plain"]
    assert texts("<title>t</title><p>x</p><textarea>no") == ["x"]
