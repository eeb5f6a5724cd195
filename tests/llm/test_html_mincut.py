"""Main text of pages of several builds; the flow against trying all labellings."""

from __future__ import annotations

import itertools
import random
import time

import pytest

from lodestone.llm.html_blocks import blocks
from lodestone.llm.html_mincut import content_cost, edges, extract, lift, main_text, marked, minimum_cut
from lodestone.llm.queries.op4 import op4_html_mincut

SF = "/root/testdata/sf0.001"

PARAGRAPHS = ["First paragraph of the story, with enough words to be one & no more.", "Second paragraph, which goes on for a while and then stops.", "Third one."]


def body(*parts):
    return "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>" + "".join(parts)


ARTICLE = "<article><h1>Title</h1><p><b>First paragraph of the story, with enough words to be one &amp; no more.<br><p>Second paragraph,\n which goes on for a while and then stops.</p><p>Third one.</p></article>"
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
AD = '<!-- ad 1 --><div class="ad">Buy this thing now, it is really cheap and good.</div>'
FOOTER = "<footer>&copy; host &middot; All rights kept by somebody. Imprint</footer></body></html>"
WANT = "\n".join(["Title", *PARAGRAPHS])


@pytest.mark.parametrize("page", [
    body(NAV, AD, ARTICLE, FOOTER),
    body("<header>Site name and its slogan for all</header>", NAV, ARTICLE, '<aside class="sidebar"><p>Most read stories of the week are here for you</p></aside>', FOOTER),
    body('<div id="cookie-notice"><p>We use cookies to make this site better for you, accept all of them.</p><button>OK</button></div>', ARTICLE.replace("</article>", AD + "</article>"), '<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this story a lot, thank you for writing it so well.</p></div></section>', FOOTER),
    body('<div class="header">Site</div>', '<div id="content">' + ARTICLE.replace("article>", "div>") + "</div>", '<form><label>Your mail</label><input name="x"></form>', FOOTER),
    body(NAV, ARTICLE.replace("</p></article>", "")),
    body(NAV, ARTICLE, FOOTER).replace("<body>", '<body class="single has-sidebar post with-comments">'),
    body('<div class="wrap has-sidebar"><ul id="topMenu"><li>Home</li><li>News</li></ul><main><div class="entry-header"><h1>Title</h1></div>', ARTICLE.replace("<h1>Title</h1>", "").replace("article>", "section>"), '</main><ol class="commentlist"><li>A reader says that all of this is very true and good.</li></ol></div>', FOOTER),
    body('<div role="navigation">One | Two | Three</div><div class="post-body">', ARTICLE.replace("article>", "div>"), '<div class="share-buttons">Share this on all of the networks</div></div><div class="adslot">Cheap things for all of you today, come and see.</div>', FOOTER),
])
def test_pages(page):
    assert main_text(page) == WANT


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("<article><p>a &amp b &am c&nbsp;&#233; &lt;p></article>", "a & b &am c é <p>"), ("<article><p>one<p>two <i>th</i>ree", "one\ntwo three"),
    ("<article><p>x<script>y", "x"), ("<article><pre> a\n b </pre><ul><li>c<li>d</ul>", "a b\nc\nd"),
])
def test_markup(page, text):
    assert main_text(page) == text


def test_flow_finds_the_least_cost():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 8)
        excess = [rng.randint(-9, 9) for _ in range(n)]
        joined = [(i, j, rng.randint(1, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def cost(keep):
            return sum(max(e, 0) if not k else max(-e, 0) for e, k in zip(excess, keep)) + sum(w for i, j, w in joined if keep[i] != keep[j])

        assert cost(minimum_cut(excess, joined)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_rows(spark):
    rows = [(1, "http://a", None, 1), (None, None, body(ARTICLE), 2), (3, "u", "", 3), (3, "u", "", 3), (4, "u", body("<article>" + "<p>word by word it goes on</p>" * 3000), 4)]
    out = {(r.page_id, r.n_chars): r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT int")).collect()}
    assert out[1, 0].text == "" and out[None, len(WANT)].text == WANT
    assert out[4, 3000 * 24 - 1].text.count("\n") == 2999
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


SIDEBAR = '<div class="sidebar"><p>Most read stories of the week are here for you</p></div>'
COMMENTS = '<div id="comments">' + "<article><p>I liked this story a lot, thank you for writing it so well.</p></article>" * 9 + "</div>"


@pytest.mark.parametrize("wrapper", [
    '<form method="post" action="./page.aspx">{}</form>', '<div class="sidebar-right">{}</div>', '<div class="content-with-sidebar">{}</div>', '<div id="search-results">{}</div>',
    '<form id="aspnetForm"><div class="layout sidebar-left">{}</div></form>', '<div class="single comments-closed">{}</div>', "<main><p>12 May</p><div class='sidebar-right'>{}</div></main>",
])
def test_hints_on_a_wrapper_of_the_page(wrapper):
    want = WANT if "12 May" not in wrapper else "12 May\n" + WANT
    assert main_text(body(wrapper.format(NAV + AD + ARTICLE + SIDEBAR), FOOTER)) == want
    if "comments" not in wrapper:
        assert main_text(body(wrapper.format(NAV + ARTICLE + SIDEBAR + COMMENTS), FOOTER)) == want


def test_wrappers_without_an_article():
    text = ARTICLE.replace("article>", "div>")
    assert main_text(body("<form>", NAV, text, SIDEBAR, "</form><div>Imprint of us</div>", FOOTER)) == WANT
    assert main_text(body('<div class="sidebar-right">', NAV, text, SIDEBAR, "</div>", FOOTER)) == WANT


@pytest.mark.parametrize("page", [
    body(NAV, ARTICLE, COMMENTS, FOOTER), body(NAV, ARTICLE.replace("article>", "div>"), COMMENTS, FOOTER),
    body('<div class="cookie"><div class="content">We use cookies to make this site better for you.</div></div>', ARTICLE.replace("article>", "div>"), FOOTER),
    body(ARTICLE, '<div class="sidebar">' + "<article><p>Another story that you may like to read as well, if you will.</p></article>" * 4 + "</div>", FOOTER),
    body('<div style="display:none"><article><p>' + "hidden words " * 500 + "</p></article></div>", ARTICLE),
])
def test_hints_that_stay(page):
    assert main_text(page) == WANT


@pytest.mark.parametrize("tag", ["video", "audio", "object", "svg", "canvas", "select", "template"])
def test_missing_end_tags(tag):
    """An element without its end tag hides nothing that follows; one with it is skipped whole, others inside too."""
    first, rest = ARTICLE.split("<p>Second", 1)
    whole = f"<{tag} a='>'>unseen <{tag}>words</{tag}> too</{tag}>"
    assert main_text(body(NAV, f"{first}<{tag} x='1'><p>Second{rest}", FOOTER)) == WANT
    assert main_text(body(NAV, f"{first}<{tag}><p>Second{rest}{whole}", FOOTER)) == WANT
    assert main_text(body(NAV, f"{first}{whole}<!-- </{tag}> <{tag}> --><{tag}/><p>Second{rest}", FOOTER)) == WANT


def test_formulas_are_text():
    page = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='t'>\\x</annotation></math> holds.<p>It <math><mi>y</mi> ends.</article>"
    assert main_text(page) == "So x=2 holds.\nIt y ends."


@pytest.mark.parametrize("name", ["commentary", "legal-analysis", "navigable-places", "promontory", "relatedness", "adsorption", "footnote-story"])
def test_words_that_only_begin_like_a_hint(name):
    assert main_text(body(NAV, f'<div class="{name}">', ARTICLE.replace("article>", "div>"), "</div>", FOOTER)) == WANT


@pytest.mark.parametrize("name", ["commentlist", "comment-form", "adslot", "relatedPosts", "sidebarRight", "cookiebar", "newsletterSignup", "legal", "adsbygoogle"])
def test_hints_written_together(name):
    assert main_text(body(NAV, ARTICLE.replace("article>", "div>"), f'<div class="{name}"><p>Some words that are no part of the story at all</p></div>', FOOTER)) == WANT


def test_a_stray_quote_in_a_tag():
    assert main_text(body(NAV, ARTICLE.replace("<p>Third", '<p title="5" tall">Third'), FOOTER)) == WANT
    assert main_text(body(NAV, ARTICLE.replace("<p>Third", "<p class=x don't>Third"), FOOTER)) == WANT
    assert main_text(body(NAV, ARTICLE.replace("<p>Third", '<p title = "a > b" lang=en>Third'), FOOTER)) == WANT


def plain_cut(excess, joined):
    """The least set on the source's side, by one shortest path of the residual graph at a time."""
    source, sink, room = len(excess), len(excess) + 1, {}
    for i, j, w in joined:
        room[i, j] = room.get((i, j), 0) + w
        room[j, i] = room.get((j, i), 0) + w
    for i, e in enumerate(excess):
        room[source, i], room[i, sink], room[i, source], room[sink, i] = max(e, 0), max(-e, 0), 0, 0
    out = {}
    for a, b in room:
        out.setdefault(a, []).append(b)
    while True:
        came, todo = {source: None}, [source]
        for a in todo:
            for b in out.get(a, []):
                if b not in came and room[a, b]:
                    came[b] = a
                    todo.append(b)
        if sink not in came:
            return [i in came for i in range(len(excess))]
        path = [sink]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        least = min(room[a, b] for b, a in itertools.pairwise(path))
        for b, a in itertools.pairwise(path):
            room[a, b] -= least
            room[b, a] += least


def test_flow_against_a_plain_one():
    rng = random.Random(6)
    for _ in range(300):
        n, top = rng.randint(1, 40), rng.choice([2, 12, 60])
        excess = [rng.randint(-top, top) for _ in range(n)]
        joined = [(max(0, i - rng.randint(1, 5)), i, rng.choice([3, 6, 12, 24])) for i in range(1, n) for _ in range(2)]
        assert minimum_cut(excess, joined) == plain_cut(excess, joined)


def test_the_query_against_a_plain_cut(spark):
    """The registered query over all pages, and the same blocks labelled by the plain flow."""
    got = {r.page_id: (r.text, r.n_chars) for r in op4_html_mincut(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for page in pages:
        found = blocks(page.html or "")
        lift(found)
        kept = plain_cut([content_cost(b, marked(found)) for b in found], edges(found))
        text = "\n".join(b.text for b, k in zip(found, kept) if k)
        assert got[page.page_id] == (text, len(text))
    assert len(got) == len(pages) > 40


@pytest.mark.parametrize("page", [
    "<article>" + "<div>text of some words here <div class='ad'>x</div>" * 100_000, "<form>" * 3000 + "<article>" + "<p>text of some words here</p></x>" * 100_000,
    "<div>" + "<p>Few words.</p>" * 100_000, "<div class='comment sidebar'>" * 20_000 + "<p>words</p>" * 1000 + "<article>" + "<p>text of some words here</p>" * 20_000,
])
def test_very_many_blocks(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 60
