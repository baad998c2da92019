"""Main text of pages: the cut against brute force, and pages of every awkward kind."""

import itertools
import random

import pytest

from tallyhouse.llm import html_text
from tallyhouse.llm.common import ship, table
from tallyhouse.llm.html_text import main_text

LONG = "This is a long enough paragraph of the story, with many words in it, that ends here."


def test_cut_is_the_cheapest_labelling():
    pick = random.Random(6)
    for _ in range(150):
        n = pick.randint(1, 8)
        source = [pick.choice([0, 1, 2.5, pick.random() * 4]) for _ in range(n)]
        sink = [pick.choice([0, 1, 2.5, pick.random() * 4]) for _ in range(n)]
        arcs = [(*pick.sample(range(n), 2), pick.random() * 2) for _ in range(pick.randint(0, 10))
                if n > 1]

        def cost(label, source=source, sink=sink, arcs=arcs):
            return sum(b if x else a for x, a, b in zip(label, source, sink, strict=True)) + sum(
                c for i, j, c in arcs if label[i] != label[j])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_text.minimum_cut(source, sink, arcs)) == pytest.approx(best)


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style>
    <script>var t = "</p><p>{LONG}</p>";</script></head><body><header><a href=x>Site</a></header>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
    <div class="cookie-notice"><p>{LONG}</p></div><!-- <p>{LONG}</p> -->
    <div class="ad">{LONG}</div><aside><p>{LONG}</p></aside>
    <article><header><h1>Title&nbsp;&amp; more</h1></header><p><b>One<br>two
    &eacute;&#233;&#xe9 <i>in</i>line<p>{LONG}</p><p>Short.</p>
    <form><p>{LONG}</p></form></article>
    <section id="comments"><article><p>{LONG}</p></article></section>
    <div class="sidebar"><p>{LONG}</p></div><footer>&copy; 2020 {LONG}</footer></body></html>"""
    assert main_text(page) == f"Title & more\n\nOne two ééé inline\n\n{LONG}\n\nShort."


def test_page_without_named_containers():
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h2>Title here</h2><p>{LONG}</p>" \
           f"<p>Short one.</p><p>{LONG}</p></div><div><a href=3>About us</a></div>"
    assert main_text(page) == f"Title here\n\n{LONG}\n\nShort one.\n\n{LONG}"


@pytest.mark.parametrize("page", [
    None, "", "   ", "<", "<p", "<!--", "<script>", "</", "<a href='x", "<" * 5000, "<div>" * 5000,
    "</div>" * 100, "&" * 100, "<nav>menu</nav>", "<p a='\">x", "\x00<\x00>",
])
def test_broken_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


def test_long_pages_stay_quick():
    page = "<article>" + f"<p>{LONG}</p>" * 5000
    assert main_text(page) == "\n\n".join([LONG] * 5000)


def test_truncated_article_is_read_to_its_end():
    assert main_text(f"<article><p>{LONG}</p><p>An end &am") == f"{LONG}\n\nAn end &am"


def test_rows(spark):
    ship(spark)
    pages = spark.createDataFrame(
        [(1, "u", f"<article><p>{LONG} \U0001F600</p></article>", 5), (2, None, None, 5),
         (None, "v", "", 5), (1, "u", "<p>", 5)],
        "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", f"{LONG} \U0001F600", len(LONG) + 2), (2, None, "", 0),
                          (None, "v", "", 0), (1, "u", "", 0)], key=repr)
    assert html_text.extract(pages.where("false")).count() == 0


def test_given_pages_keep_their_articles(spark):
    import re

    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"(?s)<article>(.*?)</article>", row["html"])[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        texts = (" ".join(html_text.html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)
        assert got[row["page_id"]] == "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("before, after", [
    ('<body class="right-sidebar"><div class="content">', "</div>"),
    ('<body class="has-sidebar"><article>', "</article>"),
    ('<body><div class="no-sidebar"><div class="content">', "</div></div>"),
    ('<body><div class="content-sidebar-wrap"><main>', "</main></div>"),
    ('<body><div class="right-sidebar"><article>', "</article></div>"),
    ('<body><article class="post comments-open">', "</article>"),
    ("<body><form id=aspnet><article>", "</article></form>"),
    ('<body><form id=aspnet><div class="content">', "</div></form>"),
])
def test_names_of_layout_do_not_lose_the_article(before, after):
    others = f"""<div class="comments-wrap"><article class="comment-body"><p>{LONG}</p></article></div>
    <div class="sidebar"><p>{LONG}</p></div><form><p>{LONG}</p></form>"""
    page = f"<html>{before}<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{after}{others}</body></html>"
    assert main_text(page) == f"Title\n\n{LONG}\n\n{LONG}"


def test_related_articles_in_an_article_stay_out():
    page = f'<article><p>{LONG}</p><div class="related"><article><p>{LONG}</p></article></div></article>'
    assert main_text(page) == LONG


@pytest.mark.parametrize("before, after", [
    ("<body><form method=post>", "</form>"),
    ('<body><article data-title="A hidden history">', "</article>"),
    ('<body><article class="prose hidden md:block">', "</article>"),
    ('<body><article class="social-science">', "</article>"),
    ('<body><div class="social-science">', "</div>"),
    ('<body><div id="search-results">', "</div>"),
    ('<body><div class="legal-news"><section>', "</section></div>"),
    ('<body><article><div class="legal-analysis">', "</div></article>"),
])
def test_values_and_names_in_part_do_not_lose_the_article(before, after):
    others = f"""<div class="comments-wrap"><article class="comment-body"><p>{LONG}</p></article></div>
    <div class="sidebar"><p>{LONG}</p></div><nav><p>{LONG}</p></nav>"""
    page = f"<html>{before}<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>{after}{others}</body></html>"
    assert main_text(page) == f"Title\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("other", [
    f'<div class="promo-box"><p>{LONG}</p></div>',
    f'<div class="related-items"><section><p>{LONG}</p></section></div>',
    f'<form class="plain"><p>{LONG}</p></form>',
    f'<div hidden><p>{LONG}</p></div>',
    f'<div style="color: red; Display:none"><p>{LONG}</p></div>',
    f'<div class="ad"><p>{LONG}</p></div>',
])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_in_part_around_less_stay_out(tag, other):
    page = f"<body><{tag}><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></{tag}>{other}</body>"
    assert main_text(page) == f"Title\n\n{LONG}\n\n{LONG}"


def test_formulas_stay_in_their_sentence():
    page = f"<article><p>So <math><mi>x</mi><annotation>\\x</annotation></math> is it.</p><p>{LONG}</p></article>"
    assert main_text(page) == f"So x is it.\n\n{LONG}"


def test_cut_changes_what_the_classifier_says():
    """Short lines between paragraphs are lost to the classifier and kept by their neighbours."""
    lines = "".join(f"<p>{LONG}</p><p>He said so</p>" for _ in range(5)) + f"<p>{LONG}</p>"
    blocks = html_text.blocks_of(f"<body><div>{lines}</div><div><p>Imprint page</p></div></body>")
    alone = [odds > 0 for odds in html_text.judged(blocks)]
    assert alone == [True, False] * 5 + [True, False]
    assert html_text.labelled(blocks) == [True] * 11 + [False]
