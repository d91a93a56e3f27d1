from __future__ import annotations

import time

import pytest

from sensorframe.llm.html_extract import counts_of, extract_pages, learn_weights, main_text, weights_of

LABELLED = (
    "<!DOCTYPE html><html><head><title>T i t l e</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li>"
    "<li><a>More</a></li></ul></nav><!-- ad --><div class='ad'>Buy this now, all of it.</div><article><h1>A heading &amp; more</h1>"
    "<p>Some  words\nof <b>the</b> article&#33;<br>And  more.<p>Second &lt;one&gt; here</article><footer><p>&copy; 2020 The makers</p></footer></body></html>"
)
PLAIN = (
    "<html><body><header><h1>Site name here</h1></header><nav><a>Home</a></nav><div id='content'><h1>Title of it</h1><p>First para with some words &amp; things.</p>"
    "<aside class=related><p>Read this other thing now please</p></aside><ul><li>one item<li>two item</ul><form><label>Mail</label><input></form>"
    "<div class='notice cookie'>We use cookies</div><p>Last   one is <b>sho</b>rt.</p><section class=comments><p>I hate this article a lot and so on</p></section>"
    "</div><footer><p>Copyright</p></footer>"
)
WEIGHTS = weights_of(counts_of(LABELLED))


@pytest.mark.parametrize("weights", [WEIGHTS, {}])
def test_regions(weights):
    assert main_text(LABELLED, WEIGHTS) == "A heading & more\nSome words of the article! And more.\nSecond <one> here"
    assert main_text(PLAIN, weights) == "Title of it\nFirst para with some words & things.\none item\ntwo item\nLast one is short."


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain text only", "plain text only"), ("<p>cut of <a hre", "cut of"), ("<script>only</script>", ""), ("<p>a b c</p></div></p>d e f", "a b c\nd e f"),
    ("<p>x &amp", "x &"), ("<p>x &unknown; y", "x &unknown; y"), ("<!-- never closed <p>a", ""), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
])
def test_odd_pages(page, want):
    assert main_text(page, {}) == want


@pytest.mark.parametrize("part,want", [
    ('<h2 id="search-algorithms">On search</h2><p>It is fast.</p>', "On search\nIt is fast."), ('<h2 id="ad-hoc-queries">Ad hoc</h2><p>b c</p>', "Ad hoc\nb c"),
    ('<section id="related-work"><p>They did it.</p></section>', "They did it."), ('<div id="menu"><p>Soup and bread.</p></div>', "Soup and bread."),
    ('<section class="social-impact"><p>It helps.</p></section>', "It helps."), ('<p class="ad-hoc">x y z</p>', "x y z"),
    ('<div class="social-share">Tell all</div>', ""), ('<div class="post ad">Buy it</div>', ""), ('<div class="comment-list"><p>I hate it</p></div>', ""),
    ('<div id="comments"><p>I hate it</p></div>', ""), ('<div role="search">Find it</div>', ""), ('<div class="related-posts">More of it</div>', ""),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x tex</annotation></math> holds</p>", "so x=2 holds"),
    ('<svg viewBox="0 0 1 1" /><p>after it</p>', "after it"), ("<svg/><p>a b</p>", "a b"), ("<math/><p>a b</p>", "a b"), ('<object data="x"/><p>a b</p>', "a b"),
    ("<svg><text>no</text></svg><p>a b</p>", "a b"), ("<object data='y'>no</object><p>a b</p>", "a b"),
])
def test_text_of_articles_stays(part, want):
    page = f"<html><body><article><p>One two three four five.</p>{part}<p>Six seven eight nine ten.</p></article></body></html>"
    assert main_text(page, WEIGHTS) == "\n".join(filter(None, ["One two three four five.", want, "Six seven eight nine ten."]))


@pytest.mark.parametrize("slug", ["search-algorithms", "ad-hoc-queries", "related-work"])
def test_slugs_of_headings_outside_articles(slug):
    assert main_text(f'<body><div><h2 id="{slug}">Of it</h2><p>One two three.</p></div>', {}) == "Of it\nOne two three."


def test_pages(spark):
    rows = [(1, "u", LABELLED), (1, "u", LABELLED), (None, None, None), (2, "v", ""), (3, "w", PLAIN), (4, "x", LABELLED.replace("<p>Second", "<p>word" * 20_000 + "<p>Second"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text", "1 as HTML", "2 as feature")
    assert learn_weights(pages) and learn_weights(pages, labelled=1)
    got = extract_pages(pages).collect()
    assert [(r.page_id, r.url, r.text) for r in got] == [(i, u, main_text(h or "", learn_weights(pages))) for i, u, h in rows]
    assert all(r.n_chars == len(r.text) for r in got) and len(got[-1].text) > 80_000
    assert extract_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a " * 300_000 + ">", "<a " * 300_000 + "\">\"", "<b>" * 130_000 + "</i>" * 130_000, "<a \">\" " * 125_000, "<a ' \"" * 140_000 + ">", "<svg " * 200_000,
    "<svg " * 200_000 + ">", "</p>" * 250_000, "<p>" * 300_000, "<!-" * 300_000, "<a x='" * 160_000, "</svg   " * 120_000, "<div><p>" * 60_000 + "</div>" * 60_000,
    "<" * 1_000_000, "<p class=\"a" * 90_000, "&amp" * 250_000,
], ids=range(17))
def test_broken_pages_take_linear_time(page):
    begin = time.process_time()
    main_text(page + "<p>some words here</p>", WEIGHTS)
    assert time.process_time() - begin < 12


@pytest.mark.parametrize("attrs", ["id='share-of-gdp'", "class='related-work'", "id='search-algorithms' class='menu-costs'", "class='ad-hoc'"])
def test_names_of_subjects_are_no_boilerplate(attrs):
    page = f"<html><body><nav><a>Home</a></nav><div {attrs}><p>Some words of the text that stays here.</p></div><div class='share buttons'>Share it now</div></body></html>"
    assert main_text(page, WEIGHTS) == main_text(page, {}) == "Some words of the text that stays here."
