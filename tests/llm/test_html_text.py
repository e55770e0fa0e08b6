"""Extraction on written pages and on every page of the smallest tables."""

import html
import re
import time

import pytest

from quietframe.llm import html_text as h

W = h.train()
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name <a>Log in</a></header><nav><ul><li>Menu one</li><li>Menu two</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>The &amp; title</h1><p>First   para<b>graph</b>
 with&nbsp;<i>words</i>.<script>no()</script></p><div class="ad">Buy now, buy now, buy now, buy more</div><p><b>Open bold<br><p>Second &lt;b&gt; one</p><!-- a comment -->
<form><input name=q><button>Go</button></form><ul><li>item</li></ul></article><aside>Side words</aside>
<section id="comments"><article class="comment"><p>A reader's words, and many of them, go on and on here.</p></article></section><footer>&copy; Foot</footer></body></html>"""


def test_written_page():
    assert h.extract(PAGE, W).split("\n\n") == ["The & title", "First paragraph with words.", "Open bold", "Second <b> one", "item"]


def test_plain_page():
    page = "<body><div id=menu><a>a</a><a>b</a></div><div><h1>Head</h1><p>" + "word " * 30 + "</p><p>more words here</p></div><div class=footer>foot</div></body>"
    assert h.extract(page, W).split("\n\n") == ["Head", " ".join(["word"] * 30), "more words here"]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "<nav>menu</nav>", "<p></p>"])
def test_nothing_to_find(page):
    assert h.extract(page, W) in ("", "<")


def test_cut_page_and_stray_tags():
    assert h.extract("<article><p>one two</b></div><p>three &am", W) == "one two\n\nthree &am"
    assert h.extract("<article><p>one two</p><p cl", W) == "one two"


def test_labelled_pages_are_found():
    for page in h.LABELLED:
        want = re.sub(r"<div class='share'>.*?</div>", "", page[page.index("[[") + 2 : page.index("]]")])
        got = h.extract(page.replace("[[", "").replace("]]", ""), W)
        assert got.split() == html.unescape(re.sub(r"<[^>]*>", " ", want)).split()


def test_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, "", "y")], "page_id long, url string, html string, text string")
    rows = sorted(map(tuple, h.main_text(df).collect()), key=str)
    assert rows[1:] == [(2, None, "", 0), (2, None, "", 0)] and rows[0][0] == 1 and rows[0][3] == len(rows[0][2])
    assert h.main_text(df.limit(0)).collect() == []


def test_every_page_of_a_table(spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        page = row.html
        inner = page[page.index("<article>") + 9 :]
        inner = inner[: inner.index("</article>")] if "</article>" in inner else re.sub(r"<[^>]*\Z", "", inner)
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<b>", "").replace("</b>", "").replace("<br>", " "))]
        assert h.extract(page, W) == "\n\n".join(b for b in blocks if b), row.page_id


BODY = "<p>The body of this article has quite a few words, enough of them to be found by any extraction.</p>"


@pytest.mark.parametrize("before", ["<script>var a='<article>'</script>", "<!-- <article> --><!-- <main> -->", "<style>article{}</style>"])
def test_marks_in_scripts_and_comments_are_none(before):
    assert h.extract(f"{before}<div>{BODY}</div>", W).startswith("The body of this")


def test_compound_classes_hold_content():
    page = f"<article>{BODY}<div class='search-results'><p>Results of the search for gold.</p></div><p class='comment-on-law'>A remark about law.</p><div class='site-footer'>foot</div><div class='cookieBanner'>c</div><div class='ad-slot top'>ad</div></article>"
    assert h.extract(page, W).split("\n\n")[1:] == ["Results of the search for gold.", "A remark about law."]


def test_formulas_objects_and_closed_icons_stay_text():
    page = f"<article>{BODY}<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <svg class='i'/> one <object data='a'>an object</object><textarea>form</textarea>.</p><svg><text>icon</text></svg><p>End.</p></article>"
    assert h.extract(page, W).split("\n\n")[1:] == ["Let x=1 be one an object.", "End."]


def test_lists_of_links_beside_unmarked_text():
    links = "".join(f"<a href=x>Link number {i}</a> " for i in range(9))
    page = f"<body><div>{links}</div><div><h1>Head</h1>{BODY}<p>With <a href=y>one link</a> in it.</p></div><div>{links}</div></body>"
    assert h.extract(page, W).split("\n\n") == ["Head", re.sub("<[^>]*>", "", BODY), "With one link in it."]


def test_a_tiny_mark_beside_a_long_body():
    assert "body of this article" in h.extract(f"<main>tiny</main><div>{BODY * 6}</div>", W)


def test_quotes_in_attributes():
    assert h.extract(f"<article><p title=\"a > b < c\" data-x='</article>'>{BODY}</p></article>", W).startswith("The body")


@pytest.mark.parametrize("piece", ["<a href=\"x' ", "<svg>", "<div ", "<", "<p>x</b>", '<a x="', "<b></i>", "<script>", "<!-- "])
def test_broken_pages_take_linear_time(piece):
    start = time.perf_counter()
    h.extract(piece * (2_000_000 // len(piece)), W)
    assert time.perf_counter() - start < 10


def text(page):
    return h.extract(page, W)


FILLER = "<div><p>" + " ".join(f"other{i}" for i in range(60)) + "</p></div>"


@pytest.mark.parametrize("value", ["<p>state of the page</p>" * 120, "a > b < c" * 400, "<" * 5000])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_attributes_hold_anything(value, quote):
    page = f"<article><h1>Title</h1><div data-props={quote}{value}{quote} id=x><p>Some words.</p></div></article>"
    assert text(page) == "Title\n\nSome words."


def test_many_quoted_values_in_a_tag():
    attributes = " ".join(f"data-a{i}='<b>{i}</b>'" for i in range(40))
    assert text(f"<article><p {attributes}>Some words of it.</p></article>") == "Some words of it."


def test_a_quote_without_an_end_is_a_character():
    assert text("<article><p>One.</p><p title=\"half>Two.</p></article>") == "One.\n\nTwo."
    assert text("<article><p title='it's here'>One.</p></article>") == "One."
    assert text("<article><p title=\"a\" <b>One</b> two.</p></article>") == "One two."


def test_a_short_marked_article_keeps_its_mark():
    words = "Fourteen words stand in this article, which is marked, beside a longer one."
    assert text(f"<body>{FILLER}<article><p>{words}</p></article>{FILLER}</body>") == words


def test_deeply_nested_elements_close():
    first, more = ("word " * 60).strip(), ("more " * 60).strip()
    deep = "<div>" * 700 + f"<p>{first}</p>" + "</div>" * 700
    assert text(f"<article>{deep}<p>{more}</p></article><div>Outside of it all.</div>") == f"{first}\n\n{more}"
    assert text("<article>" + "<i>" * 2000 + "<div class='share'>Share this</div>" + "</i>" * 2000 + "<p>Some words.</p></article>") == "Some words."


@pytest.mark.parametrize("name", ["paywall-overlay", "wp-block-newsletter-signup", "cc-cookie-window", "comments-app", "search-box", "SiteSearchForm"])
def test_elements_that_say_what_they_are(name):
    assert text(f"<article><p>Some words of the article.</p><div class='{name}'><p>Not part of it.</p></div></article>") == "Some words of the article."


@pytest.mark.parametrize("name", ["search", "search-results", "main-window", "app", "comment-on-law", "row"])
def test_elements_that_may_be_content(name):
    assert text(f"<article><section class='{name}'><p>Some words of the article.</p></section></article>") == "Some words of the article."


@pytest.mark.parametrize("piece", ["<a x=\"", "<a x='", "<a ", "</a", "<!-", "<a x=\"<a x='\" ", "<p>", "</p>", "<i></b>", "='\"<", "<script", "<article></div>"])
def test_time_is_linear(piece):
    def took(n):
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            text(piece * n)
            best = min(best, time.perf_counter() - start)
        return best

    took(100)
    assert took(40_000) < 25 * max(took(4_000), 2e-3)


def test_ties_and_equal_regions():
    """Of two regions of one sum the first is taken; equal pages have equal texts."""
    page = "<body><div><p>one two three four five six seven eight.</p></div><nav>" + "<a>x</a>" * 60 + "</nav><div><p>one two three four five six seven nine.</p></div></body>"
    assert text(page) == text(page) and text(page).startswith("one two three four five six seven eight.")
