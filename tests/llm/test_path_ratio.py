import html
import re

import pytest

from docflow.llm import path_ratio as pr
from docflow.session import table
from tests.conftest import SF001


def test_generated_pages_give_their_articles(spark):
    for r in pr.extract(table(spark, SF001, "pages")).collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert r["main"] == "\n".join(b for b in blocks if b)


FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header><h2>Site, name. Of it.</h2></header><nav><ul><li><a href="/a">One, two. three.</a></li></ul></nav>
<div id="sidebar"><p>Long sidebar text, with marks. And more of it, here. Yes!</p></div>
<div class="cookie-notice">We use cookies, really. Accept them, please.</div>
<article><h1>Short title</h1><p>First paragraph, with   some &amp; marks.
It goes on &#8212; a while.</p><form><input value="x">Name, please.</form><ul><li>item one<li>item <b>two</b></ul>
<div class="ad">Buy, now. Buy!</div><script>var a = "<p>no</p>";</script><p hidden>not shown, no.</p><p>Ok.</p>
<section class="comments"><p>I agree, fully. Great text, thanks.</p></section></article>
<aside>aside, text.</aside><footer>&copy; site, all. Rights.</footer></body></html>"""


def test_furniture_goes_and_short_blocks_stay():
    assert pr.main_text(FULL) == "Short title\nFirst paragraph, with some & marks. It goes on — a while.\nitem one\nitem two\nOk."


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("<p>a", "a"), ("a < b &lt; c", "a < b < c"), ("<script>x", ""),
    ("</div></p>x<p>y", "x\ny"), ('<a href="a>b">t</a>', "t"), ("<!-- c --><p>x<!-- </p>", "x"), ("<table><tr><td>1<td>2</table>", "1\n2"),
    ("<nav>only menu</nav>", ""), ("<p>&nbsp;a&nbsp; b&nbsp;</p>", "a b"), ("<div><p>x", "x"),
])
def test_awkward_pages(source, want):
    assert pr.main_text(source) == want


def test_deep_and_long_pages_are_linear():
    deep = "<div>" * 20_000 + "<p>deep text, here.</p>" + "</div>" * 20_000
    assert pr.main_text(deep) == "deep text, here."
    long = "<article>" + "<p>one, two. three</p>" * 30_000 + "</article>"
    assert pr.main_text(long).count("\n") == 29_999


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", None), (1, "u", FULL), (None, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS main", "2 AS text")
    out = pr.extract(pages)
    assert sorted(r["main"] for r in out.collect())[0] == "" and out.count() == 3 and "text" in out.columns
    assert pr.extract(pages.limit(0)).count() == 0


TEXT = "First paragraph, with some words and marks. It goes on, a while.\nSecond one, also long enough. Yes."
BODY = "".join(f"<p>{x}</p>" for x in TEXT.split("\n"))


@pytest.mark.parametrize("wrapper", [
    "class='content has-sidebar'", "class='no-sidebar'", "class='page-with-nav'", "class='sidebar'", "role='search'",
    "style='overflow:hidden'", "data-hidden='false'", "aria-hidden='false'", "data-class='ad'", "title='see id=comment'"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_words_and_attribute_values_do_not_drop_the_article(wrapper, inner):
    page = f"<body><nav>One, two.</nav><div {wrapper}><{inner}>{BODY}</{inner}></div><div class='ad'>Buy, now.</div></body>"
    assert pr.main_text(page) == TEXT


@pytest.mark.parametrize("href", ["/hidden-valley", "?id=comment", "/x?class=ad"])
def test_links_stay_whatever_their_address(href):
    assert pr.main_text(f"<article>{BODY}<p>See, also <a href='{href}'>this link</a>, please.</p></article>") == f"{TEXT}\nSee, also this link, please."


def test_the_article_stays_beside_a_longer_comment_section():
    comments = "<p>I agree, fully. Great text, thanks, really.</p>" * 40
    page = f"<body><div class='page-with-nav sidebar'><article>{BODY}</article></div><div class='comments'>{comments}</div></body>"
    assert pr.main_text(page).startswith(TEXT)


def test_ratios_select_over_the_whole_page():
    long = "<p>A long paragraph, with many words, and marks. It goes on, and on.</p>" * 9
    page = f"<body><div><a>Up</a></div><div id='lead'>{BODY}</div><div>{long}</div><div><a>a</a></div></body>"
    got = pr.main_text(page)
    assert got.startswith(TEXT) and got.count("\n") == 10


def test_a_form_around_the_page_and_cells_in_the_article_stay():
    page = f"<body><form id='aspnet'><article>{BODY}<table><tr><td>1<td>2</table></article></form></body>"
    assert pr.main_text(page) == f"{TEXT}\n1\n2"


def test_a_sidebar_goes_however_long_it_is():
    side = "".join(f"<p>Side paragraph {i}, with marks, and more words. Yes.</p>" for i in range(12))
    post = "".join(f"<p>Post paragraph {i}, with marks, and more words. Yes.</p>" for i in range(4))
    want = "\n".join(f"Post paragraph {i}, with marks, and more words. Yes." for i in range(4))
    for left, right in ((side, post), (post, side)):
        kind = ("sidebar", "post") if left is side else ("post", "sidebar")
        assert pr.main_text(f"<body><div class='{kind[0]}'>{left}</div><div class='{kind[1]}'>{right}</div></body>") == want
    assert pr.main_text(f"<body><div class='sidebar'><div class='comments'>{side}</div>{post}</div></body>") == want
    assert pr.main_text(f"<body><div class='sidebar'><div class='widget'>{post}</div></div></body>") == want


@pytest.mark.parametrize("piece", ["<a ", "<a x='", "<p title='", "<p title='>", "<p title=\">'", "<!", "<?x ", "<![CDATA[", "<b a='\" c=\"'", "</",
                                   "<script>", "<p a='b'", "<"])
def test_broken_pages_take_linear_time(piece):
    import time

    start = time.process_time()
    pr.main_text(piece * (200_000 // len(piece)))
    pr.main_text(f"<p>text, here.</p>{piece * (100_000 // len(piece))}<p>end")
    assert time.process_time() - start < 4


@pytest.mark.parametrize("source, want", [
    ("<p>a<p title='x>b</p>c", "a\nb\nc"), ("<p title='a>b' id=\"c>d\">x</p>", "x"), ("<p>1 <b x='>2</b> 3", "1 2 3"),
    ("x<![CDATA[<p>raw]]>y", "x<p>rawy"), ("<?php echo ?>x", "x"), ("a <1 b> c", "a <1 b> c"), ("<p a=\"it's\">z", "z")])
def test_tags_end_where_they_should(source, want):
    assert pr.main_text(source) == want


def test_values_are_plain_tag_path_ratios():
    import math
    from collections import defaultdict

    page = pr.Page(FULL)
    full = [(e, t) for e, _, t in page.nodes if t.strip()]

    def path(e):
        out = []
        while e > 0:
            words = [k[1] for k, v in page.paths.items() if v == page.path[e]]
            out.append(words[0])
            e = page.up[e]
        return "/".join(reversed(out))

    texts = defaultdict(list)
    for e, t in full:
        texts[path(e)].append(t)
    ratio = {p: math.log1p(sum(len(t.strip()) for t in ts) / len(ts)) * (1 + math.log1p(sum(len(pr.PUNCTUATION.findall(t)) for t in ts) / len(ts)))
             for p, ts in texts.items()}
    assert page._values(full) == pytest.approx([ratio[path(e)] for e, _ in full])
    assert len(ratio) > 8
