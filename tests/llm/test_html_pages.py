from __future__ import annotations

import itertools
import re
import time

import pytest

from heliograph.llm import html_text


def test_a_closing_tag_is_found_below_many_unclosed_ones():
    page = "<nav>" + "<div>menu" * 200 + "</nav><article><p>The text itself.</p></article>"
    found = html_text.blocks(page)
    assert found[-1] == ("The text itself.", 3, 0, True, 0)
    assert all(b[4] == html_text.PLAIN for b in found[:-1])


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.trained_tree(spark)


#: Pages that the tree has not seen, labelled like ``html_text.LABELLED``.
HELD_OUT = [
    "<header>[-4]</header><nav>[-1/1]<p>[-2/2]<p>[-1/1]</nav><main><h1>[+9]</h1><p>[+70/3]<p>[+33]<p>[+52/6]<div class='related-links'>[-6/6]<p>[-7/7]</div><p>[+41]</main><footer>[-5/5]<p>[-7]</footer>",
    "<div id=menu>[-1/1]<p>[-1/1]<p>[-1/1]</div><h1>[+6]</h1><p>[+38]<p>[+44/2]<p>[+61]<div class=footer-links>[-4/4]<p>[-5/5]</div>",
    "<nav>[-3/3]<p>[-3/3]</nav><article><h2>[+4]</h2><p>[+29]<p>[+75/12]<p>[+19]<p>[+36]</article><aside>[-8/8]<p>[-6/6]</aside><form>[-4/3]</form>",
    "<p>[-2/2]<p>[-1/1]<p>[-1/1]<h1>[+5]</h1><p>[+110]<p>[+64/5]<p>[+27]<p>[-4/4]<p>[-2/2]<p>[-6/5]",
    "<p>[-12/10]<h1>[+8]</h1><p>[+48/1]<p>[+50]<p>[+23]<ul><li>[+7]<li>[+9]</ul><p>[+60]<p>[-9/9]<p>[-8/8]",
]
HIDDEN = re.compile(r"\s(?:class|id)=(?:'[^']*'|[^\s>]+)"), re.compile(r"(</?)(?:nav|header|footer|aside|main|article|form)\b")


def test_words_and_links_decide_where_marks_are_hidden(tree):
    def right(pages):
        found = html_text.labelled_blocks(pages)
        return sum(html_text.is_text(tree, f[:-1]) == (f[-1] == 1) for f in found) / len(found), len(found)

    assert right(HELD_OUT)[0] == 1.0
    hidden = [HIDDEN[1].sub(r"\1div", HIDDEN[0].sub("", p)) for p in HELD_OUT]
    share, n = right(hidden)
    assert all(f[-2] == f[-3] == 0 for f in html_text.labelled_blocks(hidden)) and n > 50 and share > 0.9

    def used(t):
        return set() if len(t) == 1 else {html_text.FEATURES[t[0]]} | used(t[2]) | used(t[3])

    assert {"words", "links"} < used(tree) and len(used(tree)) > 4


def test_plain_marks_decide_where_a_page_has_them(tree):
    for sizes in itertools.product((1, 2, 3, 5, 8, 17, 40, 200), (0, 0.2, 0.5, 1), (0, 2, 3, 10, 60), (0, 0.5, 1), (0, 1, 10, 60), (0, 0.5, 1)):
        assert html_text.is_text(tree, (*sizes, 1, 0))
        assert not any(html_text.is_text(tree, (*sizes, inside, html_text.PLAIN)) for inside in (-1, 0, 1)) and not html_text.is_text(tree, (*sizes, -1, 0))


@pytest.mark.parametrize("opening", ["<section id='related-work'>", "<div data-id='search-x'>", "<div class='comparison widget'>", "<div data-class='ads' grid-id='menu'>"])
def test_long_parts_of_an_article_stay_whatever_their_name(tree, opening):
    part = " ".join(f"w{k}" for k in range(60))
    page = f"<article><p>{part} a</p>{opening}<p>{part} b</p><p>{part} c</p></section></div><p>{part} d</p></article>"
    assert html_text.main_text(page, tree) == " ".join(f"{part} {x}" for x in "abcd")


@pytest.mark.parametrize("name", ["related", "share-buttons", "widget", "search social"])
def test_links_of_loosely_named_parts_go(tree, name):
    part = " ".join(f"w{k}" for k in range(45))
    page = f"<article><p>{part}</p><div class='{name}'><p><a href=x>one two three four</a></p><p><a href=y>five six seven</a></p></div><p>{part}</p></article>"
    assert html_text.main_text(page, tree) == f"{part} {part}"


@pytest.mark.parametrize("name", ["ad", "comments", "newsletter", "cookie-notice"])
def test_long_parts_plainly_named_go(tree, name):
    part = " ".join(f"w{k}" for k in range(45))
    assert html_text.main_text(f"<article><p>{part}</p><div class='{name}'><p>{part} x</p><p>{part} y</p></div></article>", tree) == part


@pytest.mark.parametrize("piece", ["<a x", '<a "', '<a ">', '<a =">"', "<div>", "<button>", "<!-- ", "<", "</", "<p class='a", "<script>", "<p>a &amp; "])
def test_long_pages_of_any_markup(tree, piece):
    began = time.perf_counter()
    for end in ("", ">", '">'):
        html_text.main_text(piece * (1_700_000 // len(piece)) + end, tree)
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>a<script src=/js/>var x=1;</script> b</article>", "a b"),
        ("<article><p>a<svg/> b<svg class='x' /> c</article>", "a b c"),
        ("<article><p>a <button>b</p><p>c</article>", "a b c"),
        ("<article><p title='x > y'>a</p><!-->b<!-- > -->c</article>", "a bc"),
        ("<article><p>1 < 2 and 3 <4> 5", "1 < 2 and 3 <4> 5"),
        ('<article><p title="never closed>a</p><p>b</article>', "a b"),
        ("<article><p>a b &lt;p&gt;\n\tc</article>", "a b <p> c"),
    ],
)
def test_markup_of_many_kinds(tree, page, want):
    assert html_text.main_text(page, tree) == want
    assert html_text.main_text(page + "<p>last", tree).startswith(want)


def test_repeated_rows_and_long_pages(spark):
    rows = [(1, "u", "<article><p>a</article>")] * 3 + [(2, "u", "<article>" + "<p>word</p>" * 300_000 + "</article>"), (None, None, None)]
    got = sorted((r.page_id or 0, r.n_chars) for r in html_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 300_000 * 5 - 1)]
