"""Rendered pages against expected text, and every visible word against the standard parser."""

from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blamesplit.llm.html import rendered, rendered_page

SCHEMA = "page_id long, html string, text string"


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("", ""),
        ("a  b\n c", "a b c"),
        ("<p>one<p>two</p>three", "one\n\ntwo\n\nthree"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>end", "- a\n- b\n  3. x\n  4. y\n\nend"),
        ("<table><tr><th>k<th>value<tr><td>long key<td>1</table>", "k         value\nlong key  1"),
        ("<table><caption>t</caption><tr><td rowspan=2>a<td>b<tr><td>c</table>", "t\na  b\n   c"),
        ("<table><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>", "wide cell here  z\na  b" + " " * 0 + "  c"),
        ("<table>stray<tr><td>x</table>", "stray\n\nx"),
        ("<b>bold<i>both</b>after</i>", "boldbothafter"),
        ("<p hidden>no</p><p style='display : none'>no</p><span style=visibility:hidden>no<b style='visibility:visible'>yes</b></span>", "yes"),
        ("<style>.ad, #x{display:none} /* p{} */</style><div class='b ad'>no</div><div id=x>no</div>yes", "yes"),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style>y<template>z</template>", "xy"),
        ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
        ("a &lt;b&gt; &amp; c < d <3", "a <b> & c < d <3"),
        ("x<!-- no -- > --> y<!DOCTYPE html><?php no ?>z", "x yz"),
        ("<a href='x>y'>in</a> <a href=\"unclosed>lost", "in"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>", "s\ns\nyes"),
        ("<head><title>no</title><p>body", "body"),
        ("<select><option>a<option>b</select><input type=submit value=Go><textarea> k </textarea>", "a\nb\nGo k"),
        ("<blockquote>q<p>r</blockquote>", "    q\n\n    r"),
        ("<h1>t<h2>u", "t\n\nu"),
        ("日本<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本\n\n日本  x\nabc   y"),
        ("</p></br>x</div>", "x"),
    ],
)
def test_rendering(markup, want):
    assert rendered_page(markup) == want


class Visible(HTMLParser):
    """Words outside elements that are never shown, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style", "title")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style", "title")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_all_visible_words_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in rendered(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        plain = Visible()
        plain.feed(r.html)
        want = "".join("".join(plain.words).split())
        found = "".join(x for x in "".join(got[r.page_id].split()) if True)
        marks = sum(line.lstrip().startswith("- ") for line in got[r.page_id].split("\n"))
        assert len(found) - marks == len(want) and sorted(set(want)) == sorted(set(found) - ({"-"} - set(want))), r.page_id


def test_deep_and_odd_pages(spark):
    rows = [(1, None, "t"), (None, "", "t"), (2, "<div>" * 30_000 + "deep", ""), (3, "<table><tr><td>" * 300 + "cell", ""), (4, "<" * 50_000, ""), (5, "<a " + "b " * 50_000, "")]
    rows += [(6, "<p>same", "")] * 3 + [(7, "<td rowspan=60000 colspan=1000>x", ""), (8, "<ol start=99999999999999><li>x", ""), (9, "<!--", ""), (10, "w " * 400_000, "")]
    got = rendered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[None] == by[5] == by[9] == "" and by[2] == "deep" and by[3] == "cell" and by[8] == "1. x"
    assert [r.text for r in got if r.page_id == 6] == ["same"] * 3 and by[10].count("w") == 400_000
    assert rendered(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<table><form><tr><td>x</td></tr></form></table>y", "x\n\ny"),
        ("<table><tr><form><td>x</td></form></tr></table>", "x"),
        ("<tr><form><td>x</td></form></tr>", "x"),
        ("<table><tbody><form><tr><td>x<td>y</table>", "x  y"),
        ("<table><colgroup><col><col><tbody><tr><td>x", "x"),
        ("<table><caption>t<colgroup><col><tr><td>x<td>y<tr><td>z</table>", "t\nx  y\nz"),
        ("<table><colgroup>stray<tr><td>x</table>", "stray\n\nx"),
        ("<table><table><table><tr><td>x</table>", "x"),
        ("<table><li>stray<tr><td>x</table>", "- stray\n\nx"),
        ("<table><tr><div>stray<td>x<td>y</table>", "stray\n\nx  y"),
    ],
)
def test_no_row_or_cell_is_lost(markup, want):
    assert rendered_page(markup) == want


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([f"<{end}{t}>" for t in "table tr td th tbody tfoot caption colgroup col form li dd option div p b h2 select a ul".split() for end in ("", "/")] + ["w"] * 20), max_size=30))
def test_every_word_of_table_soup_is_shown(soup):
    words = [f"w{k}w" for k in range(len(soup))]
    shown = rendered_page("".join(w if x == "w" else x for x, w in zip(soup, words, strict=True)))
    assert all(w in shown for x, w in zip(soup, words, strict=True) if x == "w")


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<div =x>rest of page", "rest of page"),
        ('<a href="u"="v">rest', "rest"),
        ('<img src="a"=>rest', "rest"),
        ("<p = hidden>no<p ==>rest", "rest"),
        ("<p =", ""),
    ],
)
def test_stray_equals_sign_in_a_tag(markup, want):
    assert rendered_page(markup) == want


@pytest.mark.parametrize(
    ("page", "said"),
    [
        ("<svg><title/></svg>hello", "hello"),
        ("<svg><style/></svg>hello", "hello"),
        ("<p>a<svg><g/><path d='x'/></svg>b", "ab"),
        ("<math><mi/></math>hello<script/>x</script> y", "hello y"),
        ("a<!--x--!>b", "ab"),
        ("a<!-->b", "ab"),
        ("a<!--->b", "ab"),
        ("a<!--x->y-->b", "ab"),
        ("<style>/* p{display:none} /* */ b { display : none }</style><p>a<b>c</b>", "a"),
        ("<style>p{display:none</style><p>a", "a"),
    ],
)
def test_pages_that_once_lost_their_end(page, said):
    assert rendered_page(page).strip() == said


def test_long_sheets_take_linear_time():
    import time

    start = time.perf_counter()
    for sheet in ("a" * 1_000_000, "/*" * 500_000, "a{" * 500_000, "}" * 1_000_000):
        assert rendered_page(f"<style>{sheet}</style>hello").strip() == "hello"
    assert time.perf_counter() - start < 20
