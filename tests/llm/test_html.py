import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from tillpath.llm.html import extract, extract_text


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>One<p>two <b>bo</b>ld", "One\n\ntwo bold"),
        ("<div>a</div><div>b</div>c<br>d", "a\nb\nc\nd"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n\n  3. c\n  4. d"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>Banana pie<td>12</table>",
         "Name       | Qty\nApple      | 3\nBanana pie | 12"),
        ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        | b\n         |\nin | ner |"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>1<td>2<td>3</table>", "wide |   | x\n1    | 2 | 3"),
        ("<pre>  x\n   y</pre>z", "  x\n   y\n\nz"),
        ("<p hidden>no<p style='display : none'>no<p style='color:red'>yes", "yes"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- no <p> -->yes<noscript>no</noscript>", "yes"),
        ("<head><meta charset=x><p>in body", "in body"),
        ("a</b></p>b</div>", "ab"),
        ("<a href='x>y'>link</a> 5 < 6 <3", "link 5 < 6 <3"),
        ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
        ("<select><option>a<option>b</select>x", "a\nb\nx"),
        ("<select><optgroup label=G><option>a</select>", "G\na"),
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
        ("<svg><title>no</title><defs/><text>one</text><text>two</text></svg>b", "one\ntwo\nb"),
        ("<object data=x>in <b>place</b></object>", "in place"),
        ("<xmp><b> &amp;</xmp>z", "<b> &amp;\n\nz"),
        ("<input type=submit value='Send it'> <input type=hidden value=no><input value=typed>", "Send it typed"),
        ("a<!--> visible b<!---> c<!-- no --!> d<!-- -- no -->e", "a visible b c de"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td>a<td rowspan=9>b<tbody><tr><td>c<td>d</table>", "a | b\nc | d"),
        ("<p>open <script>never closed", "open"),
        ("one <!-- never closed", "one"),
        ("<UL><LI>A</UL><IMG ALT='pic'>", "- A\n\npic"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<textarea> t </textarea>", " t"),
    ],
)
def test_layout(page, text):
    assert extract(page)[1] == text


def test_title():
    assert extract("<title> A &lt; B\n </title>x") == ("A < B", "x")


def test_deep_nesting_keeps_all_text():
    page = "".join(f"<div>w{i} " for i in range(3000)) + "<ul><li>" * 3000 + "end"
    words = extract(page)[1].split()
    assert [w for w in words if w != "-"] == [*(f"w{i}" for i in range(3000)), "end"]


def test_unclosed_quotes_and_tags():
    page = "<p a=\"b>c</p>" * 500 + "<" * 1000 + "<a " * 500
    assert isinstance(extract(page)[1], str)


class PlainReader(HTMLParser):
    """All text outside invisible elements, without any layout."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template") or dict(attrs).get("class") == "hide":
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "i"):
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.words += re.findall(r"w\d+", data)


def made_page(rng, words=None, depth=0):
    """A random page of numbered words; i elements are hidden ones."""
    words = words if words is not None else iter(range(10**9))
    text = lambda: " ".join(f" w{next(words)} " for _ in range(rng.randint(0, 3)))
    inner = lambda: made_page(rng, words, depth + 1)
    parts = []
    for _ in range(rng.randint(1, 3)):
        parts.append(text())
        if depth > 2:
            continue
        rows = "".join(
            "<tr>" + "".join(f"<td rowspan={rng.randint(1, 4)} colspan={rng.randint(1, 3)}>{inner()}" for _ in range(rng.randint(0, 3)))
            for _ in range(rng.randint(1, 2))
        )
        parts.append(
            rng.choice(
                [
                    f"<p>{text()}",
                    f"<div>{inner()}</div>",
                    f"<ul><li>{inner()}<li>{inner()}</ul>",
                    f"<table>{rows}</table>",
                    f"<i class=hide hidden>{text()}</i>",
                    f"<script>{text()}</script><style>{text()}</style><template>{text()}</template><!-- {text()} -->",
                    f"<select><option>{text()}<option>{text()}</select>",
                    f"<svg><text>{text()}</text><path/></svg><math><mi>{text()}</mi></math><object>{text()}</object>",
                    f"<pre>{text()}</pre><blockquote>{inner()}</blockquote><xmp>{text()}</xmp>",
                    f"</b></td>{text()}<b>{text()}",
                ]
            )
        )
    return "".join(parts)


@pytest.mark.parametrize("seed", range(200))
def test_every_visible_word_once(seed):
    page = made_page(random.Random(seed))
    reader = PlainReader()
    reader.feed(page)
    reader.close()
    assert Counter(re.findall(r"w\d+", extract(page)[1])) == Counter(reader.words)


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td>" + "x" * 1_000_000 + "<td>y" + "<tr><td>a<td>b" * 10_000 + "</table>",
        "<table><tr>" + "<td rowspan=60000>w" * 3_000 + "<tr><td>w" * 3_000 + "</table>",
        "<table><tr>" + "<td>w" * 1_000 + "<td>" + "w<br>" * 10_000 + "</table>",
        "<table><tr>" + "<td colspan=100>w" * 5_000 + "</table>",
    ],
)
def test_layout_costs_no_more_than_the_text(page):
    text = extract(page)[1]
    assert len(text) < 40 * len(page)
    assert text.count("w") == page.count("w") - page.count("rowspan")
    assert text.count("x") == page.count("x")


def test_ids_beyond_doubles_and_clashing_columns_pass(spark):
    big = 9007199254740993
    rows = [(big, "<title>T</title><p>a", "given", "given", big, [1, None]), (None, None, None, None, None, None)]
    schema = "page_id long, html string, title string, text string, other long, many array<long>"
    found = extract_text(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert found[0].asDict() == {"page_id": big, "other": big, "many": [1, None], "title": "T", "text": "a"}
    assert found[1].asDict() == {"page_id": None, "other": None, "many": None, "title": "", "text": ""}


def test_pages(spark):
    rows = [(1, "<p>a", "t"), (None, None, "t"), (1, "<p>a", "t"), (2, "<p>" + "w " * 200_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, title string").withColumnRenamed("title", "Text2")
    found = extract_text(pages).collect()
    assert sorted(r["text"][:3] for r in found) == ["", "a", "a", "w w"]
    assert max(len(r["text"]) for r in found) == 399_999
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
