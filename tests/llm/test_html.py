import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from partloom.llm.html_text import extract, visible_text

CASES = {
    "<p>one<p>two<br>three": "one\n\ntwo\nthree",
    "a<div>b</div>c <b>d</b>e": "a\nb\nc de",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=9><li>i<li>j<li value=20>k</ol>": "9. i\n10. j\n20. k",
    "<ol><li><p>x<p>y</ol>": "1. x\n\n   y",
    "<table><tr><th>long head<th>b<tr><td>x<td>y</table>": "long head | b\nx         | y",
    "<table><td>x<td>y<tr><td colspan=2>wide<tr><td rowspan=2>r<td>1<tr><td>2</table>after": "x | y\nwide\nr | 1\n  | 2\n\nafter",
    "<table><tfoot><tr><td>f</tfoot><tbody><tr><td>b</tbody><caption>c</caption></table>": "c\nb\nf",
    "<table><tr><td>a<table><tr><td>in</table>z<td>b</table>": "a  | b\n   |\nin |\n   |\nz  |",
    "<table>stray<tr><td>x</table>": "stray\nx",
    "<pre>\n a\n   b\n</pre>c": " a\n   b\n\nc",
    "<blockquote><p>q<p>r</blockquote>": "> q\n>\n> r",
    "<dl><dt>T<dd>D<dd>E</dl>": "T\n  D\n  E",
    "x<div hidden>no</div><p style='color:red; display : NONE'>no</p><span style=visibility:hidden>no</span>y": "xy",
    "<head><title>no</title></head>yes<script>if (a<b) '</p>'</script><style>p{}</style><template>no</template>": "yes",
    "<script>unclosed text": "",
    "a<!-- no -->b<!-->c<!unknown>d<?php no ?>e": "abcde",
    "&lt;b&gt; &eacute;&#233;&amp &zzz; 1 < 2": "<b> éé& &zzz; 1 < 2",
    "<p>un</b>matched</i> <a href='x>y'>link</a></div></table>": "unmatched link",
    "<textarea>\n a  b</textarea><input value=v><input type=hidden value=no>": " a  bv",
    "<select><option>1<option>2</select>": "1\n2",
    "a<h1>b</h1><h2>c<p>d": "a\n\nb\n\nc\n\nd",
    "  \n ": "", "": "",
    "no markup\n at  all": "no markup at all",
    "a<br><br>b": "a\n\nb",
    "<td>loose</td><li>item": "loose\nitem",
    "<p>open <b": "open",
}


@pytest.mark.parametrize("source", CASES)
def test_layout(source):
    assert visible_text(source) == CASES[source]


def test_deep_and_wide_pages():
    deep = "<div>" * 5000 + "core" + "<ul><li>" * 3000 + "end"
    assert re.sub(r"[\s-]+", " ", visible_text(deep)) == "core end"
    wide = "<table>" + "<tr><td>x<td>y" * 50 + f"<tr><td colspan=9999>{'w' * 5000}</table>"
    text = visible_text(wide)
    assert "w" * 5000 in text and len(text) < 20000


class Words(HTMLParser):
    def __init__(self, source):
        super().__init__()
        self.skip, self.out = 0, []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_no_text_of_a_page_is_lost(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for r in pages.collect():
        want = Counter("".join("".join(Words(r["html"]).out).split()))
        got = Counter("".join(texts[r["page_id"]].split()))
        assert not want - got and set(got - want) <= set("-|.>0123456789")


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "<p>x"), (1, "<p>x"), (3, "<p>" + "long " * 100_000)]
    pages = spark.createDataFrame([(*r, "u", 1) for r in rows], "page_id long, html string, url string, text int")
    got = sorted((r["page_id"] or 0, len(r["text"])) for r in extract(pages).collect())
    assert got == [(0, 1), (1, 0), (1, 1), (2, 0), (3, 499_999)]
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["span", "div", "blockquote", "li", "b"])
def test_deep_pages(tag):
    deep = f"<{tag}>" * 1000
    page = f"a {deep}<script>var x=1;</script><style>p{{}}</style><i hidden>secret</i>visible<p>last"
    words = visible_text(page).replace(">", " ").replace("- ", " ").split()
    assert words == ["a", "visible", "last"] and visible_text("<b>" * 100_000 + "x") == "x"


def test_wide_spans():
    page = "<table><tr><td colspan=150>w<td>x<tr><td>" + "<td>".join("abc" for _ in range(151)) + "</table>"
    first, second = visible_text(page).split("\n")
    assert first.endswith("| x") and second.count("|") == 150 and first.index("| x") == second.rindex("| abc")


def plain(tree, hidden=False):
    """A second renderer for a few tags: lines of words; None is a blank line between blocks that keep a distance."""
    lines, words = [], []

    def flush():
        if words:
            lines.append(" ".join(words))
            words.clear()

    def walk(node):
        if isinstance(node, str):
            words.append(node)
            return
        tag, children = node
        if tag in ("hidden", "script"):
            return
        if tag in ("span", "b"):
            for child in children:
                walk(child)
        elif tag == "br":
            lines.append(" ".join(words))
            words.clear()
        else:
            flush()
            if tag == "p":
                lines.append(None)
            for child in children:
                walk(child)
            flush()
            if tag == "p":
                lines.append(None)

    for node in tree:
        walk(node)
    flush()
    out = []
    for i, line in enumerate(lines):
        if line is not None:
            if out and lines[i - 1] is None:
                out.append("")
            out.append(line)
    return "\n".join(out).strip("\n")


def source(node):
    if isinstance(node, str):
        return node + " "
    tag, children = node
    inner = "".join(map(source, children))
    if tag == "hidden":
        return f"<span hidden>{inner}</span>"
    return "<br>" if tag == "br" else f"<{tag}>{inner}</{tag}>"


def test_random_trees_by_a_second_renderer():
    draw = random.Random(12)

    def tree(depth, inline):
        if depth == 0 or draw.random() < 0.35:
            return f"w{draw.randrange(1000)}"
        tag = draw.choice(["span", "b", "hidden", "script"] + ([] if inline else ["div", "div", "p"]))
        if tag == "script":
            return tag, ["var x = 1 < 2;"]  # its content is not markup
        return tag, [tree(depth - 1, inline or tag not in ("div",)) for _ in range(draw.randrange(0, 4))]

    for _ in range(400):
        nodes = [tree(4, False) for _ in range(draw.randrange(1, 5))]
        page = "".join(map(source, nodes))
        assert visible_text(page) == plain(nodes), page
