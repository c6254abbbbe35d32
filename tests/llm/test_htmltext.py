import random
import re

import pytest

from jobmeter.llm.htmltext import extract_text, visible_text

CASES = {
    "<p>a<p>b <b>c</b>d": "a\n\nb cd",
    "<div>a</div><div>b</div>c<br>d": "a\nb\nc\nd",
    "<ul><li>a<li>b<ol start=4><li>c<li>d</ol></ul>e": "- a\n- b\n  4. c\n  5. d\n\ne",
    "<table><tr><th>k<th>long name<tr><td>wide one<td>1<tr><td rowspan=2>r<td>2<tr><td>3</table>":
        "k         long name\nwide one  1\nr         2\n          3",
    "<head><title>t</title></head><body>x<script>if(a<b)</script><style>p{}</style><template>u</template>y": "xy",
    "<p hidden>a</p><p style='color:red;display : none'>b</p><div style='visibility:hidden'>c</div>d": "d",
    "<pre>a\n  b\n\nc</pre>d": "a\n  b\n\nc\n\nd",
    "a &lt;b&gt; &amp; &copy; &#x41;&nope;": "a <b> & © A&nope;",
    "a<!-- x -->b<!x>c<![if q]>d<!--": "abcd",
    "  a \n\t b  <i> c</i> ": "a b c",
    "<details><summary>s</summary>hidden</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "a</p></div></table>b<td>c": "ab\nc",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "a < b and <p clas": "a < b and",
    "": "",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert visible_text(html) == CASES[html]


def test_made_up_trees_show_their_visible_words():
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**6)}"

    def node(depth, seen):
        kind = rng.choice(["text", "text", "p", "div", "b", "ul", "hidden", "script", "table"] if depth < 5 else ["text"])
        if kind == "text":
            w = word()
            (shown if seen else []).append(w)
            return f" {w} "
        if kind == "script":
            return f"<script>{word()}</script>"
        inner = lambda s=seen: "".join(node(depth + 1, s) for _ in range(rng.randrange(4)))
        if kind == "hidden":
            return f"<div hidden>{inner(False)}</div>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{inner()}" for _ in range(3)) + "</ul>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{inner()}<td>{inner()}" for _ in range(2)) + "</table>"
        return f"<{kind}>{inner()}</{kind}>"

    for _ in range(200):
        shown = []
        html = "".join(node(0, True) for _ in range(5))
        assert re.findall(r"w\d+", visible_text(html)) == shown, html


def test_depth_and_size():
    assert visible_text("<div><ul><li>" * 4000 + "x") .endswith("x")
    assert visible_text("<table><tr><td>" * 400 + "y") == "y"
    assert visible_text("<b>" * 3000 + "</i>" * 3000 + "z") == "z"
    assert len(visible_text("<table>" + f"<tr><td>{'a ' * 5000}<td>b" * 3 + "<tr><td>c<td>d" * 500 + "</table>")) < 100_000


def test_odd_rows(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<p>x", "u"), (3, "<p>x", "u"), (None, "<i>y", "u"), (4, "z" * 200_000, "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((tuple(r) for r in extract_text(pages).collect()), key=str)
    assert got == sorted(((i, t, len(t)) for i, t in [(1, ""), (2, ""), (3, "x"), (3, "x"), (None, "y"), (4, "z" * 200_000)]), key=str)
    assert extract_text(pages.limit(0)).count() == 0


def test_pages_are_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<script.*?</script>|<head>.*?</head>|<!--.*?-->", " ", r.html)
        want = re.findall(r"\w+", __import__("html").unescape(re.sub(r"<[^>]*>", " ", body)))
        assert re.findall(r"\w+", re.sub(r"(?m)^( *)(- |\d+\. )", r"\1", found[r.page_id])) == want


@pytest.mark.parametrize("html, text", [
    ("<p><svg id='i'/>Text</p>", "Text"), ("<p><math/>Text", "Text"), ("<p>a <svg><path d='m'/><g/><text>in svg</text></svg> b", "a in svg b"),
    ("<svg><title>t</title><desc>d</desc><style>s</style><g>x<text>y<tspan>z</tspan></text></g></svg>", "yz"),
    ("<svg><foreignObject><p>in <b>html</b></p></foreignObject></svg>c", "in html\n\nc"),
    ("x <math><mi>a</mi><mo>+</mo><mi>b</mi><mspace/></math> y", "x a+b y"),
    ("<math><semantics><mi>a</mi><annotation>\\alpha</annotation></semantics></math>", "a"),
    ("<textarea>one\n  two</textarea>", "one\n  two"), ("<p>m <map><area><a>link</a></map> n", "m link n"),
    ("<select><option>one<option>two</select>", "one\ntwo"), ("<select><optgroup><option>one</option><option>two</option></optgroup></select>three", "one\ntwo\nthree"),
    ("<p>a<b/>c</p>d", "ac\n\nd"),
])
def test_foreign_and_form_text(html, text):
    assert visible_text(html) == text
