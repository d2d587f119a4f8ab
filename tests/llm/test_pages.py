"""Operator 6: hand-made pages, the given pages against their known frame, and edge cases."""

import html
import random
import re

import pytest

from etholith.llm.common import table
from etholith.llm.pages import extract, main_text, op6

LONG = "This sentence is long enough to count, has a comma, and goes on for a while to be prose."
CASES = [
    (None, ""),
    ("", ""),
    ("   \n", ""),
    ("just text", "just text"),
    ("<p>One<p>Two &amp; <b>bold</b>\n\t x", "One\n\nTwo & bold x"),
    (f"<html><body><nav><a href=/>Home</a></nav><main><h1>T</h1><p>{LONG}</p><p>{LONG}</p></main><footer>(c)</footer></body></html>", f"T\n\n{LONG}\n\n{LONG}"),
    (f"<body><div class='sidebar-left'><p>{LONG}</p></div><div id=content><h2>T</h2><p>{LONG}</p><ul><li>a<li>b</ul></div>"
     f"<div class='comments'><p>{LONG}</p></div></body>", f"T\n\n{LONG}\n\na\n\nb"),
    (f"<article><header><h1>Head</h1></header><p>{LONG}<br>next</p><aside>no</aside><form><p>no</p></form><p>Short.</article><div class=ad>{LONG}</div>",
     f"Head\n\n{LONG} next\n\nShort."),
    (f"<div><p>{LONG}<script>var t='</p>';</script> end</p><style>p{{}}</style><!-- <p>no</p> --><p>x &lt; y&nbsp;&#233;</p></div>", f"{LONG} end\n\nx < y é"),
    (f"<div class='cookie-notice'>{LONG}</div><article><p>{LONG}</p></article><p hidden>no</p><div style='display:none'>no</div>", LONG),
    (f"<div><a href=x>{LONG}</a> <a href=y>{LONG}</a></div><div><p>{LONG}</p></div>", LONG),
    ("<p>a < b and c > d</p><table><tr><td>1<td>2<tr><td>3</table>", "a < b and c > d\n\n1\n\n2\n\n3"),
    (f"<article><p>{LONG}</p><script>never closed <p>no</p>", LONG),
    (f"<div><section><h2>A</h2>{'<p>' + LONG + '</p>'}{'<p>' + LONG * 3 + '</p>'}<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><h2>B</h2><p>{'word ' * 50}</p></section><section><p>Short.</p></section>"
     f"<div><a href=/>{LONG}</a></div></div>", "\n\n".join(["A", LONG, LONG * 3, LONG, LONG, LONG, "B", ("word " * 50).strip(), "Short."])),
    ("<nav>only</nav><footer>this</footer>", ""),
    # Names that only look like furniture, inside an article.
    (f"<article><p>{LONG}</p><div class='related-work'><p>Earlier work.</p></div><div class='section-header'><h2>S</h2></div><p class='legal'>Law.</p>"
     f"<div class='social-science'>Soc.</div><p data-hidden>Seen.</p><p>with <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>TeX</annotation></math> and <noscript>plain</noscript></p></article>",
     f"{LONG}\n\nEarlier work.\n\nS\n\nLaw.\n\nSoc.\n\nSeen.\n\nwith x=1 and plain"),
    # Readers' comments in article elements, shorter and longer than the article.
    (f"<article><h1>T</h1><p>{LONG}</p><article class='comment'><p>Nice, nice.</p></article></article>", f"T\n\n{LONG}"),
    (f"<body><article><p>{LONG}</p></article>" + f"<article class='comment' id=c1><p>{LONG * 5}</p></article>" * 3, LONG),
    (f"<article><p>{LONG}</p><section class='comment-list'><p>{LONG * 9}</p></section></article>", LONG),
    # Furniture inside an article goes by its name and its links or shortness; adverts and notices by their name.
    (f"<article><div class='share'>Share this</div><p>{LONG}</p><div class='related'><h3>More</h3><ul><li><a href=/>{LONG}</a></ul></div>"
     f"<div class='related'><p>{LONG}</p></div><div class='adBox'>{LONG}</div><div class='cookie-notice'>{LONG}</div><div class='side-bar'>{LONG}</div></article>", f"{LONG}\n\n{LONG}"),
    # No article element: lists, tables and headings beside the best container.
    (f"<body><h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>one<li>two</ul><table><tr><td>cell</table><ul><li><a href=/>away</a></ul></body>",
     f"T\n\n{LONG}\n\n{LONG}\n\none\n\ntwo\n\ncell"),
    (f"<body><form id=aspnet><h1>T</h1><p>{LONG}</p></form></body>", f"T\n\n{LONG}"),
    (f"<body><div class='modal'><h1>T</h1><p>{LONG}</p></div><p>x</p></body>", f"T\n\n{LONG}\n\nx"),
    (f"<section><header><h2>H</h2></header><p>{LONG}</p><p>{LONG}</p></section>", f"H\n\n{LONG}\n\n{LONG}"),
    (f"<article><p>a <span class='sr-only'>x</span><span class='hidden'>no</span>b {LONG}</p></article>", f"a xb {LONG}"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_page(source, want):
    assert main_text(source) == want


def test_given_pages(spark, sf):
    """Every given page keeps its article in one frame; a plain reading of that frame is the answer."""
    rows = table(spark, sf, "pages").collect()
    got = {r.page_id: r for r in op6(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", p) if "<br" in p else re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_composed_pages():
    """Pages put together at random from parts whose place in the answer is known."""
    rng = random.Random(4)
    words = "la, se mi to ra, ne ku vi".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).strip(",") + "."
    away = [
        lambda: f"<nav><ul><li><a href=/>{prose(3)}</a></ul></nav>", lambda: f"<div class='{rng.choice(['ad', 'ad-slot', 'sponsored', 'promoBox'])}'><p>{prose(40)}</p></div>",
        lambda: f"<aside>{prose(30)}</aside>", lambda: f"<div id='{rng.choice(['comments', 'comment-list', 'disqus_thread'])}'>" + f"<article class=comment><p>{prose(60)}</p></article>" * 3 + "</div>",
        lambda: f"<div class='cookie-banner'>{prose(20)}</div>", lambda: f"<form><p>{prose(9)}</p><input></form>", lambda: f"<script>var x = '<p>{prose(50)}</p>';</script>",
        lambda: f"<footer><p>{prose(25)}</p></footer>", lambda: f"<div class='sidebar'><p>{prose(40)}</p></div>", lambda: f"<!-- <p>{prose(9)}</p> -->",
    ]
    for _ in range(300):
        parts, want = [], []
        for _ in range(rng.randrange(2, 9)):
            kind = rng.randrange(6)
            text = prose(rng.randrange(12, 60))
            if kind == 0:
                parts.append(rng.choice(away)())
                continue
            want.append(text)
            parts.append({1: f"<h2>{text}</h2>", 2: f"<ul><li>{text}</li></ul>", 3: f"<div class='{rng.choice(['related-work', 'x1', 'social-science'])}'><p>{text}</p></div>"}.get(kind, f"<p>{text}</p>"))
        lead = prose(80)
        frame = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"])
        inner = f"<h1>Title</h1><p>{lead}</p><p>{lead}</p>" + "".join(parts)
        page = "<html><head><title>no</title></head><body>" + "".join(rng.choice(away)() for _ in range(3)) + frame.format(inner) + "".join(rng.choice(away)() for _ in range(3)) + "</body></html>"
        assert main_text(page) == "\n\n".join(["Title", lead, lead, *want]), page


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a", "x"), (1, "<p>a", "x"), (None, "<i>" * 5000 + "deep", "y"), (3, "<" * 20000 + '<a "' * 2000, "z")], "page_id long, html string, text string")
    out = extract(df)
    assert out.columns == ["page_id", "text"] and out.count() == 5
    assert sorted(r.text for r in out.filter("page_id = 1").collect()) == ["", "a", "a"]
    assert extract(df.limit(0)).count() == 0
