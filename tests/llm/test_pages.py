"""The page model on fixed pages, and exact marginals by enumeration."""

import itertools
import math
import time

from skysift.llm import html_tree

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1><nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav></header>
<div class="cookie-notice">We use cookies. <button>OK</button></div>
<article><h1>A &amp; B&nbsp;title</h1><p>First   paragraph of the story, with <b>bold</b> words and a
 line.<p>Second one follows, and is left<br>open<div class="ad">Buy now, it is cheap.</div>
<ul><li>First point of the list.</li><li>Second point of it.</li></ul></article>
<section id="comments"><div class="comment"><p>I do not agree with this at all.</p></div></section>
<form><label>Your mail</label><button>Send</button></form>
<aside class="sidebar"><h3>Related</h3><a href="/1">One</a></aside>
<footer>&copy; 2020 Somebody. All rights reserved.</footer></body></html>"""


def test_article_only():
    text = html_tree.main_text(PAGE, html_tree.train())
    assert text.split("\n\n") == [
        "A & B title", "First paragraph of the story, with bold words and a line.", "Second one follows, and is left open",
        "First point of the list.", "Second point of it.",
    ]


def test_marginals_by_enumeration():
    model = html_tree.train()
    page = html_tree.Page("<body><nav><a href='/'>Home</a></nav><div><p>Text of some length, here.</p><p>More.</p></div></body>")
    odds, _, _ = html_tree.beliefs(page, *model)
    w, e = model
    n = len(page.tag)
    total, good = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        s = sum(y[k] * sum(w[i] for i in page.features[k]) for k in range(n))
        s += sum(e[page.edge[k]][2 * y[page.parent[k]] + y[k]] for k in range(1, n))
        p = math.exp(s)
        total += p
        for k in range(n):
            good[k] += p * y[k]
    for k in range(n):
        assert abs(1 / (1 + math.exp(-odds[k])) - good[k] / total) < 1e-9


def test_edge_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "just text, no markup"), (4, "u", "<p>un<p>closed <b>tags"), (5, "u", "<div " * 50), (1, "u", None),
            (6, "u", "<nav><a href='/'>Only a menu</a></nav>"), (7, "u", "<article>" + "<p>" + "long text here. " * 20000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_tree.op1(df).collect()}
    assert got[1]["text"] == "" and got[2]["text"] == "" and got[1]["n_chars"] == 0
    assert got[7]["n_chars"] == len(" ".join(("long text here. " * 20000).split()))
    assert html_tree.op1(df).count() == len(rows)
    assert html_tree.op1(df.where("page_id < 0")).count() == 0


def test_tag_ends_by_brute_force():
    # the first > outside quotes; without one, the first >
    def plain(s, at):
        quote = ""
        for k in range(at, len(s)):
            if quote:
                quote = "" if s[k] == quote else quote
            elif s[k] in "\"'":
                quote = s[k]
            elif s[k] == ">":
                return k
        return s.find(">", at)

    for n in range(1, 7):
        for chars in itertools.product("a>\"'", repeat=n):
            s = "".join(chars)
            ends = html_tree.TagEnds(s)
            assert [ends.end(k) for k in range(n)] == [plain(s, k) for k in range(n)]


def test_hostile_pages_take_linear_time():
    model = html_tree.train()
    for unit, more in (("<a ", ""), ("<div>", "</x>"), ('<a ">" ', ""), ("<b>", "<hr>x"), ("<div>", "<li></li>"), ("<svg/>", ""), ("<!", "")):
        start = time.perf_counter()
        html_tree.main_text(unit * 30_000 + more * 30_000, model)
        assert time.perf_counter() - start < 10, unit  # minutes where a tag is looked for among all the others
