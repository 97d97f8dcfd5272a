"""Labelled pages that train the page model.

Pages are built by rule from layouts that web sites use. Every element has a
label: 1 if its text belongs to the article, 0 if not. Words and lengths come
from a hash of the page's number, so the set is the same everywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

N_PAGES = 96

_WORDS = (
    "the of and river house light water people history small great with from stone field under year music paper glass winter garden "
    "der die und haus licht wasser stadt leben la de en que casa agua ciudad tiempo le les des une maison ville temps avec"
).split()
_LABELS = "Home About Contact News Sports Login Help Terms Archive Shop Blog Events".split()


class _Draw:
    """Numbers that follow from a seed by hashing."""

    def __init__(self, seed: int):
        self.seed, self.n = seed, 0

    def __call__(self, low: int, high: int) -> int:
        self.n += 1
        h = hashlib.md5(f"{self.seed}/{self.n}".encode()).digest()
        return low + int.from_bytes(h[:4], "little") % (high - low + 1)

    def words(self, low: int, high: int) -> str:
        return " ".join(_WORDS[self(0, len(_WORDS) - 1)] for _ in range(self(low, high)))

    def sentence(self, low: int = 5, high: int = 25) -> str:
        s = self.words(low, high)
        return s[:1].upper() + s[1:] + ".!?."[self(0, 3)]


#: An element: (tag, attributes, label, children); a child is an element or text.
Element = tuple


def _el(tag: str, attrs: str, label: int, *children) -> Element:
    return (tag, attrs, label, children)


def _para(d: _Draw, y: int = 1) -> Element:
    style = d(0, 9)
    text = " ".join(d.sentence() for _ in range(d(1, 6)))
    if style == 0:
        return _el("p", "", y, text[: len(text) // 2], _el("b", "", y, " " + d.words(1, 3)), " " + d.sentence())
    if style == 1:
        return _el("p", "", y, text + " ", _el("a", 'href="/x"', y, d.words(1, 4)), " " + d.sentence())
    if style == 2:
        return _el("p", "", y, d.sentence(1, 3))
    if style == 3:
        return _el("p", "", y, text.upper().replace(" ", "!! "))
    if style == 4:
        return _el("p", "", y, text.replace(" ", "*** "))
    return _el("p", "", y, text)


def _body(d: _Draw) -> list[Element]:
    out = [_el(("h1", "h2")[d(0, 1)], "", 1, d.words(2, 9))] if d(0, 5) else []
    for _ in range(d(1, 7)):
        k = d(0, 11)
        if k == 0:
            out.append(_el("ul", "", 1, *[_el("li", "", 1, d.sentence(3, 12)) for _ in range(d(2, 5))]))
        elif k == 1:
            out.append(_el("blockquote", "", 1, _el("p", "", 1, d.sentence())))
        elif k == 2:
            out += [_el("h3", "", 1, d.words(2, 6)), _para(d)]
        elif k == 3:
            out.append(_el("table", "", 1, _el("tr", "", 1, _el("td", "", 1, d.words(1, 4)), _el("td", "", 1, d.words(1, 4)))))
        elif k == 4:
            out.append(_el("pre", "", 1, d.words(4, 12)))
        elif k == 5:
            out.append(_el("figure", "", 1, _el("figcaption", "", 1, d.sentence(3, 9))))
        else:
            out.append(_para(d))
    return out


def _links(d: _Draw, wrap: str = "ul") -> Element:
    one = lambda: _el("a", f'href="/{d(1, 99)}"', 0, _LABELS[d(0, len(_LABELS) - 1)] if d(0, 1) else d.words(1, 2))
    if wrap == "ul":
        return _el("ul", "", 0, *[_el("li", "", 0, one()) for _ in range(d(3, 9))])
    return _el(wrap, "", 0, *[one() for _ in range(d(3, 9))])


def _nav(d: _Draw) -> Element:
    kind = d(0, 3)
    attrs = ("", 'class="main-nav"', 'id="menu"', 'role="navigation"')[kind]
    return _el("nav" if kind in (0, 3) else "div", attrs, 0, _links(d, "ul" if d(0, 2) else "p"))


def _ad(d: _Draw) -> Element:
    attrs = ('class="ad"', 'class="advert banner"', 'id="sponsored"', 'class="promo-box"')[d(0, 3)]
    inner = d.sentence(3, 25) if d(0, 1) else _el("p", "", 0, d.sentence(3, 25))
    return _el(("div", "div", "aside", "section")[d(0, 3)], attrs, 0, inner)


def _notice(d: _Draw) -> Element:
    attrs = ('class="cookie-notice"', 'id="consent"', 'role="dialog"', 'class="alert notice"', 'role="alert"')[d(0, 4)]
    return _el("div", attrs, 0, _el("p", "", 0, d.sentence(5, 20)), _el("button", "", 0, "OK"))


def _footer(d: _Draw) -> Element:
    attrs = ("", 'class="footer"', 'id="footer"', 'role="contentinfo"')[d(0, 3)]
    text = "&copy; " + d.words(2, 5) + " &middot; " + d.sentence(3, 15)
    return _el("footer" if d(0, 1) or not attrs else "div", attrs, 0, text if d(0, 1) else _el("p", "", 0, text))


def _header(d: _Draw) -> Element:
    attrs = ("", 'class="site-header"', 'id="header"', 'role="banner"')[d(0, 3)]
    return _el("header" if d(0, 1) or not attrs else "div", attrs, 0, _el("h1" if d(0, 1) else "p", "", 0, d.words(1, 4)), _nav(d))


def _comments(d: _Draw) -> Element:
    attrs = ('id="comments"', 'class="comments"', 'class="comment-list"', 'class="reader-comments"')[d(0, 3)]
    one = lambda: _el(
        ("div", "article", "li")[d(0, 2)], 'class="comment"', 0, _el("span", 'class="author"', 0, d.words(1, 2)), _el("p", "", 0, d.sentence(5, 30))
    )
    return _el(("div", "section", "ol")[d(0, 2)], attrs, 0, *[one() for _ in range(d(1, 4))])


def _form(d: _Draw) -> Element:
    return _el(
        "form", ('action="/s"', 'class="newsletter"', 'class="comment-form"', 'id="search"')[d(0, 3)], 0,
        _el("label", "", 0, d.words(1, 3)), _el("p", "", 0, d.sentence(3, 12)), _el("button", "", 0, d.words(1, 1)),
    )


def _side(d: _Draw) -> Element:
    attrs = ("", 'class="sidebar"', 'id="side"', 'class="related-posts widget"', 'role="complementary"')[d(0, 4)]
    inner = [_el("h3", "", 0, d.words(1, 3)), _links(d)] + ([_el("p", "", 0, d.sentence(3, 15))] if d(0, 1) else [])
    return _el("aside" if d(0, 1) or not attrs else "div", attrs, 0, *inner)


def _extras(d: _Draw, inside: list[Element]) -> list[Element]:
    """Puts boilerplate of several kinds between an article's blocks."""
    for make in (_ad, _form, _side, _notice):
        if d(0, 3) == 0:
            inside.insert(d(1, len(inside)), make(d))
    return inside


def _page(seed: int) -> Element:
    d = _Draw(seed)
    layout = seed % 8
    inside = _extras(d, _body(d))
    if d(0, 2) == 0:
        inside.append(_comments(d))
    if layout in (0, 1):
        main = _el("article", "", 1, *inside)
    elif layout == 2:
        main = _el("main", "", 1, _el("article", 'class="post"', 1, _el("header", "", 1, _el("h1", "", 1, d.words(2, 8))), *inside))
    elif layout == 3:
        main = _el("div", 'id="wrapper"', 1, _el("div", ('class="content"', 'id="content"', 'class="entry-content"')[d(0, 2)], 1, *inside), _side(d))
    elif layout == 4:
        main = _el("table", "", 1, _el("tr", "", 1, _el("td", 'class="menu"', 0, _links(d)), _el("td", "", 1, *inside)))
    elif layout == 5:
        main = _el("div", 'class="post"', 1, _el("div", 'class="post-body"', 1, *inside))
    elif layout == 6:
        main = _el("section", 'class="story"', 1, *inside)
    else:
        main = _el("div", "", 1, *inside)
    before = [make(d) for make in (_header, _nav, _notice, _ad) if d(0, 1)] or [_nav(d)]
    after = [make(d) for make in (_comments, _side, _form, _ad) if d(0, 2) == 0] + [_footer(d)]
    head = _el("head", "", 0, _el("title", "", 0, d.words(2, 8)))
    return _el("html", "", 1, head, _el("body", "", 1, *before, main, *after))


def _html(e: Element, labels: list[int]) -> str:
    tag, attrs, label, children = e
    labels.append(label)
    inner = "".join(c if isinstance(c, str) else _html(c, labels) for c in children)
    return f"<{tag}{' ' + attrs if attrs else ''}>{inner}</{tag}>"


def pages(n: int = N_PAGES) -> Iterator[tuple[str, list[int]]]:
    """(html, the label of every element in page order)."""
    for seed in range(n):
        labels: list[int] = []
        yield _html(_page(seed), labels), labels
