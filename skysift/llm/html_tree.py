"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node that is article (1) or not (0). A node's
potential is linear in features of its tag, class, id, role and text; a parent
and a child share a 2 x 2 potential by the kind of the child. Messages go up
from the leaves and down from the root (sum-product), which gives the exact
marginal of every node; a block of text is kept if its element's marginal is
over one half. Weights come from gradient ascent on the likelihood of the
labelled pages.

Edge cases: a null or empty page, and one without article text, gives an empty
text. Pages without markup are one block of the root. Unclosed and stray tags
are taken as browsers take them, roughly; a page is read in time linear in its
length, whatever its tags and quotes. Repeated rows give repeated results, null ids
stay null. Extra
columns are ignored.
"""

from __future__ import annotations

import html as _entities
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled_pages
from .common import map_rows

#: How a comment, a CDATA section, a declaration, an end tag and a start tag begin.
_TOKEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|/([a-zA-Z][^\s/>]*)|([a-zA-Z][^\s/>]*))")
_OPAQUE = re.compile(r"<!--|<!\[CDATA\[")
#: The rest of a start tag; a > in quotes does not end it.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_MARKS = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "textarea", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "select"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
#: A start tag that closes an open element, up to a container.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"datalist"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}

TAGS = (
    "html", "head", "title", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer",
    "aside", "form", "button", "table", "tr", "td", "a", "span", "blockquote", "pre", "figure", "figcaption", "other-inline", "other-block",
)
#: Words in class, id and role, by what they tell.
HINTS = {
    "ad": r"ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo(?:tion)?",
    "nav": r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toc|skip",
    "foot": r"foot|footer|copyright|legal|contentinfo|disclaimer",
    "head": r"header|masthead|topbar|site-header",
    "side": r"side|sidebar|aside|widget|related|recommended|complementary|popular|tags|share|social",
    "comment": r"comments?|reply|replies|respond|disqus|discussion",
    "notice": r"cookies?|consent|notice|alert|dialog|modal|popup|gdpr|overlay|warning",
    "form": r"form|search|login|signup|subscribe|newsletter|register",
    "body": r"article|content|post|entry|story|main|body|text",
}
_HINT = {k: re.compile(rf"(?:^|[\s_-])(?:{v})(?:$|[\s_\d-])", re.I) for k, v in HINTS.items()}
_HINT_NAMES = tuple(HINTS)
_N_TEXT = 10
N_FEATURES = 1 + len(TAGS) + len(HINTS) + 1 + 1 + _N_TEXT
_TAG_AT = {t: 1 + i for i, t in enumerate(TAGS)}
_HINT_AT = 1 + len(TAGS)
_HIDDEN_AT = _HINT_AT + len(HINTS)
_IN_ARTICLE_AT = _HIDDEN_AT + 1
_TEXT_AT = _IN_ARTICLE_AT + 1
#: Kinds of child for the parent-child potentials.
N_EDGES = 4
_BREAKS = {"nav", "header", "footer", "aside", "form", "head", "button"}


class TagEnds:
    """Where start tags end: at the first > outside quotes; if quotes that never
    close leave none, at the first >."""

    def __init__(self, source: str):
        self.source = source
        self.at: list[int] | None = None
        self.ends: list[int] = []

    def end(self, start: int) -> int:
        """The place of the >, or -1."""
        if self.at is None:
            m = _REST.match(self.source, start)
            if m:
                return m.end() - 1
            self._look_ahead()
        i = bisect_right(self.at, start - 1)
        end = self.ends[i] if i < len(self.at) else -1
        return end if end >= 0 else self.source.find(">", start)

    def _look_ahead(self) -> None:
        """For every mark, the end of a tag that meets it outside quotes, from
        the last mark to the first: one pass, however many tags miss their end."""
        marks = [(m.start(), m.group()) for m in _MARKS.finditer(self.source)]
        self.at = [k for k, _ in marks]
        self.ends = [-1] * (len(marks) + 1)
        later = {}
        for i in range(len(marks) - 1, -1, -1):
            k, c = marks[i]
            if c == ">":
                self.ends[i] = k
            else:
                self.ends[i] = self.ends[later[c] + 1] if c in later else -1
                later[c] = i


class Page:
    """Elements in page order, with parent, features and text; blocks: (the
    element that holds it, its text), in page order."""

    __slots__ = ("parent", "tag", "own", "features", "edge", "blocks")

    def __init__(self, source: str):
        parent, tags, names, hidden = [-1], ["html"], [""], [False]
        stack = [0]
        where: dict[str, list[int]] = defaultdict(list)  # the places in the stack of every open tag
        solid = [0]  # and of those that are not inline
        started = False
        chars, linked, punct = [0], [0], [0]
        blocks: list[tuple[int, list[str]]] = []
        fresh = True
        at, n, last = 0, len(source), source.rfind(">")
        tag_ends = TagEnds(source)
        in_link = 0

        def text(raw: str) -> None:
            nonlocal fresh
            if not raw:
                return
            s = _entities.unescape(raw) if "&" in raw else raw
            k = stack[-1]
            if s.strip():
                size = len(s.strip())
                chars[k] += size
                if in_link:
                    linked[k] += size
                punct[k] += s.count(".") + s.count(",") + s.count("!") + s.count("?")
            elif fresh:
                return
            if fresh:
                blocks.append((stack[solid[-1]], []))
                fresh = False
            blocks[-1][1].append(s)

        def close(to: int) -> None:
            nonlocal fresh, in_link
            while len(stack) > to:
                t = tags[stack.pop()]
                where[t].pop()
                if t == "a":
                    in_link -= 1
                if t not in _INLINE:
                    solid.pop()
                    fresh = True

        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                text(source[at:])
                break
            comment, section, end, tag = m.groups()
            if not comment and not section and m.end() > last:  # nothing ends it: text, up to a comment
                m = _OPAQUE.search(source, m.start())
                stop = m.start() if m else n
                text(source[at:stop])
                at = stop
                continue
            text(source[at : m.start()])
            if comment or section:
                mark = "-->" if comment else "]]>"
                stop = source.find(mark, m.end())
                at = stop + 3 if stop >= 0 else n
                continue
            if not tag:
                at = source.find(">", m.end()) + 1
                end = (end or "").lower()
                if where[end]:
                    close(where[end][-1])
                continue
            stop = tag_ends.end(m.end())
            tag, attrs, at = tag.lower(), source[m.end() : stop], stop + 1
            if tag in _RAW:
                if not attrs.rstrip().endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    at = stop.end() if stop else n
                if tag not in ("svg", "math"):
                    fresh = fresh or tag not in ("script", "style")
                continue
            if tag in _VOID:
                if tag in ("br", "wbr"):
                    if not fresh and tag == "br":
                        blocks[-1][1].append(" ")
                elif tag == "hr":
                    fresh = True
                continue
            if tag == "html" and not started:
                started = True
                self_attrs = _names(attrs)
                names[0], hidden[0] = self_attrs
                continue
            started = True
            if tag in _ENDS_P and tags[stack[solid[-1]]] == "p":
                close(solid[-1])
            if tag in _ENDS:
                which, until = _ENDS[tag]
                bound = max((where[t][-1] for t in until if where[t]), default=0)
                lowest = min((where[t][bisect_right(where[t], bound)] for t in which if where[t] and where[t][-1] > bound), default=0)
                if lowest:
                    close(lowest)
            k = len(tags)
            parent.append(stack[-1])
            tags.append(tag)
            name, is_hidden = _names(attrs)
            names.append(name)
            hidden.append(is_hidden)
            chars.append(0)
            linked.append(0)
            punct.append(0)
            where[tag].append(len(stack))
            if tag not in _INLINE:
                solid.append(len(stack))
            stack.append(k)
            if tag == "a":
                in_link += 1
            if tag not in _INLINE:
                fresh = True

        total, links, marks = chars[:], linked[:], punct[:]
        for k in range(len(tags) - 1, 0, -1):
            p = parent[k]
            total[p] += total[k]
            links[p] += links[k]
            marks[p] += marks[k]
        self.parent, self.tag, self.own = parent, tags, chars
        self.blocks = [(k, " ".join("".join(s).split())) for k, s in blocks]
        self.features, self.edge = [], []
        inside = [False] * len(tags)
        for k, tag in enumerate(tags):
            f = [0, _TAG_AT.get(tag) or _TAG_AT["h3" if tag in ("h4", "h5", "h6") else "other-inline" if tag in _INLINE else "other-block"]]
            if names[k]:
                f += _hints(names[k])
            if hidden[k]:
                f.append(_HIDDEN_AT)
            if k and inside[parent[k]]:
                f.append(_IN_ARTICLE_AT)
            inside[k] = tag in ("article", "main") or (k > 0 and inside[parent[k]])
            c, share = total[k], links[k] / total[k] if total[k] else 0.0
            f.append(_TEXT_AT + (0 if c == 0 else 1 if c < 25 else 2 if c < 80 else 3 if c < 250 else 4))
            f.append(_TEXT_AT + (5 if share < 0.1 else 6 if share < 0.5 else 7))
            if marks[k]:
                f.append(_TEXT_AT + 8)
            if marks[k] > 0.02 * c:
                f.append(_TEXT_AT + 9)
            self.features.append(f)
            self.edge.append(0 if tag in _INLINE else 2 if tag in _BREAKS else 3 if names[k] else 1)


def _names(attrs: str) -> tuple[str, bool]:
    if not attrs:
        return "", False
    name, is_hidden = "", False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "style":
            is_hidden |= "display:none" in value.replace(" ", "").lower()
        elif key == "hidden" or key == "aria-hidden":
            is_hidden |= key == "hidden" or value == "true"
        else:
            name += " " + value
    return name.strip(), is_hidden


@lru_cache(maxsize=20_000)
def _hints(name: str) -> list[int]:
    return [_HINT_AT + i for i, k in enumerate(_HINT_NAMES) if _HINT[k].search(name)]


def _lse(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def beliefs(page: Page, w: list[float], e: list[list[float]]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product: log-odds of every node's marginal; and what the parent's
    (without the child) and the child's sides say about each edge."""
    parent, edge = page.parent, page.edge
    n = len(parent)
    up = [sum([w[i] for i in f]) for f in page.features]
    sent = [0.0] * n
    for k in range(n - 1, 0, -1):
        e00, e01, e10, e11 = e[edge[k]]
        b = up[k]
        sent[k] = _lse(e10, e11 + b) - _lse(e00, e01 + b)
        up[parent[k]] += sent[k]
    odds, above = up[:], [0.0] * n
    for k in range(1, n):
        e00, e01, e10, e11 = e[edge[k]]
        a = odds[parent[k]] - sent[k]
        above[k] = a
        odds[k] = up[k] + _lse(e01, e11 + a) - _lse(e00, e10 + a)
    return odds, above, up


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


@lru_cache(maxsize=2)
def train(n_pages: int = labelled_pages.N_PAGES, rounds: int = 60, l2: float = 2e-3) -> tuple[list[float], list[list[float]]]:
    """(node weights, edge potentials) of the most likely model."""
    data = []
    for source, labels in labelled_pages.pages(n_pages):
        page = Page(source)
        if len(page.tag) != len(labels):
            raise ValueError("a labelled page does not parse into its elements")
        data.append((page, labels))
    total = sum(len(y) for _, y in data)
    size = N_FEATURES + 4 * N_EDGES
    v, m, s = [0.0] * size, [0.0] * size, [0.0] * size
    for t in range(1, rounds + 1):
        w, e = v[:N_FEATURES], [v[N_FEATURES + 4 * i : N_FEATURES + 4 * i + 4] for i in range(N_EDGES)]
        g = [0.0] * size
        for page, y in data:
            odds, above, up = beliefs(page, w, e)
            for k, f in enumerate(page.features):
                d = y[k] - _sigmoid(odds[k])
                for i in f:
                    g[i] += d
                if k:
                    base = N_FEATURES + 4 * page.edge[k]
                    q = e[page.edge[k]]
                    z = [q[0], q[1] + up[k], q[2] + above[k], q[3] + above[k] + up[k]]
                    top = max(z)
                    z = [math.exp(x - top) for x in z]
                    norm = sum(z)
                    for i in range(4):
                        g[base + i] -= z[i] / norm
                    g[base + 2 * y[page.parent[k]] + y[k]] += 1
        for i in range(size):
            x = g[i] / total - l2 * v[i] / 10
            m[i] = 0.9 * m[i] + 0.1 * x
            s[i] = 0.99 * s[i] + 0.01 * x * x
            v[i] += 0.2 * (m[i] / (1 - 0.9**t)) / (math.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)
    return v[:N_FEATURES], [v[N_FEATURES + 4 * i : N_FEATURES + 4 * i + 4] for i in range(N_EDGES)]


def main_text(source: str, model: tuple[list[float], list[list[float]]]) -> str:
    """The blocks whose element is article, joined by an empty line."""
    if not source:
        return ""
    page = Page(source)
    odds, _, _ = beliefs(page, *model)
    return "\n\n".join([t for k, t in page.blocks if t and odds[k] > 0])


def extract(pages: DataFrame, model: tuple | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or train()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [main_text(h, model) for h in part["html"]]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return map_rows(rows, run, "url string, text string, n_chars long", "page_id")


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages)
