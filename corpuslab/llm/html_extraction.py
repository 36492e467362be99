"""Main text of web pages by a tree-structured graphical model.

The page becomes a tree of block elements and text blocks. Each node is content or not; its features (tag, names in
class, id and role, length, link share, punctuation, place, what share of the page's prose it and its siblings hold, what
it stands in) give a unary potential, and each edge has a parent-child potential that depends on the kind of the child. Sum-product messages go up and down the tree once and yield the exact
marginal of every node; text blocks that are content with a chance of one half or more are kept, in page order.

The weights maximise the likelihood of labelled pages, whose gradient needs the same messages. No labelled pages come
with the data, so they are composed here: pages of many layouts whose article is known by construction
(:func:`labelled_pages`). Messages of all pages of a batch are passed together, level by level.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.staging import with_body

#: Depth as a feature is counted up to this; the tree itself has no limit.
MAX_DEPTH = 64
PAGES_AT_ONCE = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_LABEL = re.compile(r'data-y="([01])"')
_SPACE = re.compile(r"\s+")
#: Element names of HTML by role.
#: RAW holds text that is no part of the page: scripts, styles, templates, values of form fields, the title of the window, and what stands in for a frame.
RAW = {"script", "style", "textarea", "title", "template", "iframe", "select", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "center", "picture", "button", "noscript", "math", "mi", "mn", "mo", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "mtext", "mspace", "mstyle", "mover", "munder", "munderover", "semantics", "annotation", "object", "svg", "g", "text", "tspan", "path", "circle", "rect", "line"}
TAGS = ["html", "body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "nav", "header", "footer", "aside", "form", "fieldset", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "address", "details", "dialog", "#text", "#other"]
#: What an opening tag closes implicitly, up to a boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Word stems in class, id and role that name the parts of a page.
STEMS = [
    ("nav", "menu", "breadcrumb", "toc", "pagination", "pager", "skip"),
    ("header", "masthead", "topbar", "branding", "logo"),
    ("footer", "copyright", "colophon", "legal", "imprint"),
    ("sidebar", "side", "widget", "rail", "related", "recommend", "complementary", "popular"),
    ("advert", "sponsor", "promo", "banner", "adsense", "teaser"),
    ("comment", "reply", "replies", "disqus", "respond", "discussion"),
    ("cookie", "notice", "consent", "popup", "modal", "alert", "gdpr", "overlay", "paywall"),
    ("share", "social", "follow", "tags", "meta", "byline"),
    ("form", "login", "signup", "newsletter", "subscribe", "search", "register"),
    ("content", "article", "post", "entry", "main", "story", "text", "body"),
]
_STEM = [re.compile(r"(?<![a-z])(?:" + "|".join(x) + ")") for x in STEMS]
_AD = re.compile(r"(?<![a-z])ads?(?![a-z])")
_tag_number = {t: i for i, t in enumerate(TAGS)}
#: Kinds of children that have a parent-child potential of their own.
KINDS = 7
_kind = {"#text": 0, "p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "ul": 3, "ol": 3, "li": 3, "dl": 3, "dt": 3, "dd": 3, "nav": 4, "header": 4, "footer": 4, "aside": 4, "form": 4, "fieldset": 4, "dialog": 4, "article": 5, "main": 5}
_tag_kind = np.array([_kind.get(t, 6) for t in TAGS])
_BASE = len(TAGS) + len(STEMS)
FEATURES = _BASE + 29
#: Elements that hold no article, those of a list or a line, and elements that are an article.
_OUTER = np.array([t in ("nav", "footer", "aside", "form", "fieldset", "dialog") for t in TAGS])
_LISTED = np.array([t in ("li", "ul", "ol", "dl", "dt", "dd", "p", "#text") for t in TAGS])
_REGION = np.array([t in ("article", "main") for t in TAGS])
#: Stems (by place in STEMS) whose names no article has; page headers and tags may be in one.
_FOREIGN = sum(1 << k for k in (0, 2, 3, 4, 5, 6, 8))
_CONTENT = 1 << 9


@lru_cache(maxsize=50_000)
def _named(names: str) -> int:
    names = names.lower()
    bits = sum(1 << k for k, stem in enumerate(_STEM) if stem.search(names))
    return bits | (1 << 4) * bool(_AD.search(names))


class Forest:
    """Trees of several pages: one entry a node, parents before children."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.level: list[int] = []
        self.depth: list[int] = []
        self.tag: list[int] = []
        self.bits: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self.label: list[int] = []
        self.roots: list[int] = []

    def _node(self, parent: int, tag: int, bits: int, label: int, text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.level.append(0 if parent < 0 else self.level[parent] + 1)
        self.depth.append(min(self.level[-1], MAX_DEPTH))
        self.tag.append(tag)
        self.bits.append(bits)
        self.text.append(text)
        self.linked.append(linked)
        self.label.append(label)
        return len(self.parent) - 1

    def add(self, page: str) -> None:
        """Parse a page; malformed markup never fails: unclosed tags, stray ends and broken comments are passed over."""
        root, directly = self._node(-1, _tag_number["html"], 0, 0), 0  # the label of what stands directly in the body
        self.roots.append(root)
        stack, nodes = ["html"], [root]
        places: dict[str, list[int]] = {}  # of open elements in the stack, by name
        pieces: list[str] = []
        linked, in_link, at = 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
                if text:
                    self._node(nodes[-1], _tag_number["#text"], 0, directly if nodes[-1] == root else self.label[nodes[-1]], text, linked)
                pieces.clear()
            linked = 0

        def words(text: str) -> None:
            nonlocal linked
            if text:
                pieces.append(text)
                if in_link:
                    linked += len(text)

        def cut(k: int) -> None:
            while len(stack) > k:
                places[stack.pop()].pop()
                nodes.pop()

        while True:
            found = _TOKEN.search(page, at)
            if not found:
                words(page[at:])
                break
            words(page[at : found.start()])
            at = found.end()
            end, name, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
            if not name:
                if found[0].startswith("<![CDATA["):
                    words(html.escape(found[0][9:].removesuffix("]]>")))
                continue
            name = name.lower()
            if name in RAW:
                if not end and not rest.endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    at = close.end() if close else len(page)
                continue
            if name in INLINE:
                if name == "a":
                    in_link = 0 if end else 1
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br":
                    pieces.append(" ")
                continue
            flush()
            if name in ("html", "body", "head"):
                directly = int("data-y" in rest and bool(_LABEL.search(rest)) and _LABEL.search(rest)[1] == "1") if not end else directly
                continue
            if end:
                if places.get(name):
                    cut(places[name][-1])
                in_link = 0
                continue
            if stack[-1] == "p":
                cut(len(stack) - 1)
            if name in CLOSES:
                closed, bound = CLOSES[name]
                k = max((places[x][-1] for x in bound | closed if places.get(x)), default=0)
                while k > 0 and stack[k] in closed:
                    cut(k)
                    k -= 1
            names = " ".join(x.strip("\"'") for x in _NAMES.findall(rest)) if rest and "=" in rest else ""
            label = _LABEL.search(rest) if rest and "data-y" in rest else None
            parent = nodes[-1]
            number = self._node(parent, _tag_number.get(name, len(TAGS) - 1), _named(names) if names else 0, int(label[1]) if label else directly if parent == root else self.label[parent])
            places.setdefault(name, []).append(len(stack))
            stack.append(name)
            nodes.append(number)
        flush()

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(parent, level, kind of child, features)."""
        parent, level, depth, tag = np.array(self.parent), np.array(self.level), np.array(self.depth), np.array(self.tag)
        n = len(parent)
        x = np.zeros((n, FEATURES))
        x[np.arange(n), tag] = 1
        bits = np.array(self.bits)
        for k in range(len(STEMS)):
            x[:, len(TAGS) + k] = bits >> k & 1
        chars = np.array([len(t) for t in self.text], float)
        linked = np.minimum(np.array(self.linked, float), chars)
        stops = np.array([t.count(". ") + t.count("? ") + t.count("! ") + (t[-1:] in ".?!") for t in self.text], float)
        words = np.array([t.count(" ") + 1 if t else 0 for t in self.text], float)
        marked = np.array(["©" in t or "&copy" in t for t in self.text], float)
        blocks, paragraphs = (chars > 0).astype(float), (tag == _tag_number["p"]).astype(float)
        own, own_stops, own_links = chars.copy(), stops.copy(), linked > 0.6 * np.maximum(1, chars)
        prose = chars * ((stops > 0) & (words >= 6) & (linked < 0.5 * chars))
        titles = (tag == _tag_number["h1"]).astype(float)
        sections = _REGION[tag].astype(float)
        totals = np.stack([chars, linked, stops, words, blocks, paragraphs, prose, titles, sections])
        levels = by_level(level)
        for at in reversed(levels[1:]):
            for row in totals:
                np.add.at(row, parent[at], row[at])
        inner = np.zeros(n)  # paragraphs that are children
        np.add.at(inner, parent[parent >= 0], paragraphs[parent >= 0])
        foreign, region, named = _OUTER[tag] | (bits & _FOREIGN > 0), _REGION[tag], bits & _CONTENT > 0
        headed, host = tag == _tag_number["header"], np.maximum(parent, 0)  # host: the block that a list or a line stands in
        for at in levels[1:]:
            for flag in (foreign, region, named, headed):
                flag[at] |= flag[parent[at]]
            listed = at[_LISTED[tag[parent[at]]]]
            host[listed] = host[parent[listed]]
        page = np.zeros(n, np.int64)
        page[self.roots] = 1
        page = np.array(self.roots)[np.cumsum(page) - 1]
        chars, linked, stops, words, blocks, paragraphs, prose, titles, sections = totals
        base, above = _BASE, np.maximum(parent, 0)
        some = np.maximum(1, chars)
        x[:, base] = 1
        x[:, base + 1] = np.log1p(chars) / 6
        x[:, base + 2] = linked / some
        x[:, base + 3] = linked / some > 0.6
        x[:, base + 4] = np.minimum(stops / np.maximum(1, words) * 10, 3)
        x[:, base + 5] = words / np.maximum(1, blocks) > 12
        x[:, base + 6] = np.minimum(paragraphs, 5) / 5
        x[:, base + 7] = chars / np.maximum(1, chars[page])
        x[:, base + 8] = marked
        x[:, base + 9] = (own > 0) & (words < 5)
        x[:, base + 10] = (own > 0) & (stops == 0)
        x[:, base + 11] = np.minimum(depth, 10) / 10
        whole, parted = np.maximum(1, prose[page]), sections[page] > 0
        x[:, base + 12] = prose / whole
        x[:, base + 13] = prose[above] / whole
        x[:, base + 14] = np.minimum(inner[above], 6) / 6
        x[:, base + 15] = foreign
        x[:, base + 16] = parted & region
        x[:, base + 17] = parted & ~region & (sections == 0)
        x[:, base + 18] = ~parted & ~foreign
        x[:, base + 19] = ~parted & ~foreign & (linked / some > 0.6)
        x[:, base + 20] = region & ~foreign
        x[:, base + 21] = headed & ~region
        x[:, base + 22] = headed & region & (titles > 0)
        x[:, base + 23] = (own > 0) & (own_stops == 0) & own_links & region & ~foreign
        x[:, base + 24] = named & ~foreign
        x[:, base + 25] = ~foreign & (prose / whole > 0.3)
        x[:, base + 26] = ~parted & ~foreign & (titles > 0) & (own + chars < 300)
        x[:, base + 27] = (linked / some > 0.6) & (prose[host] == 0)
        x[:, base + 28] = (linked / some > 0.6) & (prose[host] / whole > 0.3) & ~foreign
        return parent, level, _tag_kind[tag], x


def by_level(level: np.ndarray) -> list[np.ndarray]:
    """The nodes of each level, in order."""
    return np.split(np.argsort(level, kind="stable"), np.cumsum(np.bincount(level))[:-1]) if len(level) else []


def messages(parent: np.ndarray, depth: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Exact marginals of nodes (n, 2) and of edges (n, parent state, own state; roots: zeros), and the log partition sum."""
    n = len(parent)
    inside = unary.copy()
    up = np.zeros((n, 2))
    levels = by_level(depth)
    for at in reversed(levels[1:]):
        up[at] = np.logaddexp(pair[at, :, 0] + inside[at, 0:1], pair[at, :, 1] + inside[at, 1:2])
        np.add.at(inside, parent[at], up[at])
    total = inside.copy()
    for at in levels[1:]:
        rest = total[parent[at]] - up[at]  # all that the parent knows but what this child said
        total[at] += np.logaddexp(pair[at, 0] + rest[:, 0:1], pair[at, 1] + rest[:, 1:2])
    norm = np.logaddexp(total[:, 0], total[:, 1])
    node = np.exp(total - norm[:, None])
    edge = np.zeros((n, 2, 2))
    child = np.flatnonzero(parent >= 0)
    score = (total[parent[child]] - up[child])[:, :, None] + pair[child] + inside[child][:, None, :]
    score -= score.max((1, 2), keepdims=True)
    score = np.exp(score)
    edge[child] = score / score.sum((1, 2), keepdims=True)
    return node, edge, float(norm[parent < 0].sum())


class Model:
    """Unary weights by feature and state, parent-child weights by kind of child and both states."""

    def __init__(self) -> None:
        self.unary, self.pair = np.zeros((FEATURES, 2)), np.zeros((KINDS, 2, 2))

    def marginals(self, forest: Forest) -> np.ndarray:
        parent, depth, kind, x = forest.arrays()
        return messages(parent, depth, x @ self.unary, self.pair[kind])[0][:, 1]

    def fit(self, forest: Forest, steps: int = 150, rate: float = 0.1, decay: float = 0.5) -> None:
        """Likelihood of the labels of all nodes, by Adam on its exact gradient."""
        parent, depth, kind, x = forest.arrays()
        label = np.array(forest.label)
        child = np.flatnonzero(parent >= 0)
        truth, pairs = np.eye(2)[label], np.zeros((len(parent), 2, 2))
        pairs[child, label[parent[child]], label[child]] = 1
        state = [np.zeros_like(a) for a in (self.unary, self.pair, self.unary, self.pair)]
        for step in range(1, steps + 1):
            node, edge, _ = messages(parent, depth, x @ self.unary, self.pair[kind])
            slope = np.zeros_like(self.pair)
            np.add.at(slope, kind[child], (pairs - edge)[child])
            for k, (weight, g) in enumerate(((self.unary, x.T @ (truth - node)), (self.pair, slope))):
                g = g - decay * weight
                state[k] = 0.9 * state[k] + 0.1 * g
                state[k + 2] = 0.99 * state[k + 2] + 0.01 * g * g
                weight += rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 2] / (1 - 0.99**step)) + 1e-8)


def labelled_pages(n: int, seed: int = 41) -> Iterator[str]:
    """Composed pages of many layouts; ``data-y`` on an element labels what is in it, up to the next such element."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u an er on".split()]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 2, 3))))

    def sentence(low: int = 4, high: int = 20) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice("....?!")

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def links(tag: str, k: int) -> str:
        return "".join(f'<{tag}><a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 4)))}</a></{tag}>' for _ in range(k))

    def name(*options: str) -> str:
        return f' class="{rng.choice(options)}"' if rng.random() < 0.8 else f' id="{rng.choice(options)}"'

    def boilerplate() -> str:
        kind = rng.randrange(9)
        tag = rng.choice(("div", "div", "section", "aside"))
        if kind == 0:
            return f'<{rng.choice(("nav", "div" + name("nav", "menu", "main-menu", "breadcrumbs")))} data-y="0"><ul>{links("li", rng.randint(2, 9))}</ul></nav>'.replace("</nav>", "</nav></div>")
        if kind == 1:
            return f'<{tag}{name("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner")} data-y="0">{rng.choice((sentence(), prose(1, 3), f"<p>{prose(1, 3)}</p>"))}</{tag}>'
        if kind == 2:
            return f'<aside{name("sidebar", "related", "widget", "rail")} data-y="0"><h3>{sentence(1, 4)}</h3>{rng.choice(("<p>" + prose(1, 3) + "</p>", "<ul>" + links("li", 4) + "</ul>"))}</aside>'
        if kind == 3:
            return f'<{tag}{name("cookie-notice", "notice", "consent", "alert", "gdpr")} data-y="0"><p>{prose(1, 3)}</p><a href="#">{word()}</a></{tag}>'
        if kind == 4:
            inner = "".join(f'<div{name("comment", "reply")}><b>{word()}</b><p>{prose(1, 4)}</p></div>' for _ in range(rng.randint(1, 5)))
            return f'<{rng.choice(("div", "section"))}{name("comments", "comment-list", "discussion", "replies")} data-y="0"><h3>{sentence(1, 3)}</h3>{inner}</div></section>'
        if kind == 5:
            return f'<form{name("search", "newsletter", "signup", "login")} data-y="0"><p>{sentence()}</p><label>{word()}</label><input type="text"><button>{word()}</button></form>'
        if kind == 6:
            return f'<div{name("share", "social", "tags", "follow")} data-y="0">{links("span", rng.randint(2, 6))}</div>'
        if kind == 7:
            return f'<header data-y="0"><h{rng.choice("122")}>{sentence(1, 3)}</h2><p>{sentence(2, 8)}</p></header>'
        return f'<{tag}{name("related", "recommended", "popular", "teaser")} data-y="0"><h4>{sentence(1, 4)}</h4>{"".join("<p><a href=/x>" + sentence() + "</a></p>" for _ in range(rng.randint(1, 4)))}</{tag}>'

    def body() -> str:
        parts = []
        for _ in range(rng.randint(1, 10)):
            pick = rng.random()
            text = rng.choice((prose, prose, prose, lambda: sentence(1, 4)))()
            if pick < 0.62:
                parts.append(rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{sentence()}<br><p>{text}</p>", f"<p>{text} <a href=/y>{word()}</a> {sentence()}</p>", f"<div>{text}</div>")))
            elif pick < 0.74:
                parts.append(f"<h{rng.choice('234')}>{sentence(1, 6)}</h3>")
            elif pick < 0.84:
                parts.append("<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif pick < 0.88:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif pick < 0.91:
                parts.append(f"<table><tr><td>{word()}<td>{word()}<tr><td>{word()}<td>{word()}</table>")
            elif pick < 0.94:
                parts.append(f"<pre>{sentence()}</pre>")
            else:
                parts.append(boilerplate())
        return "".join(parts)

    def plain() -> str:
        """A name that says nothing, or none."""
        return rng.choice(("", "", f' id="{rng.choice(plain_names)}"', f' class="{rng.choice(plain_names)} {rng.choice(plain_names)}"'))

    def around(k: int) -> str:
        """What stands before or after an article, each part labelled."""
        return "".join(boilerplate() for _ in range(rng.randint(0, k)))

    def headline() -> str:
        title = f"<h1>{sentence(1, 10)}</h1>"
        return rng.choice((title, title, title, "", f"<header>{title}</header>", f"<header data-y=\"1\">{title}</header>"))

    def simple() -> str:
        """Some paragraphs of one kind, short or long, at times with a list of links."""
        low, high = rng.choice(((1, 2), (2, 2), (1, 4), (3, 8)))
        paragraphs = [f"<p>{prose(low, high)}</p>" for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.35:
            paragraphs.insert(rng.randint(1, len(paragraphs)), f"<ul>{links('li', rng.randint(2, 4))}</ul>")
        return "".join(paragraphs)

    plain_names = ["c1", "x7", "col-8", "block", "row", "wrap2", "grid", "left", "w100", "inner", "box", "k12", "page", "layout"]
    for _ in range(n):
        nav = rng.choice(("", f'<nav data-y="0"><ul>{links("li", rng.randint(3, 8))}</ul></nav>', f'<nav{name("menu", "nav", "top")} data-y="0"><ul>{links("li", rng.randint(3, 8))}</ul></nav>', f'<div data-y="0">{links("span", rng.randint(3, 8))}</div>'))
        foot = rng.choice(("", f'<footer data-y="0">&copy; {word()}.example &middot; {sentence()}</footer>', f'<footer data-y="0"><p>&copy; {word()} {sentence()}</p><ul>{links("li", 4)}</ul></footer>', f'<div{name("footer", "site-footer")} data-y="0">{sentence()} <a href="/">{word()}</a></div>'))
        article, layout = headline() + rng.choice((body, simple))(), rng.random()
        if layout < 0.5:  # an element that says that it is the article
            tag = rng.choice(("article", "article", "main", "div", "section"))
            named = name("content", "post", "entry-content", "article-body", "story", "main-content") if tag in ("div", "section") or rng.random() < 0.3 else ""
            article = f'<{tag}{named} data-y="1">{article}</{tag}>'
            if rng.random() < 0.3:
                article = f"<div{name('wrapper', 'container', 'page', 'layout')}>{article}{around(2)}</div>"
            inside, directly = f"{nav}{around(3)}{article}{around(3)}{foot}", 0
        elif layout < 0.65:  # an element without a telling name
            tag = rng.choice(("div", "div", "section"))
            article = f'<{tag}{plain()} data-y="1">{article}</{tag}>'
            inside, directly = f"{nav}{around(2)}{article}{around(2)}{foot}", 0
        elif layout < 0.78:  # no element at all
            inside, directly = f"{nav}{around(2)}{article}{around(2)}{foot}", 1
        elif layout < 0.9:  # one element with all parts of the page side by side
            inside, directly = f'<div{plain()} data-y="1">{nav}{around(1)}{article}{around(2)}{foot}</div>', 0
        else:  # a table of columns
            left, right = (f'<td data-y="0">{rng.choice(("<ul>" + links("li", 5) + "</ul>", around(1)))}</td>' for _ in "ab")
            inside, directly = f'{nav}<table><tr>{rng.choice(("", left))}<td{plain()} data-y="1">{article}</td>{rng.choice(("", right))}</tr></table>{foot}', 0
        yield f'<!DOCTYPE html><html><head><title>{word()}</title></head><body data-y="{directly}">{inside}</body></html>'


@lru_cache(maxsize=1)
def trained(pages: int = 700) -> Model:
    """The model learned from the composed pages; always the same."""
    forest, model = Forest(), Model()
    for page in labelled_pages(pages):
        forest.add(page)
    model.fit(forest)
    return model


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    out = []
    for first in range(0, len(pages), PAGES_AT_ONCE):
        forest = Forest()
        for page in pages[first : first + PAGES_AT_ONCE]:
            forest.add(page or "")
        content = model.marginals(forest)
        ends = [*forest.roots[1:], len(forest.parent)]
        for root, end in zip(forest.roots, ends, strict=True):
            out.append("\n\n".join(forest.text[k] for k in range(root, end) if forest.text[k] and content[k] >= 0.5))
    return out


def _extract(shared, n_carry: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(first, PAGES_AT_ONCE)
                texts = main_texts(part.column(n_carry).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n_carry)] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return run


def extract(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """The ``carry`` columns (default: all but the html) with ``text`` and ``n_chars``.

    A null or empty page, and one without content, has the empty text. Pages are taken whole, whatever their length;
    repeated rows get the same text; columns named ``text`` or ``n_chars`` are replaced.
    """
    carry = [c for c in pages.columns if c not in (html_col, "text", "n_chars")] if carry is None else carry
    rows = with_body(pages, carry, html_col)
    schema = pages.select(*[f"`{c}`" for c in carry], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    return rows.mapInArrow(_extract(shared, len(carry), schema.names), schema)


def query_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
