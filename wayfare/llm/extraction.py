"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed to block nodes (and links, spans with attributes); inline markup only carries text. Each node gets
features of its tag, its attribute tokens and those of its ancestors, depth, siblings, and its subtree: text, link
density, tag density, punctuation. Boosted trees (``boosting``) give the log-odds that a node's subtree is main text. They
are trained here, once in a process, on ``PAGES`` invented pages whose generator knows what is main text; no page of the
table is used for it, so a page's result depends on that page only.

Decoding chooses for each node one of: open (children decide), main, or out, with the largest sum of log-probabilities
under the rule that below a main node there are main and out nodes only, and below an out node only out nodes: so no
descendant is kept of something that was thrown away, and no ancestor is thrown away around kept text.

Text: character references decoded, white space turned into one space, trimmed; blocks and line breaks are joined by one
space, in page order. Contents of script, style, template, head, controls and comments never count.

Defined results: null or empty html, or a page without main text, gives an empty text. A null url stays null. Repeated
rows give equal results; extra columns are ignored; an empty table gives an empty result. Unclosed and stray tags are
closed as browsers close them, without error.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._words import small_batches
from .boosting import BoostedTrees

PAGES = 700
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video textarea select button title head datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset(
    "b i em strong u s small sub sup code font mark abbr cite q time var kbd samp bdi bdo ins del tt big strike acronym dfn label ruby rb rt rp data output wbr img nobr center".split()
) - {"center"}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")
}
SCOPE = frozenset("ul ol dl table body html div section article main nav aside header footer form td th blockquote".split())
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style|data-y)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
TAGS = [
    ("article",), ("main",), ("section",), ("div",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"),
    ("li", "dt", "dd"), ("table", "tbody", "thead"), ("tr", "td", "th"), ("nav",), ("header",), ("footer",), ("aside",),
    ("form", "fieldset"), ("figure", "figcaption"), ("blockquote", "pre"), ("a",), ("span",), ("body", "html")
]
#: Tokens of class, id and role attributes, by what they stand for.
TOKENS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "head": "header masthead topbar logo branding head banner",
    "foot": "footer foot copyright legal colophon contentinfo",
    "side": "sidebar side widget widgets rail secondary complementary aside",
    "ad": "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall banner disclaimer toast",
    "comment": "comment comments reply replies respond response discussion disqus thread review reviews feedback",
    "share": "share sharing social follow related recommended recommendations trending popular tags tag byline meta author similar",
    "form": "form search login register contact input",
    "content": "content article post entry story body main text prose blog page",
    "hidden": "hidden none invisible offscreen",
}
GROUPS = list(TOKENS)
GROUP_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        GROUP_OF.setdefault(_w, []).append(_k)
TAG_OF = {t: k for k, names in enumerate(TAGS) for t in names}
BOILER = [GROUPS.index(g) for g in GROUPS if g not in ("content",)]
OPEN_COST = math.log(0.5)


class _Open:
    """The open elements: (name, node), and where each name, and each element that bounds a scope, is open."""

    def __init__(self):
        self.items: list[tuple[str, int]] = [("html", 0)]  # inline elements carry their parent's node
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    @property
    def node(self) -> int:
        return self.items[-1][1]

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        if name in SCOPE:
            self.scopes.append(len(self.items))
        self.items.append((name, node))

    def last(self, name: str) -> int:
        """The innermost place of an open element, 0 if there is none."""
        found = self.places.get(name)
        return found[-1] if found else 0

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0

    def cut(self, at: int) -> None:
        """Closes the elements from a place on."""
        for name, _ in reversed(self.items[at:]):
            self.places[name].pop()
            if name in SCOPE:
                self.scopes.pop()
        del self.items[at:]

    def forget(self, name: str) -> None:
        """Closes the innermost element of a name, but none of those within it."""
        at = self.places[name].pop()
        self.items[at] = ("", self.items[at][1])
        self.places.setdefault("", []).append(at)

    def links(self) -> int:
        return len(self.places.get("a", ()))


class _Closing:
    """Where the skipped elements of one kind end: every tag of the kind is looked at once."""

    def __init__(self, source: str, name: str):
        self.ends: dict[int, int] = {}  # end of the open tag to the end of its element
        waiting: list[int] = []
        for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(source):
            if not m[1]:
                if not m[0].endswith("/>"):
                    waiting.append(m.end())
            elif waiting:
                self.ends[waiting.pop()] = m.end()


class Page:
    """Nodes in page order (parents first) and pieces of text: (node, text, inside a link).

    Tags are read in time that grows with the page, whatever is left open or closed without having been opened. An
    element whose content is skipped but that is never closed loses its tag only; but an unclosed script or style takes the
    rest of the page, as in browsers."""

    def __init__(self, source: str):
        self.tag, self.attrs, self.parent, self.depth, self.mark = ["html"], [""], [-1], [0], [None]
        self.pieces: list[tuple[int, str, bool]] = []
        stack, closing_of, unclosed = _Open(), {}, set()
        at, end = 0, len(source)
        tags = source.rfind(">") + 1  # no tag ends behind it
        for m in iter(lambda: TOKEN.search(source, at, tags), None):
            if m.start() > at:
                self.pieces.append((stack.node, source[at : m.start()], stack.links() > 0))
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing, rest = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            if closing:
                k = stack.last(name)
                if k and not ((name == "p" or name in INLINE) and stack.scope() > k):
                    stack.cut(k)
                if name not in INLINE and name not in ("a", "span"):
                    self.pieces.append((stack.node, " ", False))
                continue
            if name in SILENT and not rest.endswith("/"):
                if name in RAW:
                    stop = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(source, at)
                    if stop:
                        at = stop.end()
                    elif name in ("script", "style"):
                        at = end
                    else:
                        unclosed.add(name)  # looked for once
                elif name == "head":
                    at = self._after_head(source, at)
                else:
                    if name not in closing_of:
                        closing_of[name] = _Closing(source, name)
                    at = closing_of[name].ends.get(at, at)
                self.pieces.append((stack.node, " ", False))
                continue
            if name in VOID or name in SILENT:
                if name in ("br", "hr"):
                    self.pieces.append((stack.node, " ", False))
                continue
            if name in INLINE:
                stack.push(name, stack.node)
                continue
            if name == "html" or name == "body" and stack.last(name):
                continue
            if name in CLOSES_P and stack.last("p") > stack.scope():
                stack.cut(stack.last("p"))
            while same := max((stack.last(x) for x in SAME.get(name, ())), default=0):
                if same < stack.scope():
                    break
                stack.cut(same)
                if name not in ("tr", "tbody", "tfoot", "thead"):
                    break
            if name == "a" and stack.links():
                stack.forget("a")
            if name not in ("a", "span"):
                self.pieces.append((stack.node, " ", False))
            elif name == "span" and not rest.strip():
                stack.push(name, stack.node)
                continue
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
            if "display:none" in found.get("style", "").replace(" ", "").lower() or "hidden" in found:
                found["role"] = found.get("role", "") + " hidden"
            self.tag.append(name)
            self.attrs.append(" ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label")))
            self.mark.append(found.get("data-y"))
            self.parent.append(stack.node)
            self.depth.append(self.depth[stack.node] + 1)
            stack.push(name, len(self.tag) - 1)
        if at < end:
            self.pieces.append((stack.node, source[at:], stack.links() > 0))

    @staticmethod
    def _after_head(source: str, at: int) -> int:
        stop = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(source, at)
        return stop.end() if stop else at

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """A row for each node, and the length of the text below it."""
        n = len(self.tag)
        sums = np.zeros((n, 6))  # text length, link text, words, sentence marks, nodes, capitals
        for node, text, link in self.pieces:
            size = len(text)
            if size == 1 or not (words := text.count(" ") + 1 if not text.isspace() else 0):
                continue
            marks = text.count(".") + text.count(",") + text.count("!") + text.count("?")
            row = sums[node]
            row[0] += size
            row[1] += size * link
            row[2] += words
            row[3] += marks
            row[5] += text[:1].isupper()
        sums[:, 4] = 1
        parent = self.parent
        for i in range(n - 1, 0, -1):
            p = parent[i]
            sums[p] += sums[i]
        own = np.zeros((n, len(GROUPS)))
        for i, attrs in enumerate(self.attrs):
            if attrs:
                for w in re.findall(r"[a-z]+", attrs.lower()):
                    for k in GROUP_OF.get(w, ()):
                        own[i, k] = 1
        tags = np.zeros((n, len(TAGS)))
        for i, t in enumerate(self.tag):
            k = TAG_OF.get(t)
            if k is not None:
                tags[i, k] = 1
        shady = own[:, BOILER].max(1)
        for t in ("nav", "header", "footer", "aside", "form"):
            shady = np.maximum(shady, tags[:, TAG_OF[t]])
        good = np.maximum(own[:, GROUPS.index("content")], np.maximum(tags[:, 0], tags[:, 1]))
        above, inside, place, count = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            above[i], inside[i] = max(above[p], shady[p]), max(inside[p], good[p])
            place[i] = count[p]
            count[p] += 1
        up = np.maximum(np.array(parent), 0)
        length, link, words, marks, nodes, capitals = sums.T
        size = lambda v, most: np.log1p(np.minimum(v, most))  # noqa: E731  pages may be far longer than any invented one
        place, count, total = np.minimum(place, 8), np.minimum(count, 40), np.minimum(count[up], 40)
        some = np.maximum(length, 1)
        linked = link / some
        around = (sums[up, 1] - link) / np.maximum(sums[up, 0] - length, 1)
        columns = [
            size(length, 2000), linked, size(words, 400), marks / np.maximum(words, 1), np.minimum(length / nodes, 500), size(nodes, 40), capitals / nodes, np.minimum(
                np.array(self.depth), 8
            ),
            place, total, np.maximum(length / np.maximum(length[up], 1), 0.02), around, linked[up], size(length[up], 2000), np.minimum(
                words / np.maximum(capitals, 1), 60
            ), above, inside, shady, good, count,
        ]
        return np.column_stack([*columns, own, tags]), length

    def decode(self, margin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which nodes are main, by the best consistent choice; an open node's own text is main by its own odds."""
        n = len(self.tag)
        yes = -np.logaddexp(0, -margin) * (length > 0)
        no = -np.logaddexp(0, margin) * (length > 0)
        main, out, open_ = yes.tolist(), no.tolist(), [OPEN_COST] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            main[p] += max(main[i], out[i])
            out[p] += out[i]
            open_[p] += max(main[i], out[i], open_[i])
        keep, state = np.zeros(n, bool), [0] * n  # 0 open, 1 main, 2 out
        for i in range(n):
            above = state[self.parent[i]] if i else 0
            if above == 2:
                state[i] = 2
            elif above == 1:
                state[i] = 1 if main[i] >= out[i] else 2
            else:
                state[i] = max((main[i], 1), (out[i], 2), (open_[i], 0))[1]
            keep[i] = state[i] == 1 or state[i] == 0 and margin[i] > 0 and not length[i] == 0
        return keep

    def text(self, keep: np.ndarray) -> str:
        """The kept text; a dropped piece separates like a block only where markup does."""
        held = "".join(x if keep[node] else (" " if x.isspace() else "") for node, x, _ in self.pieces)
        return " ".join(entities.unescape(held).split())


def invented_page(r: random.Random) -> str:
    """A page of random words and layout; ``data-y`` marks what is main text (1) and what is not (0)."""

    def word() -> str:
        return "".join(r.choice("aeioubcdlmnprstvwh") for _ in range(r.randint(1, 9)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def prose(a: int, b: int) -> str:
        out = []
        for _ in range(r.randint(a, b)):
            s = words(2, 22).capitalize()
            if r.random() < 0.12:
                s += f' <a href="/{word()}">{words(1, 4)}</a> {words(1, 6)}'
            if r.random() < 0.1:
                s = f"<b>{s}</b>"
            out.append(s + r.choice(".....,!?"))
        return r.choice([" ", " ", "<br>", "\n"]).join(out)

    def named(names: str) -> str:
        a = r.choice(names.split())
        return r.choice([f' class="{a}"', f' id="{a}"', f' class="{word()} {a}"', f' class="{a}-{word()}"', f' class="{a}" id="{word()}"'])

    def links(a: int, b: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b)))

    def content() -> str:
        out = [f"<h1>{words(1, 14).capitalize()}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 25])):
            k = r.random()
            if k < 0.62:
                p = prose(1, r.choice([1, 2, 4, 9]))
                out.append(r.choice([f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br>", f"<div><p>{p}</p></div>"]))
            elif k < 0.72:
                out.append(f"<h{r.randint(2, 4)}>{words(1, 8)}</h{r.randint(2, 4)}>")
            elif k < 0.8:
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{words(1, 14)}</li>" for _ in range(r.randint(1, 7))) + f"</{t}>")
            elif k < 0.84:
                out.append(
                    "<table>" + "".join(
                        "<tr>" + "".join(f"<td>{words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 5))
                    ) + "</table>"
                )
            elif k < 0.89:
                out.append(f"<blockquote>{prose(1, 2)}</blockquote>")
            elif k < 0.92:
                out.append(f"<figure><img src='{word()}.png'><figcaption>{words(2, 9)}</figcaption></figure>")
            elif k < 0.95:
                out.append(f"<pre>{words(3, 30)}</pre>")
            elif k < 0.975:
                out.append(boiler(r.choice([ad, share, ad])))
            else:
                out.append(words(1, 12).capitalize() + ".")
        return "".join(out)

    def boiler(kind) -> str:
        return kind()

    def nav() -> str:
        t = r.choice(["nav", "nav", "div", "ul", "header"])
        a = named(TOKENS["nav"]) if t in ("div", "ul") or r.random() < 0.4 else ""
        return f'<{t}{a} data-y="0">' + (
            links(2, 9) if t == "ul" else f"<ul>{links(2, 9)}</ul>" if r.random() < 0.8 else " ".join(
                f'<a href="/">{words(1, 2)}</a>' for _ in range(r.randint(2, 7))
            )
        ) + f"</{t}>"

    def header() -> str:
        t = r.choice(["header", "header", "div"])
        return f'<{t}{named(TOKENS["head"]) if t == "div" else ""} data-y="0">{r.choice(["<h1>", "<div>", "<p>", "<a href=/>"])}{words(1, 6)}</{r.choice(["h1", "div", "p", "a"])}>{nav() if r.random() < 0.4 else ""}{"<p>" + words(2, 9) + "</p>" if r.random() < 0.4 else ""}</{t}>'

    def footer() -> str:
        t = r.choice(["footer", "footer", "div"])
        return f'<{t}{named(TOKENS["foot"]) if t == "div" else ""} data-y="0">{r.choice(["", "&copy; ", "<p>"])}{words(1, 5)} &middot; {prose(1, 3)}{links(0, 4) if r.random() < 0.3 else ""}</{t}>'

    def side() -> str:
        t = r.choice(["aside", "div", "section"])
        return f'<{t}{named(TOKENS["side"]) if t != "aside" else r.choice(["", named(TOKENS["share"])])} data-y="0"><h3>{words(1, 4)}</h3>{"<p>" + prose(1, 4) + "</p>" if r.random() < 0.6 else f"<ul>{links(2, 8)}</ul>"}</{t}>'

    def ad() -> str:
        t = r.choice(["div", "div", "div", "aside", "p", "section", "span"])
        return f'<{t}{named(TOKENS["ad"])} data-y="0">{r.choice([prose(1, 3), words(1, 9), "<p>" + prose(1, 2) + "</p>"])}</{t}>'

    def notice() -> str:
        t = r.choice(["div", "section", "p", "aside"])
        return f'<{t}{named(TOKENS["notice"])} data-y="0">{r.choice(["", "<p>"])}{prose(1, 4)} <button>{word()}</button></{t}>'

    def form() -> str:
        return f'<form{r.choice(["", named(TOKENS["form"])])} data-y="0"><label>{words(1, 4)}</label><input name="{word()}"> <p>{words(2, 12)}</p><select><option>{word()}</option></select><button>{word()}</button></form>'

    def comments() -> str:
        t, a = r.choice(["section", "div", "ol", "ul"]), TOKENS["comment"]
        inner = "li" if t in ("ol", "ul") else r.choice(["div", "article", "p"])
        return f'<{t}{named(a)} data-y="0"><h3>{words(1, 3)}</h3>' + "".join(
            f"<{inner}{named(a) if r.random() < 0.5 else ''}>{'<b>' + word() + '</b> ' if r.random() < 0.5 else ''}{'<p>' if inner != 'p' else ''}{prose(1, 4)}</{inner}>" for _ in range(r.randint(1, 5))
        ) + f"</{t}>"

    def share() -> str:
        t = r.choice(["div", "ul", "section", "p"])
        return f'<{t}{named(TOKENS["share"])} data-y="0">{links(2, 5) if t == "ul" else words(1, 4) + " ".join(f" <a href=/>{words(1, 6)}</a>" for _ in range(r.randint(1, 5)))}</{t}>'

    before = [boiler(k) for k in (nav, header, ad, notice, form, side, share) if r.random() < 0.4]
    after = [boiler(k) for k in (footer, comments, ad, side, notice, share, form, nav) if r.random() < 0.4]
    r.shuffle(before)
    if r.random() < 0.4:
        r.shuffle(after)
    main = content()
    k = r.random()
    if k < 0.4:
        body = f'<article data-y="1"{named(TOKENS["content"]) if r.random() < 0.3 else ""}>{main}{boiler(comments) if r.random() < 0.1 else ""}</article>'
    elif k < 0.55:
        body = f'<main data-y="1">{main}</main>'
    elif k < 0.85:
        body = f'<{"div" if k < 0.75 else "section"} data-y="1"{named(TOKENS["content"]) if r.random() < 0.8 else ""}>{main}</{"div" if k < 0.75 else "section"}>'
    else:
        body = f'<div data-y="1">{main}</div>'
    if r.random() < 0.3:
        body = f"<div{named('wrapper container layout page wrap site')}>{body}{after.pop() if after else ''}</div>"
    if r.random() < 0.06:
        body = ""
    elif r.random() < 0.12:
        before, after = [], []
        if r.random() < 0.5:
            return body
    return f"<html><head><title>{words(1, 5)}</title><script>var a='<p>';</script></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


_model: list[BoostedTrees] = []


def model(pages: int = PAGES, seed: int = 5) -> BoostedTrees:
    """The trees, trained on invented pages once in a process."""
    if not _model:
        r, xs, ys = random.Random(seed), [], []
        for _ in range(pages):
            page = Page(invented_page(r))
            x, length = page.features()
            own = np.zeros(len(length))
            mark = [0] * len(length)
            for i in range(len(length)):
                mark[i] = int(page.mark[i]) if page.mark[i] is not None else (mark[page.parent[i]] if i else 0)
            for node, text, _ in page.pieces:
                if len(text) > 1 and not text.isspace():
                    own[node] += len(text) * mark[node]
            for i in range(len(length) - 1, 0, -1):
                own[page.parent[i]] += own[i]
            share = own / np.maximum(length, 1)
            pure = (length > 0) & ((share < 0.03) | (share > 0.97))
            xs.append(x[pure])
            ys.append(share[pure] > 0.5)
        _model.append(BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float)))
    return _model[0]


def main_texts(sources: list[str | None], trees: BoostedTrees) -> list[str]:
    """The main text of each page."""
    pages = [Page(s or "") for s in sources]
    found = [p.features() for p in pages]
    if not pages:
        return []
    margin = trees.margin(np.concatenate([x for x, _ in found]))
    out, at = [], 0
    for p, (x, length) in zip(pages, found, strict=True):
        out.append(p.text(p.decode(margin[at : at + len(x)], length)))
        at += len(x)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) to (page_id, url, text, n_chars), one row each."""
    spark = pages.sparkSession
    ship(spark)
    trees = spark.sparkContext.broadcast(model())  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html", 1 << 20):
            texts = main_texts(batch.column("html").to_pylist(), trees.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
