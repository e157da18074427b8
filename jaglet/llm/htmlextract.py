"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

A page is parsed into its block elements; the inline text between them becomes text nodes. Boosted trees, trained in
numpy, tell for every node whether all of its text is main text, none is, or some: from subtree text, link and
tag densities, attribute tokens of the node and its ancestors, depth, place, and how siblings look. Decoding
is exact over the tree: a node is kept whole, dropped whole, or open; below a kept node all is kept, below a
dropped one all is dropped, and only open nodes let their children differ. The most likely such choice is taken.

The tables have no labelled pages, so the trees learn from pages that page_maker() writes: articles in many
layouts, with and without semantic tags, among menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, each node's truth known. Scripts, styles, templates, form controls and the head hold no text.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jaglet.llm.common import extended, place, session_of, table

RESULT = "main_text"
PAGES, ROUNDS, DEPTH, RATE, BINS = 420, 32, 4, 0.25, 32
KEEP, DROP, OPEN = 0, 1, 2

# Elements by kind, and attribute tokens by what they tell.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SILENT = frozenset("head select option optgroup button svg math canvas object audio video datalist".split())
BLOCK = {t: k for k, ts in enumerate(("#text", "html", "body", "article main", "section div center fieldset details summary hgroup address", "nav menu", "header", "footer", "aside", "form", "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl", "table thead tbody tfoot tr caption", "td th", "blockquote", "pre", "figure figcaption", "dialog")) for t in ts.split()}
CLOSES_P = frozenset(BLOCK) - {"#text", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body"} | {"hr"}
#: Starting one of these ends an open one of its set, unless one of the bounds is between.
SIBLINGS = {t: (frozenset(a.split()), frozenset(b.split())) for ts, a, b in (("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td th", "td th", "table tr"), ("thead tbody tfoot", "thead tbody tfoot tr td th caption", "table")) for t in ts.split()}
TOKENS = [frozenset(x.split()) for x in (
    "article content post entry main story text body articlebody prose reading maincontent page blog news",
    "nav navbar menu navigation breadcrumb breadcrumbs crumbs toc pagination pager topnav tabs skip",
    "header masthead banner logo branding sitehead topbar siteheader pagehead",
    "footer foot copyright legal colophon sitefooter bottom contentinfo credits imprint",
    "sidebar side aside widget related recommended rail complementary popular trending more secondary teaser",
    "ad ads advert advertisement adsbox sponsor sponsored promo promotion adslot dfp taboola outbrain affiliate",
    "comment comments reply replies discussion disqus respond commentlist thread reader feedback",
    "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe signup paywall dialog announcement",
    "form login search contact register searchform signin searchbox",
    "share social sharing tweet facebook follow tags tag byline author print tools toolbar",
    "hidden hide sr only none invisible",
)]
TAG = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?/])")
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>")
NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|style|hidden|aria-hidden|data-y)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@functools.lru_cache(maxsize=1 << 14)
def token_bits(attributes: str) -> int:
    """A bit for each set of TOKENS that the attributes have a token of; bit 20 if data-y says 1, 21 if it says 0."""
    bits = 0
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        name = name.lower()
        if name == "data-y":
            bits |= 1 << (20 if value == "1" else 21)
        elif name == "style":
            flat = value.replace(" ", "").lower()
            bits |= (1 << 10) * ("display:none" in flat or "visibility:hidden" in flat)
        elif name in ("hidden", "aria-hidden"):
            bits |= (1 << 10) * (value.lower() != "false")
        else:
            words = set(SPLIT.split(CAMEL.sub(" ", value).lower()))
            for k, known in enumerate(TOKENS):
                bits |= (1 << k) * (not known.isdisjoint(words))
    return bits


class Dom:
    """Block nodes of many pages in page order: parents come before children."""

    def __init__(self):
        self.kind, self.parent, self.depth, self.bits, self.page = [], [], [], [], []
        self.own = []  # (index, text, characters in links, links, inline tags, line breaks)
        self.controls, self.heading = [], []
        self.pages = 0

    def node(self, kind: int, parent: int, bits: int) -> int:
        self.kind.append(kind), self.parent.append(parent), self.bits.append(bits), self.page.append(self.pages)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.controls.append(0)
        return len(self.kind) - 1

    def add(self, source: str) -> None:
        """Parse one page. Any input is a page: stray tags are ignored, open elements end with their parent."""
        root = self.node(BLOCK["html"], -1, 0)
        stack: list[tuple[str, int, bool]] = [("html", root, False)]  # name, block node, silent
        open_count: dict[str, int] = {"html": 1}
        run: list[str] = []
        state = [0, 0, 0]  # characters in links, links, inline tags
        links = 0

        def flush():
            if run:
                text = "".join(run)
                if text and not text.isspace():
                    self.own.append((self.node(0, stack[-1][1], 0), text, *state))
                run.clear()
            state[:] = (0, 0, 0)

        def pop():
            nonlocal links
            name, _, _ = stack[-1]
            if name in BLOCK:
                flush()
            links -= name == "a"
            open_count[name] -= 1
            stack.pop()

        def close(names, bounds=frozenset()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    while len(stack) > k:
                        pop()
                    return
                if stack[k][0] in bounds:
                    return

        at, end = 0, len(source)
        while at < end:
            m = TAG.search(source, at)
            cut = m.start() if m else end
            if cut > at and not stack[-1][2]:
                piece = source[at:cut]
                run.append(piece)
                if links:
                    state[0] += len(piece)
            if not m:
                break
            if m[0] == "<!--":
                stop = source.find("-->", cut + 4)
                at = end if stop < 0 else stop + 3
                continue
            inside = INSIDE.match(source, m.end() if m[0][-1] in "!?/" else m.end() - 1)
            if not inside:  # an unfinished tag: the rest is none
                break
            at = inside.end()
            if m[0][-1] in "!?/":
                continue
            named = NAME.match(source, m.end() - 1)
            name = named[0].lower()
            if m[0][1] == "/":
                if open_count.get(name):
                    block = name in BLOCK
                    # an inline end tag doesn't end blocks
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            while len(stack) > k:
                                pop()
                            break
                        if not block and stack[k][0] in BLOCK:
                            break
                elif name == "p":
                    flush()
                continue
            if name in CLOSES_P and open_count.get("p"):
                close(frozenset(("p",)), frozenset(("table", "td", "th", "button", "object")))
            if name in SIBLINGS:
                close(*SIBLINGS[name])
            if name in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                pop()
            silent = stack[-1][2]
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                if not stop:
                    break
                shut = source.find(">", stop.end())
                at = end if shut < 0 else shut + 1
                continue
            if name in VOID:
                if name in ("br", "hr", "wbr", "img"):
                    run.append(" " if name == "br" else "")
                    if name == "hr":
                        flush()
                elif name == "input":
                    self.controls[stack[-1][1]] += 1
                state[2] += 1
                continue
            attributes = source[named.end() : at - 1]
            if name in BLOCK:
                if name in ("html", "body") and open_count.get(name):
                    continue
                if name == "body" and open_count.get("head"):
                    close(frozenset(("head",)))
                if not silent:
                    flush()
                bits = token_bits(attributes) if attributes else 0
                stack.append((name, stack[-1][1] if silent else self.node(BLOCK[name], stack[-1][1], bits), silent))
            else:
                state[2] += 1
                if name == "a":
                    if links:
                        close(frozenset(("a",)), frozenset(BLOCK))
                    links += 1
                    state[1] += 1
                if name in SILENT:
                    self.controls[stack[-1][1]] += name != "head"
                stack.append((name, stack[-1][1], silent or name in SILENT))
            open_count[name] = open_count.get(name, 0) + 1
            if attributes.endswith("/") and name not in BLOCK:
                pop()
        while len(stack) > 1:
            pop()
        flush()
        self.pages += 1


def _up(values: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Sums over subtrees."""
    out = values.astype(np.float64).copy()
    for idx in levels[:0:-1]:
        np.add.at(out, parent[idx], out[idx])
    return out


class Nodes:
    """A Dom as arrays, with features."""

    def __init__(self, dom: Dom):
        self.kind, self.parent = np.array(dom.kind, np.int64), np.array(dom.parent, np.int64)
        self.depth, self.bits, self.page = np.array(dom.depth, np.int64), np.array(dom.bits, np.int64), np.array(dom.page, np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n = len(self.kind)
        own = np.zeros((9, n))
        for i, text, linked, links, tags in dom.own:
            own[:, i] = (len(text), linked, links, tags, text.count(".") + text.count(",") + text.count("!") + text.count("?"), text.count(" ") + 1, 1, "©" in text or "&copy" in text, len(text) > 80)
        self.own = own
        self.controls = np.array(dom.controls, np.float64)

    def features(self) -> np.ndarray:
        up = lambda v: _up(v, self.parent, self.levels)
        chars, linked, links, tags, stops, words, texts, mark, long_ = (up(v) for v in self.own)
        inputs, size = up(self.controls), up(np.ones(len(self.kind)))
        paragraphs, items = up(self.kind == BLOCK["p"]), up(self.kind == BLOCK["li"])
        parent = np.maximum(self.parent, 0)
        root = np.flatnonzero(self.parent < 0)[self.page]
        near = self.parent[None, :]
        has = near[0] >= 0
        n = len(self.kind)
        kids = np.bincount(parent[has], minlength=n).astype(float)
        brothers = kids[parent]
        first = np.zeros(n)
        order = np.lexsort((np.arange(n), parent))
        sorted_parent = parent[order]
        starts = np.flatnonzero(np.concatenate(([True], sorted_parent[1:] != sorted_parent[:-1])))
        first[order] = np.arange(n) - np.repeat(starts, np.diff(np.concatenate((starts, [n]))))
        before = np.cumsum(self.own[0]) - self.own[0]
        place = (before - before[root]) / np.maximum(chars[root], 1)
        ratio = lambda a, b: a / np.maximum(b, 1)
        alike = np.bincount(parent[has] * 32 + self.kind[has], minlength=32 * n)[parent * 32 + self.kind]
        inherited, above_kind = self.bits & ((1 << 20) - 1), np.zeros(n, np.int64)
        for idx in self.levels[1:]:
            inherited[idx] |= inherited[self.parent[idx]]
            above_kind[idx] = above_kind[self.parent[idx]] | (1 << self.kind[self.parent[idx]])
        bit = lambda b, k: ((b >> k) & 1).astype(float)
        density = ratio(linked, chars)
        columns = [
            self.kind, np.log1p(chars), density, np.log1p(links), ratio(tags * 100, chars), ratio(stops * 100, chars), np.log1p(words), ratio(words, texts),
            mark, ratio(long_, texts), np.log1p(inputs), np.log1p(size), np.log1p(paragraphs), np.log1p(items), self.depth, np.log1p(brothers), first / np.maximum(brothers, 1), alike,
            place, ratio(chars, chars[root]), ratio(chars, chars[parent]), np.log1p(chars[parent]), density[parent], self.kind[parent], ratio(long_[parent], texts[parent]),
            ratio(chars[parent] - chars, brothers - 1), np.log1p(chars[root]), ratio(size * 100, chars),
            *[bit(self.bits, k) for k in range(len(TOKENS))], *[bit(inherited, k) for k in range(len(TOKENS))],
            *[bit(above_kind, BLOCK[t]) for t in ("article", "nav", "header", "footer", "aside", "form", "li", "figure", "dialog")],
        ]
        return np.stack([np.asarray(c, np.float32) for c in columns], 1)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The most likely choice (KEEP, DROP or OPEN) of every node that agrees along every path."""
        p = scores - scores.max(1, keepdims=True)
        p = p - np.log(np.exp(p).sum(1, keepdims=True))
        p[self.kind == 0, OPEN] = -1e9
        best = p.copy()
        for idx in self.levels[:0:-1]:
            up = self.parent[idx]
            np.add.at(best[:, KEEP], up, best[idx, KEEP])
            np.add.at(best[:, DROP], up, best[idx, DROP])
            np.add.at(best[:, OPEN], up, best[idx].max(1))
        out = best.argmax(1)
        for idx in self.levels[1:]:
            above = out[self.parent[idx]]
            out[idx] = np.where(above == OPEN, out[idx], above)
        return out


class Boost:
    """Gradient-boosted trees of fixed depth for three classes."""

    def __init__(self):
        self.feature, self.cut, self.value = [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boost:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(m) * BINS
        score = np.zeros((n, 3))
        for _ in range(ROUNDS):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for c in range(3):
                g, h = weight * (p[:, c] - (y == c)), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-4)
                at = np.zeros(n, np.int64)
                feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
                for level in range(DEPTH):
                    lead = 2**level - 1
                    index = ((at - lead)[:, None] * (m * BINS) + flat).ravel()
                    gs = np.bincount(index, np.repeat(g, m), 2**level * m * BINS).reshape(-1, m, BINS).cumsum(2)
                    hs = np.bincount(index, np.repeat(h, m), 2**level * m * BINS).reshape(-1, m, BINS).cumsum(2)
                    gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    for k in range(2**level):
                        j, b = divmod(int(gain[k].argmax()), BINS)
                        if gain[k, j, b] > 1e-3 and b < len(edges[j]):
                            feature[lead + k], cut[lead + k] = j, edges[j][b]
                    at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
                leaf = at - (2**DEPTH - 1)
                value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
                score[:, c] += value[leaf]
                self.feature.append(feature), self.cut.append(cut), self.value.append(value)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros((len(x), 3)), np.arange(len(x))
        for t, (feature, cut, value) in enumerate(zip(self.feature, self.cut, self.value, strict=True)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out[:, t % 3] += value[at - (2**DEPTH - 1)]
        return out


def page_maker(rng: np.random.Generator) -> str:
    """A page whose elements say with data-y whether their text is main text."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    odd = pick("", "", "", "%%%", "!!", "|")  # some corpora decorate every word

    def words(n: int) -> str:
        out = []
        for k in range(max(1, n)):
            w = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 10))))
            w = w.capitalize() if not k or chance(0.1) else w
            out.append(w + pick("", "", "", "", "", "", ",", ".") + odd)
        return " ".join(out).rstrip(",") + pick(".", ".", "")

    some = lambda a, b: words(int(rng.integers(a, b)))
    link = lambda a=1, b=4: f'<a href="/{int(rng.integers(999))}">{some(a, b)}</a>'
    name = lambda *tokens: pick(f' class="{pick(*tokens)}"', f' id="{pick(*tokens)}"', f' class="{pick(*tokens)} {pick("wide", "row", "c1", "box", "inner")}"', "")
    sure = lambda *tokens: f' class="{pick("", "site-", "page-", "x-", "the")}{pick(*tokens)}"'

    def menu():
        rows = "".join(f"<li>{link()}" + pick("</li>", "</li>", "") for _ in range(int(rng.integers(3, 12))))
        inner = pick(f"<ul>{rows}</ul>", " | ".join(link() for _ in range(int(rng.integers(3, 9)))))
        return pick(f"<nav>{inner}</nav>", f"<nav{name('nav', 'menu')}>{inner}</nav>", f"<div{sure('nav', 'menu', 'breadcrumb', 'navigation')}>{inner}</div>", f"<ul{sure('menu', 'nav', 'toc')}>{rows}</ul>")

    def advert():
        inner = pick(some(4, 25), f"<p>{some(4, 30)}</p>", link(2, 8), f"{some(3, 12)} {link()}")
        return pick(f'<div class="{pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo")}">{inner}</div>', f"<aside{sure('ad', 'sponsor')}>{inner}</aside>", f'<div id="{pick("ad-1", "advert", "banner-ad")}">{inner}</div>')

    def notice():
        inner = f"<p>{some(8, 40)}</p>" + pick("", f"<button>{some(1, 3)}</button>", link())
        return pick(f"<div{sure('cookie', 'consent', 'notice', 'newsletter', 'popup', 'alert')}>{inner}</div>", f'<div role="{pick("dialog", "alert")}">{inner}</div>', f"<dialog open>{inner}</dialog>", f"<section{sure('subscribe', 'newsletter', 'cookie')}>{inner}</section>")

    def head():
        inner = pick(f"<h1>{some(1, 4)}</h1>", f"<div{name('logo', 'branding')}>{link()}</div>", f"<p>{some(2, 8)}</p>") + pick("", menu())
        return pick(f"<header>{inner}</header>", f"<div{sure('header', 'masthead', 'topbar')}>{inner}</div>", f"<header{name('header', 'top')}>{inner}</header>")

    def foot():
        inner = pick("&copy; ", "© 2020 ", "") + some(2, 14) + pick("", " " + link(), "<p>" + " ".join(link() for _ in range(4)) + "</p>", f"<p>{some(6, 30)}</p>")
        return pick(f"<footer>{inner}</footer>", f"<div{sure('footer', 'copyright', 'legal')}>{inner}</div>", f"<footer{name('footer', 'foot')}>{inner}</footer>")

    def side():
        inner = "".join(pick(f"<h3>{some(1, 4)}</h3>", "<ul>" + "".join(f"<li>{link(2, 8)}</li>" for _ in range(int(rng.integers(2, 8)))) + "</ul>", f"<p>{some(5, 30)}</p>", advert()) for _ in range(int(rng.integers(1, 5))))
        return pick(f"<aside>{inner}</aside>", f"<div{sure('sidebar', 'related', 'widget', 'recommended')}>{inner}</div>", f"<section{sure('related', 'trending')}>{inner}</section>")

    def form():
        inner = f"<label>{some(1, 4)}</label><input name=a><textarea>{some(1, 5)}</textarea>" + pick("", f"<p>{some(3, 14)}</p>") + f"<button>{some(1, 3)}</button>"
        return pick(f"<form action=/>{inner}</form>", f"<div{sure('login', 'search', 'contact')}><form>{inner}</form></div>")

    def comments():
        one = lambda: pick(f"<p>{some(5, 60)}</p>", f"<b>{some(1, 3)}</b><p>{some(5, 60)}</p><p>{some(5, 40)}</p>")
        rows = "".join(pick(f"<li>{one()}</li>", f"<div{sure('comment', 'reply')}>{one()}</div>", f"<article{sure('comment')}>{one()}</article>") for _ in range(int(rng.integers(1, 7))))
        return pick(f"<section{sure('comments', 'discussion', 'replies')}><h2>{some(1, 3)}</h2>{rows}</section>", f"<div{sure('comments', 'respond')}>{rows}</div>", f'<ol id="comments">{rows}</ol>')

    def share():
        return f"<div{sure('share', 'social', 'tags')}>" + " ".join(link(1, 3) for _ in range(int(rng.integers(2, 6)))) + "</div>"

    def paragraph():
        text = some(3, 90) if chance(0.85) else some(1, 6)
        text = pick(text, text, text, f"{text} {link(1, 5)} {some(2, 30)}", f"<b>{some(3, 20)}<br>", f"<em>{some(1, 5)}</em> {text}", f"{text} &amp; {some(1, 9)}")
        end = "" if text.startswith("<b>") or chance(0.15) else "</p>"
        return f"<p>{text}{end}"

    def body_part():
        r = rng.random()
        if r < 0.74:
            return paragraph()
        if r < 0.80:
            return f"<h{int(rng.integers(2, 5))}>{some(1, 8)}</h{2}>".replace("</h2>", "</h2>") if chance(0.5) else f"<h3>{some(1, 8)}</h3>"
        if r < 0.86:
            tag = pick("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{pick(some(2, 25), some(2, 25), link(2, 6) + ' ' + some(4, 15))}</li>" for _ in range(int(rng.integers(2, 8)))) + f"</{tag}>"
        if r < 0.90:
            return f"<blockquote>{pick(some(5, 50), f'<p>{some(5, 50)}</p>')}</blockquote>"
        if r < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{some(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(int(rng.integers(2, 6)))) + "</table>"
        if r < 0.96:
            return f"<pre>{some(4, 30)}</pre>"
        return f"<figure><img src=x><figcaption>{some(3, 15)}</figcaption></figure>"

    size = pick(1, 2, 3, 4, 6, 8, 12, 20, 35)
    title = pick(f"<h1>{some(1, 12)}</h1>", f"<h1>{some(1, 12)}</h1>", f"<h2>{some(1, 12)}</h2>", "")
    parts = [title, *(body_part() for _ in range(size))]
    for _ in range(pick(0, 0, 0, 1, 2)):
        parts.insert(int(rng.integers(1, len(parts) + 1)), pick(advert, share, side, notice, form)().replace(">", ' data-y="0">', 1))
    if chance(0.15):
        parts.append(comments().replace(">", ' data-y="0">', 1))
    text = "".join(parts)
    if chance(0.2):
        text = f"<div{name('inner', 'wrap')}>{text}</div>"
    main = pick("<article data-y=1>{}</article>", "<article data-y=1>{}</article>", "<main data-y=1>{}</main>", "<main><article data-y=1>{}</article></main>", '<div class="%s" data-y=1>{}</div>' % pick("content", "post", "entry-content", "article-body", "story", "main"), '<div id="%s" data-y=1>{}</div>' % pick("content", "main", "article", "text"), '<section data-y=1 class="%s">{}</section>' % pick("content", "post", "c2"), "<div data-y=1>{}</div>", "<div class=row><div data-y=1 class=col>{}</div></div>")
    if chance(0.06):
        main = "<div data-y=1>{}</div>"
        before, after = [], []
    else:
        before = [f() for f in (head, menu, notice, advert, form, menu) if chance(0.35)]
        after = [f() for f in (side, comments, form, advert, notice, share, foot, foot) if chance(0.35)]
    if chance(0.3):
        before = [f"<div{name('top', 'wrap')}>" + "".join(before) + "</div>"]
    noise = f"<script>var t='</p>'</script><style>p{{}}</style><!-- {some(1, 3)} -->"
    page = "".join(before) + (noise if chance(0.5) else "") + main.replace("{}", text) + "".join(after)
    if chance(0.2):
        page = f"<div{name('page', 'wrapper', 'container')}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{some(1, 5)}</title></head><body>{page}" + pick("</body></html>", "")


@functools.lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = 29) -> Boost:
    """The trees, learnt from `pages` pages that page_maker writes."""
    rng = np.random.default_rng(seed)
    dom = Dom()
    for _ in range(pages):
        dom.add(page_maker(rng))
    nodes = Nodes(dom)
    return Boost().fit(nodes.features(), *truth(nodes))


def truth(nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """(class, weight) of each node of pages with data-y."""
    main = np.where((nodes.bits >> 20) & 1, 1, np.where((nodes.bits >> 21) & 1, 0, -1))
    for k, idx in enumerate(nodes.levels):
        main[idx] = np.where(main[idx] >= 0, main[idx], main[nodes.parent[idx]] if k else 0)
    chars = _up(nodes.own[0], nodes.parent, nodes.levels)
    good = _up(nodes.own[0] * main, nodes.parent, nodes.levels)
    return np.where(good <= 0, DROP, np.where(good >= chars, KEEP, OPEN)), np.where(chars > 0, 1.0, 0.05)


def main_texts(pages: list[str | None], model: Boost) -> list[str]:
    """The main text of each page: its kept blocks, white space within as one blank, apart by an empty line."""
    dom = Dom()
    for p in pages:
        dom.add(p or "")
    nodes = Nodes(dom)
    kept = nodes.decode(model.scores(nodes.features())) == KEEP
    out: list[list[str]] = [[] for _ in pages]
    for i, text, *_ in dom.own:
        if kept[i]:
            block = " ".join((html.unescape(text) if "&" in text else text).split())
            if block:
                out[dom.page[i]].append(block)
    return ["\n\n".join(x) for x in out]


def extract(pages: DataFrame, html_col: str = "html", keep: Iterable[str] | None = None, model: Boost | None = None) -> DataFrame:
    """pages (or its columns `keep`) with main_text; no shuffle.

    A null or empty page, and one without main text, has an empty text. Pages are whole, however long; rows are
    judged one by one; a column named main_text is replaced. An empty table gives an empty table.
    """
    spark = session_of(pages)
    shared = spark.sparkContext.broadcast(model or trained())

    def kernel(b: pa.RecordBatch):
        for i in range(0, b.num_rows, 200):
            texts = main_texts(b.column(0).slice(i, 200).to_pylist(), shared.value)
            yield i, i + len(texts), [pa.array(texts, pa.string())]

    return extended(pages, kernel, [T.StructField(RESULT, T.StringType())], [F.col(f"c{place(pages, html_col)}")], keep)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col(RESULT).alias("text"), F.char_length(RESULT).cast("long").alias("n_chars"))
