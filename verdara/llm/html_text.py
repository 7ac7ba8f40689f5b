"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every text block (inline content between block boundaries) is a node that
is either content or not.  A node's own score comes from its tag, class words, role, length and
link share; parent and child share a potential of their kind of edge.  Sum-product messages go
upward from the leaves and downward from the root, which gives exact marginals on a tree; text
blocks with a content marginal above one half are kept, in page order.  All trees of a batch are
passed level by level.

Potentials are fitted on the driver on labelled pages that a seeded generator writes
(TRAINING_PAGES of them, with menus, headers, adverts, notices, sidebars, forms, comments and
footers in several notations) by gradient ascent on the exact likelihood.

Text: character references are decoded, white space inside a block becomes one blank, ends are
trimmed, blocks are joined by one line end.  ``br`` is white space.

Defined results: NULL or empty html, or no content: empty text.  Broken markup is read as browsers
do where it matters: open paragraphs end at block tags, unknown end tags are dropped, a comment or
script without an end reaches to the end of the page.  Repeated rows stay repeated.  Empty table:
no rows.  Input columns named like an added column are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verdara.llm.common import ship, with_fields

TRAINING_PAGES = 240
BATCH_NODES = 60_000

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?",
                        re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in (
    "script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "template",
    "svg", "math", "noscript", "select", "object", "canvas")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("""address article aside blockquote body dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre
section summary table td th tr ul caption button label""".split())
_ENDS_P = _BLOCK - {"body", "button", "caption", "head", "html", "label", "legend", "td", "th",
                    "tr"}
#: A start tag ends an open element of these kinds, unless one of the walls stands between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}),
         "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
         "tfoot": ({"thead", "tbody", "tfoot"}, {"table"})}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Words in class, id and role, by what they stand for.
_HINTS = {
    "good": "article content main post entry body story text blog page prose markdown",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager tabs toolbar",
    "head": "header masthead banner topbar logo branding site",
    "foot": "footer copyright legal contentinfo colophon bottom imprint",
    "side": "sidebar side aside widget related recommended trending popular more rail complementary",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted teaser outbrain",
    "note": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe paywall",
    "talk": "comment comments disqus reply replies discussion respond reviews",
    "form": "form login search signup signin register input contact",
    "share": "share social follow tags tag meta byline author print",
    "off": "hidden none visually sr"}
_HINT = {w: k for k, ws in _HINTS.items() for w in ws.split()}
_TAGS = """html body div article section main p h1 h2 h3 h4 h5 h6 ul ol li table tr td th header footer nav
aside form blockquote pre figure figcaption dl dt dd hr fieldset address button label details
summary""".split()
_LENGTHS = [0, 15, 40, 80, 160, 320, 1 << 60]
_EDGES = ["text", "list", "heading", "section", "other"]
FEATURES = (["element", "block", "inner"] + [f"tag_{t}" for t in [*_TAGS, "other"]]
            + [f"inner_{t}" for t in ("header", "footer", "aside", "nav", "h1", "form")]
            + [f"hint_{h}" for h in _HINTS] + [f"in_{t}" for t in [*_TAGS, "other"]]
            + [f"length_{i}" for i in range(6)] + [f"links_{i}" for i in range(4)]
            + ["ends", "copyright", "short_link"])
_AT = {f: i for i, f in enumerate(FEATURES)}


class Page:
    """Tree of block elements and text blocks of one page."""

    __slots__ = ("parent", "features", "kind", "texts")

    def __init__(self, html: str):
        self.parent: list[int] = []
        self.features: list[list[int]] = []
        self.kind: list[int] = []
        self.texts: list[tuple[int, str]] = []  # (node, text)
        self._read(html)

    def _node(self, parent: int, kind: int, features: list[int]) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.features.append(features)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        root = self._node(-1, 4, [_AT["element"], _AT["tag_html"]])
        # open elements: (tag, node of the nearest block); counts per tag save searching
        stack: list[tuple[str, int]] = [("#", root)]
        count: dict[str, int] = {}
        inner = 0  # open article and main elements
        parts: list[str] = []
        linked = link = 0
        at, end = 0, len(html)

        def close() -> None:
            """End the text block that is open."""
            nonlocal parts, linked
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self._text(stack[-1], text, linked, inner)
                parts, linked = [], 0

        def pop() -> None:
            nonlocal inner, link
            tag = stack.pop()[0]
            count[tag] -= 1
            inner -= tag in ("article", "main")
            link -= tag == "a"

        def pop_to(tags: set[str], walls: set[str]) -> None:
            for i in range(len(stack) - 1, 0, -1):
                tag = stack[i][0]
                if tag in tags:
                    close()
                    while len(stack) > i:
                        pop()
                    return
                if tag in walls:
                    return

        while at < end:
            m = _MARKUP.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                piece = html[at:stop]
                parts.append(piece)
                if link:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    parts.append(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if m[1]:
                if count.get(tag, 0):
                    if tag in _BLOCK:
                        close()
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if tag in _RAW:
                if not m[3].endswith("/"):
                    closing = _RAW[tag].search(html, at)
                    at = closing.end() if closing else end
                continue
            if tag in _VOID:
                if tag == "hr":
                    close()
                else:
                    parts.append(" ")
                continue
            if tag in _ENDS_P and count.get("p", 0):
                pop_to({"p"}, {"button", "table", "td", "th", "caption"})
            if tag in _ENDS and any(count.get(t, 0) for t in _ENDS[tag][0]):
                pop_to(*_ENDS[tag])
            node = stack[-1][1]
            if tag in _BLOCK:
                close()
                inner += tag in ("article", "main")
                node = self._element(tag, m[3], node, inner)
            link += tag == "a"
            stack.append((tag, node))
            count[tag] = count.get(tag, 0) + 1
        close()

    def _element(self, tag: str, attributes: str, parent: int, inner: int) -> int:
        known = tag if f"tag_{tag}" in _AT else "other"
        found = [_AT["element"], _AT[f"tag_{known}"]]
        if inner:
            found.append(_AT["inner"])
            if f"inner_{tag}" in _AT:
                found.append(_AT[f"inner_{tag}"])
        if attributes:
            found += [_AT[f"hint_{h}"] for h in _hints(attributes)]
        kind = (1 if tag in ("li", "dt", "dd", "td", "th", "tr") else 2 if tag[0] == "h" and tag[1:].isdigit()
                else 3 if tag in ("div", "section", "article", "main", "aside", "nav", "header",
                                  "footer", "form") else 4)
        return self._node(parent, kind, found)

    def _text(self, top: tuple[str, int], text: str, linked: int, inner: int) -> None:
        tag = next((FEATURES[f][4:] for f in self.features[top[1]] if FEATURES[f][:4] == "tag_"), "other")
        n = len(text)
        share = min(1.0, linked / n)
        found = [_AT["block"], _AT[f"in_{tag}"],
                 _AT[f"length_{next(i for i in range(6) if n <= _LENGTHS[i + 1])}"],
                 _AT[f"links_{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]]
        if inner:
            found.append(_AT["inner"])
        if text[-1] in ".!?…:;\"»”":
            found.append(_AT["ends"])
        if "©" in text or "rights reserved" in text.lower():
            found.append(_AT["copyright"])
        if share > 0.8 and n < 40:
            found.append(_AT["short_link"])
        self.texts.append((self._node(top[1], 0, found), text))


@lru_cache(maxsize=20_000)
def _hints(attributes: str) -> tuple[str, ...]:
    found = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            if value.strip("\"'").lower() != "false":
                found.add("off")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                found.add("off")
        else:
            found |= {_HINT.get(w.lower()) for w in _WORD.findall(value)} - {None}
    return tuple(sorted(found))


class Forest:
    """Trees of many pages side by side."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        base = np.cumsum(sizes) - sizes
        self.parent = np.concatenate([np.array(p.parent) + b * (np.array(p.parent) >= 0)
                                      for p, b in zip(pages, base)])
        self.kind = np.concatenate([p.kind for p in pages])
        self.base = base
        count = np.array([len(f) for p in pages for f in p.features])
        self.flat = np.array([i for p in pages for f in p.features for i in f])
        self.starts = np.cumsum(count) - count
        self.owner = np.repeat(np.arange(len(count)), count)
        depth = [0] * len(self.parent)  # parents come before their children
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        depth = np.array(depth)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])


class TreeModel:
    """unary: features × 2; pair: kind of edge × parent label × child label."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(label) of nodes; P(parent label, label) of nodes with a parent (zero else)."""
        score = np.add.reduceat(self.unary[forest.flat], forest.starts, axis=0)
        below = score.copy()
        up = np.zeros_like(score)
        for level in forest.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(below[level][:, None, :] + self.pair[forest.kind[level]],
                                            axis=2)
            np.add.at(below, forest.parent[level], up[level])
        total = below.copy()
        joint = np.zeros((len(score), 2, 2))
        for level in forest.levels[1:]:
            above = total[forest.parent[level]] - up[level]
            both = (above[:, :, None] + self.pair[forest.kind[level]] + below[level][:, None, :])
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
            total[level] = below[level] + np.logaddexp.reduce(
                above[:, :, None] + self.pair[forest.kind[level]], axis=1)
            total[level] -= total[level].max(axis=1, keepdims=True)
        total = np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])
        return total, joint


def fit(pages: list[tuple[str, list[str]]], rounds: int = 250, rate: float = 0.05,
        decay: float = 1e-5) -> TreeModel:
    """Potentials from pages and their content blocks."""
    trees = [Page(h) for h, _ in pages]
    forest = Forest(trees)
    good = np.zeros((len(forest.parent), 2))
    for tree, base, (_, wanted) in zip(trees, forest.base, pages):
        left = list(wanted)
        for node, text in tree.texts:
            hit = text in left
            if hit:
                left.remove(text)
            good[base + node, int(hit)] = len(text)
    for level in forest.levels[:0:-1]:  # an element is content if most of its text is
        np.add.at(good, forest.parent[level], good[level])
    gold = (good[:, 1] > good[:, 0]).astype(int)
    n, hot = len(gold), np.eye(2)[gold]
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(_EDGES), 2, 2))
    np.add.at(seen, (forest.kind[child], gold[forest.parent[child]], gold[child]), 1)
    model = TreeModel(np.zeros((len(FEATURES), 2)), np.zeros_like(seen))
    weights = [model.unary, model.pair]
    mean, square = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for k in range(1, rounds + 1):
        node, joint = model.marginals(forest)
        step = np.zeros_like(model.unary)
        np.add.at(step, forest.flat, (hot - node)[forest.owner])
        expected = np.zeros_like(seen)
        np.add.at(expected, forest.kind[child], joint[child])
        for w, g, m, v in zip(weights, (step, seen - expected), mean, square):
            g = g / n - decay * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return model


def main_texts(pages: list[str | None], model: TreeModel) -> list[str]:
    """Main text of each page."""
    out: list[str] = [""] * len(pages)
    trees: list[tuple[int, Page]] = []
    size = 0
    for i, html in enumerate(pages):
        tree = Page(html or "")
        if tree.texts:
            trees.append((i, tree))
            size += len(tree.parent)
        if trees and (size >= BATCH_NODES or i == len(pages) - 1):
            forest = Forest([t for _, t in trees])
            content = model.marginals(forest)[0][:, 1] > 0.5
            for (k, t), base in zip(trees, forest.base):
                out[k] = "\n".join([text for node, text in t.texts if content[base + node]])
            trees, size = [], 0
    return out


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages and their content blocks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(1, 9)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high))).capitalize()

    sentence = lambda low=4, high=30: words(low, high) + r.choice(["", ".", ".", ".", "!"])
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def box(tags: list[str], names: list[str], body: str) -> str:
        tag, name = r.choice(tags), r.choice(names)
        attribute = r.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}-{word()}"'])
        return f"<{tag}{attribute if tag in ('div', 'section', 'ul') or r.random() < .5 else ''}>{body}</{tag}>"

    menu = lambda: box(["nav", "nav", "div"], ["nav", "menu", "breadcrumb", "navbar"],
                       "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>")
    head = lambda: box(["header", "div"], ["header", "masthead", "site-header"],
                       f"{r.choice(['<h1>', '<div>', '<p>'])}{words(1, 4)}" + r.choice([link(), ""]))
    ad = lambda: box(["div", "div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo"],
                     r.choice([sentence(), f"<p>{sentence()}</p>", link() + " " + sentence(2, 8)]))
    note = lambda: box(["div", "section"], ["cookie-notice", "consent", "newsletter", "popup", "alert", "notice"],
                       f"<p>{sentence()}</p>" + r.choice(["", "<button>ok</button>", link()]))
    side = lambda: box(["aside", "aside", "div"], ["sidebar", "widget", "related", "side"],
                       f"<h3>{words(1, 4)}</h3>" + r.choice([
                           "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(4)) + "</ul>",
                           f"<p>{sentence()}</p>", sentence()]))
    form = lambda: box(["form", "form", "div"], ["form", "login", "search", "signup"],
                       f"<label>{words(1, 3)}</label><input><p>{sentence(2, 8)}</p><button>{word()}</button>")
    talk = lambda: box(["section", "div", "ul"], ["comments", "comment-list", "disqus", "replies"],
                       f"<h3>{words(1, 2)}</h3>" + "".join(
                           r.choice([f"<div class=\"comment\"><p>{sentence()}</p></div>",
                                     f"<p>{sentence()}</p>", f"<li>{sentence()}</li>",
                                     f"<article class=\"comment\"><p>{sentence()}</p></article>"])
                           for _ in range(r.randint(1, 4))))
    foot = lambda: box(["footer", "footer", "div"], ["footer", "site-footer", "copyright"],
                       r.choice(["&copy; ", ""]) + sentence() + r.choice(["", link(), f"<p>{sentence()}</p>"]))

    def article() -> tuple[str, list[str]]:
        wanted: list[str] = []

        def own(text: str) -> str:
            wanted.append(text)
            return text

        body = []
        if r.random() < 0.85:
            title = f"<h1>{own(words(2, 10) + r.choice(['', '.']))}</h1>"
            body.append(f"<header>{title}</header>" if r.random() < 0.2 else title)
        for _ in range(r.choice([0, 1, 2, 4, 8, 16, 30])):
            draw = r.random()
            text = sentence(1, r.choice([12, 60, 250])) if draw < 0.7 else sentence(1, 12)
            if draw < 0.55:
                body.append(f"<p>{own(text)}</p>")
            elif draw < 0.68:
                body.append(f"<p><b>{own(text)}<br>")
            elif draw < 0.76:
                body.append(f"<h{(k := r.randint(2, 4))}>{own(words(1, 7))}</h{k}>")
            elif draw < 0.84:
                body.append("<ul>" + "".join(f"<li>{own(sentence(1, 14))}</li>" for _ in range(3)) + "</ul>")
            elif draw < 0.88:
                body.append(f"<blockquote>{own(text)}</blockquote>")
            elif draw < 0.91:
                body.append(f"<div>{own(text)}</div>")
            elif draw < 0.93:
                body.append("<table><tr>" + "".join(f"<td>{own(words(1, 4))}</td>" for _ in range(3)) + "</tr></table>")
            elif draw < 0.97:
                body.append(r.choice([ad, note, side, form])())
            else:
                body.append(f"<pre>{own(text)}</pre>")
        if r.random() < 0.2:
            body.append(box(["div", "footer"], ["share", "social", "tags", "meta"], link() + " " + link()))
        tag = r.choice(["article"] * 4 + ["main", "div", "div", "section", "", ""])
        name = r.choice(["content", "post", "article-body", "entry-content", "main", "story"])
        mark = f' class="{name}"' if tag in ("div", "section") or r.random() < 0.3 else ""
        inside = "".join(body)
        return (f"<{tag}{mark}>{inside}</{tag}>" if tag else inside), wanted

    out = []
    for _ in range(count):
        before = [f() for f in (menu, head, ad, note, form) if r.random() < 0.5]
        after = [f() for f in (side, talk, ad, note, form) if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        body, wanted = article()
        if r.random() < 0.2:
            body = f"<main>{body}</main>" if r.random() < 0.5 else f'<div id="{r.choice(["page", "wrapper", "main"])}">{body}</div>'
        if r.random() < 0.3:
            body = f'<div class="{word()}">{"".join(before)}{body}{"".join(after)}</div>'
            before = after = []
        out.append((f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{body}"
                    f"{''.join(after)}{foot() if r.random() < 0.85 else ''}"
                    + r.choice(["</body></html>", ""]), wanted))
    return out


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    return fit(labelled_pages())


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add text and n_chars."""
    ship(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(trained())

    @pandas_udf("text string, n_chars long")
    def fn(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = main_texts(part.tolist(), model.value)
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return with_fields(pages, fn(F.col(f"`{html}`")), ["text", "n_chars"])
