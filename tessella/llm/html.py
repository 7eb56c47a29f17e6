"""Main text of web pages: boosted trees over DOM nodes and a hierarchical decoding.

A page becomes a tree of elements. Each element has features of its subtree (text and link density, tags),
its attributes' tokens, its depth and its siblings. The trees estimate whether an element holds main text.
Decoding picks the set of elements with the largest total log-odds such that a kept element's ancestors are
all kept: an element is never kept inside a dropped one, and no two choices contradict each other.

The trees are trained here, on generated pages with known main text (many layouts, names and kinds of boilerplate, with
names that mislead); no page of the input is used. What an attribute's token tells is learned too: tokens are hashed to
slots, and a slot's log-odds come from pages of their own, apart from those of the trees.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import boosting
from tessella.llm.common import id_text

# Element groups. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
NO_TEXT = frozenset("script style textarea title noscript iframe template xmp noembed noframes head select option button svg canvas audio video object".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption hr".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dd dt td figcaption".split())
TAG_GROUPS = (
    frozenset({"article", "main"}), frozenset({"section"}), frozenset({"div"}), frozenset({"p", "blockquote", "pre"}), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("ul ol dl menu".split()), frozenset("li dd dt".split()),
    frozenset("table tbody thead tfoot tr td th".split()), frozenset({"nav"}), frozenset({"header"}), frozenset({"footer"}), frozenset({"aside"}), frozenset("form fieldset label input button select".split()), frozenset({"a"}),
    frozenset("b i em strong span u code small sub sup mark q cite abbr time".split()), frozenset({"figure", "figcaption"}), frozenset({"html", "body"}), frozenset({"dialog", "details"}),
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)>?", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Slots of hashed attribute tokens.
SLOTS = 1 << 12
NAMES = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    names: tuple[str, ...] = ()
    hidden: bool = False
    parts: list = field(default_factory=list)  # own texts and child positions, in page order


def parse(page: str) -> list[Node]:
    """Elements in page order; position 0 is the page. Unclosed and stray tags are repaired."""
    nodes = [Node("#page", -1, 0)]
    stack = [0]
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            nodes[stack[-1]].parts.append(page[at:])
            break
        if m.start() > at:
            nodes[stack[-1]].parts.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for i in range(len(stack) - 1, 0, -1):
                t = nodes[stack[i]].tag
                if t == tag:
                    del stack[i:]
                    break
                if t in ("table", "article", "body") and tag not in ("table", "article", "body", "html", "main", "div", "section"):
                    break
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        _imply(nodes, stack, tag)
        names, hidden = _attributes(m[3]) if m[3] and m[3].strip() else ((), False)
        nodes.append(Node(tag, stack[-1], len(stack), names, hidden))
        nodes[stack[-1]].parts.append(len(nodes) - 1)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        stack.append(len(nodes) - 1)
    return nodes


def _imply(nodes: list[Node], stack: list[int], tag: str) -> None:
    """Close elements that ``tag`` ends without an end tag."""
    if tag in CLOSES_P:
        closed, bar = {"p"}, {"button", "td", "th", "table", "li", "body", "div", "article", "section", "blockquote"}
        if tag == "li":
            closed, bar = {"li"}, {"ul", "ol", "menu"}
        elif tag in ("dd", "dt"):
            closed, bar = {"dd", "dt"}, {"dl"}
    elif tag in ("td", "th"):
        closed, bar = {"td", "th"}, {"tr", "table"}
    elif tag == "tr":
        closed, bar = {"tr"}, {"table", "tbody", "thead", "tfoot"}
    elif tag == "option":
        closed, bar = {"option"}, {"select"}
    else:
        return
    for i in range(len(stack) - 1, 0, -1):
        t = nodes[stack[i]].tag
        if t in closed:
            del stack[i:]
            return
        if t in bar:
            return


def _attributes(text: str) -> tuple[tuple[str, ...], bool]:
    names: list[str] = []
    hidden = False
    for m in ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role", "itemprop", "aria-label"):
            names += NAMES.findall(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return tuple(names), hidden


def slot(name: str) -> int:
    """Where the log-odds of an attribute token stand."""
    return zlib.crc32(name.encode()) % SLOTS


SIDE = frozenset("nav aside footer header form dialog".split())


def features(nodes: list[Node], odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows, and the length of each element's own text; ``odds``: log-odds of each slot of attribute tokens."""
    n = len(nodes)
    own, link, marks, prose, count, side = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    told, most, least = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        silent = x.tag in NO_TEXT
        for p in x.parts:
            if isinstance(p, str) and not silent:
                own[i] += len(p.strip())
                marks[i] += p.count(".") + p.count(",")
        if x.names:
            o = odds[[slot(w) for w in x.names]]
            told[i], most[i], least[i] = o.sum(), max(o.max(), 0), min(o.min(), 0)
    text = own.copy()
    total_marks, kids, paragraphs = marks.copy(), np.zeros(n), np.zeros(n)
    longest = own.copy()
    for i in range(n - 1, 0, -1):
        x, p = nodes[i], nodes[i].parent
        if x.tag == "a":
            link[i] = text[i]
        if x.tag in PROSE:
            prose[i] = text[i]
        if told[i] < -1 or x.tag in SIDE:
            side[i] = text[i]
        count[i] += 1
        kids[p] += 1
        paragraphs[p] += x.tag in PROSE
        text[p] += text[i]
        link[p] += link[i]
        prose[p] += prose[i]
        side[p] += min(side[i], text[i])
        total_marks[p] += total_marks[i]
        count[p] += count[i]
        longest[p] = max(longest[p], longest[i])
    whole = max(text[0], 1.0)
    above_told, above_main, above_side, share = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    place, same = np.zeros(n), np.zeros(n)
    for i in range(n):
        x = nodes[i]
        share[i] = text[i] / whole
        if x.parent >= 0:
            p = x.parent
            # A wrapper of nearly the whole page says little about its content.
            inner = share[p] < 0.9
            above_told[i] = above_told[p] + told[p] * inner
            above_main[i] = above_main[p] + (nodes[p].tag in ("article", "main"))
            above_side[i] = above_side[p] + (nodes[p].tag in SIDE or nodes[p].hidden) * inner
        children = [c for c in x.parts if not isinstance(c, str)]
        tags = Counter(nodes[c].tag for c in children)
        for k, c in enumerate(children):
            place[c] = k / max(1, len(children) - 1)
            same[c] = tags[nodes[c].tag]
    groups = np.zeros((n, len(TAG_GROUPS) + 2))
    for i, x in enumerate(nodes):
        for k, g in enumerate(TAG_GROUPS):
            if x.tag in g:
                groups[i, k] = 1
        groups[i, -2] = x.hidden
        groups[i, -1] = x.tag in NO_TEXT
    parent = np.array([max(x.parent, 0) for x in nodes])
    t = np.maximum(text, 1)
    body = np.stack([
        np.log1p(text), np.log1p(own), share, text / np.maximum(text[parent], 1), link / t, prose / t, total_marks / t, np.log1p(count), text / np.maximum(count, 1), np.log1p(longest), kids, paragraphs,
        side / t, told, most, least, above_told, above_main, above_side, np.array([x.depth for x in nodes], float), place, same, (link[parent] / t[parent]), told[parent], share[parent],
    ], axis=1)
    return np.hstack([body, groups]), own


def decode(nodes: list[Node], margin: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which elements to keep: the ancestor-closed set with the largest weighted log-odds."""
    weight = np.log1p(own) + 0.05
    value = weight * margin
    n = len(nodes)
    best = value.copy()
    for i in range(n - 1, 0, -1):
        if nodes[i].tag in NO_TEXT:
            best[i] = -1.0
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = np.zeros(n, bool)
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[nodes[i].parent] and best[i] > 0 and nodes[i].tag not in NO_TEXT
    return keep


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    """Kept text in page order: white space within a block is one space, and blocks are joined by one space."""
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            joined = " ".join("".join(now).split())
            if joined:
                blocks.append(joined)
            now.clear()

    # An explicit stack: page depth is not bounded.
    stack: list[tuple[int, int]] = [(0, 0)]
    while stack:
        i, k = stack.pop()
        x = nodes[i]
        if k == 0 and x.tag in BLOCKS:
            flush()
        if k == len(x.parts):
            if x.tag in BLOCKS:
                flush()
            elif x.tag == "br":
                now.append(" ")
            continue
        stack.append((i, k + 1))
        p = x.parts[k]
        if isinstance(p, str):
            now.append(entities.unescape(p))
        elif keep[p]:
            stack.append((p, 0))
        elif nodes[p].tag in BLOCKS or nodes[p].tag == "br":
            flush() if nodes[p].tag != "br" else now.append(" ")
    flush()
    return " ".join(blocks)


# -- generated training pages

#: A private-use character that marks main text in training pages.
MARK = "\ue000"


def _words(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = "".join(rng.choice("aeioubcdfghklmnprst") for _ in range(rng.randint(2, 9)))
        if rng.random() < 0.1:
            w += rng.choice([",", ".", "&amp;", "***", "!!", " |"])
        out.append(w.capitalize() if i == 0 else w)
    return " ".join(out) + rng.choice([".", ".", "", "!"])


def training_page(rng: random.Random) -> str:
    """A page whose main text carries the private-use mark U+E000 in every text run."""
    good = lambda n: MARK + _words(rng, n)
    name = lambda options: rng.choice(["class", "id", "class"]) + '="' + rng.choice(["", "", "x-", "site-", "c" + str(rng.randint(1, 9)) + " "]) + rng.choice(options) + rng.choice(["", "", "-inner", " wrap", "_1"]) + '"'
    tag = lambda t, options: rng.choice([f"<{t}", f"<div {name(options)}", f"<div {name(options)}", f"<{t} {name(options)}"])
    close = lambda opened: "</" + opened[1:].split()[0] + ">"

    def wrap(t: str, options: list[str], inner: str) -> str:
        o = tag(t, options)
        return o + ">" + inner + close(o)

    links = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{_words(rng, rng.randint(1, 4))}</a></li>' for i in range(k)) + "</ul>"
    plain = lambda k: "".join(f"<p>{_words(rng, rng.randint(4, 40))}</p>" for _ in range(k))
    nav = lambda: wrap("nav", ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb"], links(rng.randint(2, 9)))
    header = lambda: wrap("header", ["header", "masthead", "top-banner", "site-header"], rng.choice(["", f"<h1>{_words(rng, 3)}</h1>", f"<a href='/'>{_words(rng, 2)}</a>"]) + rng.choice(["", links(4)]) + rng.choice(["", f"<p>{_words(rng, 6)}</p>"]))
    footer = lambda: wrap("footer", ["footer", "site-footer", "copyright", "legal"], rng.choice(["&copy; ", ""]) + _words(rng, rng.randint(3, 30)) + rng.choice(["", links(3), plain(1)]))
    side = lambda: wrap("aside", ["sidebar", "side", "related", "widget", "right-rail", "recommended"], rng.choice([f"<h3>{_words(rng, 2)}</h3>", ""]) + rng.choice([links(5), plain(2), plain(1) + links(2)]))
    advert = lambda: f"<div {name(['ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'advertisement'])}>" + rng.choice([_words(rng, rng.randint(3, 30)), plain(1)]) + "</div>"
    notice = lambda: f"<div {name(['cookie-notice', 'notice', 'consent', 'alert', 'gdpr', 'newsletter', 'subscribe'])}>" + rng.choice([_words(rng, rng.randint(4, 30)), plain(1)]) + rng.choice(["", "<button>ok</button>"]) + "</div>"
    form = lambda: f"<form {rng.choice(['', name(['search', 'login', 'subscribe', 'contact'])])}><label>{_words(rng, 2)}</label><input name=q><button>{_words(rng, 1)}</button>{rng.choice(['', '<p>' + _words(rng, 9) + '</p>'])}</form>"
    comments = lambda: wrap("section", ["comments", "comment-list", "discussion", "replies", "disqus"], rng.choice([f"<h3>{_words(rng, 2)}</h3>", ""]) + "".join(f"<div {name(['comment', 'reply'])}><b>{_words(rng, 1)}</b>{plain(rng.randint(1, 2))}</div>" for _ in range(rng.randint(1, 5))))
    share = lambda: f"<div {name(['share', 'social', 'sharing', 'tags', 'toolbar'])}>" + links(3) + "</div>"

    def prose() -> str:
        parts = [rng.choice([f"<h1>{good(rng.randint(2, 10))}</h1>", f"<h2>{good(5)}</h2>", ""])]
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14])):
            k = rng.choice([1, 2, 5, 10, 30, 60, 120])
            parts.append(rng.choices([
                f"<p>{good(k)}</p>", f"<p>{good(k)} <b>{good(2)}</b> {good(3)}</p>", f"<p>{good(k)} <a href='/x'>{good(2)}</a> {good(4)}</p>", f"<p><b>{good(k)}<br>", f"<p>{good(k)}", f"<h2>{good(3)}</h2>",
                f"<ul><li>{good(4)}</li><li>{good(9)}<li>{good(3)}</ul>", f"<blockquote>{good(k)}</blockquote>", f"<div>{good(k)}</div>", f"<table><tr><td>{good(2)}<td>{good(3)}</table>", f"<figure><img src=x><figcaption>{good(5)}</figcaption></figure>",
                f"<pre>{good(6)}</pre>", f"<section><h3>{good(3)}</h3><p>{good(k)}</p></section>",
            ], weights=[10, 3, 3, 2, 3, 2, 2, 1, 1, 1, 1, 1, 1])[0])
            if rng.random() < 0.12:
                parts.append(rng.choice([advert, share, side, notice, form])())
        return "".join(parts)

    main = prose()
    # Names that mislead: main text may stand in an element whose name is a menu's or a banner's, and the reverse.
    odd = ["author", "meta", "banner", "header", "share", "promo", "widget", "notice", "links", "side", "tags"]
    plain_names = ["content", "post", "entry", "article-body", "story", "main-content", "text", "prose", "page", "single", "body-copy", "block", "col", "row", "wrap"]
    o = rng.choice(["<article", "<main", f"<div {name(plain_names)}", "<article", f"<article {name(['post', 'story'])}", "<div", "<section", f"<section {name(plain_names)}", f"<td {name(plain_names)}"])
    if rng.random() < 0.25:
        o = rng.choice(["<article", "<article", "<div", "<section"]) + f' class="{rng.choice(plain_names)} {rng.choice(odd)}"' if rng.random() < 0.6 else f"<article {name(odd)}"
    end = close(o)
    o = "<table><tr>" + o if o.startswith("<td") else o
    main = o + ">" + main + rng.choice(["", "", share(), comments()]) + end + ("</tr></table>" if end == "</td>" else "")
    if rng.random() < 0.3:
        main = rng.choice(["<main>", "<div class=container>", "<div id=page>", f"<div {name(odd)}>"]) + rng.choice(["", side(), advert()]) + main + rng.choice(["", side(), comments()])
        main += "</main>" if main.startswith("<main>") else "</div>"
    before = "".join(p() for p in rng.sample([nav, header, advert, notice, side, form], rng.randint(0, 4)))
    after = "".join(p() for p in rng.sample([footer, side, comments, advert, share, form, notice, nav], rng.randint(0, 4)))
    inner = f"{before}<!-- x -->{main}{after}"
    if rng.random() < 0.2:
        whole = rng.choice(["<form action=/p method=post", "<form id=aspnetForm", f"<div {name(odd)}", "<div class=site", "<div id=wrapper"])
        inner = whole + ">" + inner + close(whole)
    return f"<html><head><title>{_words(rng, 4)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{inner}</body></html>"


@dataclass
class Extractor:
    """The trees, and the log-odds of each slot of attribute tokens."""

    trees: boosting.Trees
    odds: np.ndarray


def _marked(rng: random.Random) -> tuple[list[Node], np.ndarray]:
    """A training page's elements, and which of them hold main text."""
    nodes = parse(training_page(rng))
    holds = np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        marked = any(isinstance(p, str) and MARK in p for p in x.parts)
        x.parts = [p.replace(MARK, "") if isinstance(p, str) else p for p in x.parts]
        holds[i] |= marked
        if i and holds[i]:
            holds[x.parent] = True
    return nodes, holds


@lru_cache(maxsize=4)
def train(pages: int = 400, seed: int = 5) -> Extractor:
    """Fit on generated pages: an element is positive if its subtree holds main text. A process trains once."""
    rng = random.Random(seed)
    yes, no = np.zeros(SLOTS), np.zeros(SLOTS)
    for _ in range(pages // 2):
        nodes, holds = _marked(rng)
        for x, y in zip(nodes, holds, strict=True):
            for w in set(x.names):
                (yes if y else no)[slot(w)] += 1
    odds = np.log((yes + 3) / (no + 3))  # shrunk: a slot that was never seen says nothing
    xs, ys, ws = [], [], []
    for _ in range(pages):
        nodes, holds = _marked(rng)
        f, own = features(nodes, odds)
        some = f[:, 0] > 0
        xs.append(f[some])
        ys.append(holds[some])
        ws.append((np.log1p(own) + 0.3)[some])
    return Extractor(boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws)), odds)


def extract(pages: list[str | None], model: Extractor) -> list[str]:
    """The main text of each page."""
    out = [""] * len(pages)
    parsed, found, owns = [], [], []
    for i, page in enumerate(pages):
        if page:
            nodes = parse(page)
            f, own = features(nodes, model.odds)
            parsed.append((i, nodes))
            found.append(f)
            owns.append(own)
    if not parsed:
        return out
    margins = np.split(model.trees.margin(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1])
    for (i, nodes), margin, own in zip(parsed, margins, owns, strict=True):
        out[i] = text_of(nodes, decode(nodes, margin, own))
    return out


def main_text(pages: DataFrame, model: Extractor, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Null and empty pages have an empty text. Null ids and urls and repeated rows give a row each; an empty table none. A
    page of any length is read whole; of several articles all are kept. Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 200):
                part = b.iloc[s : s + 200]
                texts = extract(part["html"].tolist(), shared.value)
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": texts, "n_chars": np.fromiter(map(len, texts), np.int64, len(texts))})

    rows = pages.select(id_text(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    out = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
