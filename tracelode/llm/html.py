"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page is cut into blocks of text in page order. A logistic classifier, fitted
here on a few labelled pages, gives each block the log odds of being content;
they become the capacities from the source (content) and to the sink
(boilerplate). Neighbours in page order, and blocks that are near in the DOM
(same parent, same grandparent), are tied by smoothness edges. The minimum cut
of that graph, found by maximum flow, is the labelling with the least cost.

Scripts, styles and form controls are never text. Whole pages are used.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The white space of markup, and pieces of tags that are read one after the other.
_GAP = re.compile(r"[\t\n\f\r /]*")
_SPACE = re.compile(r"[\t\n\f\r ]*")
_TAG_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_NAME = re.compile(r"[^\t\n\f\r />][^\t\n\f\r />=]*")
_BARE = re.compile(r"[^\t\n\f\r >]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements by how they are read.
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
NEVER_TEXT = frozenset("template object svg select button canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()) | NEVER_TEXT
_END_OF_RAW = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW}
#: Words of tag names, classes, ids and roles that tell what a part of a page is.
HINTS = {
    "main": "article main content entry post story body text prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar skip toc",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer contentinfo copyright colophon legal bottom",
    "side": "aside sidebar side complementary related widget rail recommended popular trending teaser more",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp",
    "notice": "cookie cookies notice consent gdpr alert popup modal dialog overlay newsletter subscribe signup paywall hidden",
    "form": "form search login register fieldset input",
    "comment": "comment comments respond reply replies disqus discussion feedback reactions",
    "share": "share sharing social follow byline meta tags author",
}
#: Words that say little by themselves in a class or id; they are weak hints, as is every word beside one of "main".
WEAK = frozenset("header notice alert more side bottom legal copyright text input search meta tags author reply feedback dialog tabs skip discussion popular".split())
#: Tags and roles that hold the main part.
MAIN_PARTS = frozenset(["article", "main"])
_KINDS = list(HINTS)
_HINT = {w: 1 << k for k, name in enumerate(_KINDS) for w in HINTS[name].split()}
_MAIN, _HIDDEN = _HINT["main"], _HINT["hidden"]
_WEAK_SHIFT = len(_KINDS)
_LINK, _LABEL, _INSIDE, _WEAK_INSIDE, _SKIP = (1 << (2 * len(_KINDS) + k) for k in range(5))

#: Smoothness: between neighbours in page order, and between blocks under one parent or grandparent.
NEXT, PARENT, GRANDPARENT = 0.25, 0.5, 0.25


@dataclass(slots=True)
class Block:
    """A run of text that no block-level tag interrupts."""

    text: str
    mask: int
    linked: int
    tag: str
    parent: int
    grandparent: int


def _mask(above: int, tag: str, attributes: list[tuple[str, str]]) -> int:
    """The parent's hints and the element's own: strong ones, weak ones outside a main part, and that there is a weak one inside."""
    mask = above | _HINT.get(tag, 0) | (_LINK if tag == "a" else 0) | (_SKIP if tag in NEVER_TEXT else 0)
    if above & _INSIDE and tag == "header":  # the heading of the article, not of the page
        mask = above | _WEAK_INSIDE
    if tag in MAIN_PARTS:
        mask |= _INSIDE
    if tag in ("html", "body"):
        return mask
    weak = 0
    for name, value in attributes:
        if name == "role":
            for w in value.lower().split():
                mask |= _HINT.get(w, 0) | (_INSIDE if w in MAIN_PARTS else 0)
        elif name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                hints = [(w, _HINT[w]) for w in words if w in _HINT]
                mixed = any(h == _MAIN for _, h in hints)
                for w, h in hints:
                    if h == _MAIN:
                        mask |= h
                    elif mixed or (w in WEAK and all(x in WEAK for x, _ in hints)):
                        weak |= h
                    else:
                        mask |= h
        elif name == "data-main":
            mask |= _LABEL
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            mask |= _HIDDEN
    if weak:
        mask |= _WEAK_INSIDE if mask & _INSIDE else weak << _WEAK_SHIFT
    return mask


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes of a tag and where it ends; each character is read a fixed number of times. A tag that the page ends in has no end: -1."""
    out: list[tuple[str, str]] = []
    size = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= size:
            return out, -1
        if page[at] == ">":
            return out, at + 1
        m = _NAME.match(page, at)
        name, at = m[0].lower(), _SPACE.match(page, m.end()).end()
        value = ""
        if at < size and page[at] == "=":
            at = _SPACE.match(page, at + 1).end()
            if at < size and page[at] in "\"'":
                end = page.find(page[at], at + 1)
                if end < 0:
                    return out, -1
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        out.append((name, html.unescape(value) if "&" in value else value))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order. Unclosed, misnested and unknown tags are tolerated.

    One pass over the page; the open elements of each name are kept, so that a
    closing tag is found at once, however deep the page is.
    """
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0
    # (tag, mask, number) of the open elements; the places of those that are no inline ones, and of each tag
    stack: list[tuple[str, int, int]] = [("#page", 0, 0)]
    outer = [0]
    places: dict[str, list[int]] = {}
    made, at, size = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                k = outer[-1]
                out.append(Block(text, stack[-1][1], min(linked, len(text)), stack[k][0], stack[max(0, k - 1)][2], stack[max(0, k - 2)][2]))
        linked = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag not in INLINE:
                outer.pop()

    def put(tag: str, attributes: list[tuple[str, str]]) -> None:
        nonlocal made
        made += 1
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            outer.append(len(stack))
        stack.append((tag, _mask(stack[-1][1], tag, attributes), made))

    while at < size:
        lt = page.find("<", at)
        following = page[lt + 1 : lt + 2] if lt >= 0 else ""
        closing = following == "/" and page[lt + 2 : lt + 3].isalpha() and page[lt + 2].isascii()
        opening = following.isalpha() and following.isascii()
        markup = closing or opening or following in ("!", "?") or (following == "/" and len(page) > lt + 2)
        text = page[at:] if lt < 0 else page[at:lt] if markup and following else page[at : lt + 1]
        if text and not stack[-1][1] & _SKIP:
            pieces.append(text)
            if stack[-1][1] & _LINK:
                linked += len(text)
        if lt < 0:
            break
        if not (markup and following):
            at = lt + 1
            continue
        if not (opening or closing):
            dashes = page.startswith("<!--", lt)
            if dashes and (page.startswith(">", lt + 4) or page.startswith("->", lt + 4)):
                end = page.find(">", lt + 4)
            else:
                end = page.find("-->" if dashes else ">", lt + 4 if dashes else lt + 1)
            at = size if end < 0 else end + (3 if page.startswith("-->", end) else 1)
            continue
        m = _TAG_NAME.match(page, lt + 1 + closing)
        tag = m[0].lower()
        attributes, at = _attributes(page, m.end())
        if at < 0:
            break
        if closing:
            if tag == "br":
                pieces.append(" ")
                continue
            if tag not in INLINE:
                flush()
            open_ = places.get(tag)
            if open_ and (tag not in INLINE or open_[-1] > outer[-1]):
                close(open_[-1])
            continue
        if tag in RAW:
            end = _END_OF_RAW[tag].search(page, at)
            at = size if not end else _attributes(page, end.end())[1]
            if at < 0:
                break
            continue
        if tag == "svg" and page[at - 2] == "/":
            continue
        if tag in INLINE:
            put(tag, attributes)
            continue
        if tag in ("br", "wbr"):
            pieces.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        close(outer[-1] + 1)  # inline elements do not reach over blocks
        # a paragraph ends where another block begins; so do items and cells where the next one does
        if stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option")):
            close(len(stack) - 1)
        put(tag, attributes)
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block: what its ancestors are called, its links, length, punctuation and tag."""
    masks = np.array([b.mask for b in blocks], np.int64)[:, None]
    hints = (masks >> np.arange(2 * len(_KINDS))) & 1
    rest = [
        (
            b.linked / len(b.text), min(log1p(b.text.count(" ") + 1), 4.0), b.text[-1] in ".!?…\"”。", b.tag in ("p", "blockquote", "pre"),
            b.tag[0] == "h" and b.tag[1:].isdigit(), b.tag == "li", 1.0,
        )
        for b in blocks
    ]
    return np.concatenate([hints, masks & _INSIDE > 0, masks & _WEAK_INSIDE > 0, np.array(rest, float).reshape(-1, 7)], axis=1).astype(float)


#: Labelled pages for the classifier: what is under data-main is content.
TRAINING_PAGES = (
    "<body><header><a href=/>Site name</a><p>A slogan of the site.</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News of the day</a></ul></nav><main><article data-main><h1>A long title of a story</h1><p>The first words of the story are here, and there are quite a few of them.<p>Short one.<p>More of the story follows, with <a href=/x>a link</a> in it.<ul><li>one point of a list<li>another point</ul></article></main><aside><h3>Related</h3><p>Another story that you may like to read, with many words.</p></aside><footer>&copy; the site. All rights reserved.</footer></body>",
    "<body><div class=topbar>Welcome, reader. Sign in.</div><div id=menu><a href=/>Start</a> <a href=/c>Contact</a></div><div class=cookie-notice><p>We use cookies to make this site better. By reading on you agree to that.</p><button>OK</button></div><div id=content data-main><h2>Heading</h2><p>A paragraph of some length stands here; it says what there is to say.</p><blockquote>Said someone.</blockquote><p>And the end.</p></div><div class='ad slot'>Buy this now, it is cheap and good.</div><div id=comments><h3>2 comments</h3><div class=comment><p>I liked this a lot, thank you for writing it down.</p></div><div class=comment><p>Me too.</p></div></div><div class=footer><p>Imprint. Privacy. Terms of use and other things.</p></div></body>",
    "<body><p data-main>Only text without any frame, but a good deal of it, so it is what the page is for.</p><p data-main>It goes on here, for some more words, until it ends.</p><form><label>Your name</label><p>Fill in the form and send it to us, please.</p></form><div class=share>Share this on your page</div></body>",
    "<body><div class=sidebar><ul><li><a href=/1>One</a><li><a href=/2>Two words</a></ul><p>About this blog: it is written by someone.</p></div><div class=post><div data-main><h1>Post</h1><p>What is in the post is told in these words, which make a sentence.</p><pre>x = 1</pre><table><tr><td>cell</td><td>12</td></tr></table></div><div class=advertisement><p>An offer that you should not miss, says its maker.</p></div><p data-main>The rest of the post comes after the offer.</p><div class=newsletter><p>Get our letter every week by mail, for free.</p></div></div><section class=related-posts><article><h4><a href=/9>Some other post</a></h4><p>What it says in short, with a few words.</p></article></section><section id=respond><article class=comment><p>A reader's reply in one long sentence that means well.</p></article></section></body>",
    "<body><div role=banner><h1>Name of the paper</h1></div><div role=navigation><a href=/p>Politics</a><a href=/s>Sport</a></div><div role=main><h1 data-main>Headline</h1><div data-main>Text in a division, with several sentences. This is the second one.</div><div data-main>And a third piece.</div></div><div role=complementary>Most read today: a list of things</div><div role=contentinfo>Published by the publisher, in the city, since long ago.</div></body>",
    "<body><section><div data-main><h2>Part</h2><p>First paragraph of an unnamed division, in plain words that go on for a while.</p><ol><li>Step one of the way to do it.<li>Step two of it.</ol></div></section><div class=breadcrumbs>Home / Section / Page</div><div class=popup hidden>Please subscribe to read more of this.</div><div class=banner><p>Sale ends today, all must go, do not wait.</p></div><p><a href=/n>Next page</a> <a href=/m>Previous page</a></p></body>",
    "<body><div id=page-header><p>The daily paper, since long ago.</p></div><article data-main><header><h1>Title</h1></header><p class=story-header>The head of the story is told in one sentence, in this class.</p><div id=more-story><p>More of the story stands under this name.</p></div><section class=notice><p>A notice that the author gives is a part of the text.</p></section><p class=article-footer>The last words of it.</p></article><div class=notice><p>Please note that the site is closed on Monday.</p></div></body>",
    "<body><main><article><div data-main><h1>About it</h1><p class=text-meta>What was said about it was said by many.</p></div><div class=ad-slot><p>Buy this now, it is a very good thing to have.</p></div><p data-main>And they said it again, in other words.</p><div class=related-posts><p>Another story that you may like to read.</p></div><p data-main class=content-more>Then it was over.</p><aside><p>A box beside the text, with some facts in it.</p></aside><div class=newsletter-signup><p>Get our letter by mail, it is free.</p></div><div class=share-buttons>Share this</div><section id=comments><p>I have read this and do not agree with it at all.</p></section></article></main><div class=more><a href=/m>More of this</a></div></body>",
    "<body><div class=page><div class=side-menu><a href=/1>First</a><a href=/2>Second</a></div><div class=alert><p>Your browser is out of date.</p></div><div class=post-body data-main><h2>A walk</h2><p>We walked along the river until it was dark.</p><p class=side-note>It was the longest river that we had seen so far.</p><p>Then we went home.</p></div><div class=search><p>Find a page on this site.</p></div><div class=meta-links><p>Tagged as walks, rivers.</p></div></div></body>",
    "<body><table><tr><td class=menu><a href=/x>X</a> <a href=/y>Y</a></td><td class=maintext data-main><p>An old page with a table for its frame says this.</p><p>It has a second paragraph, too.</p></td></tr></table><p class=legal>All rights are reserved by the owner of this page.</p></body>",
)
TRAIN_STEPS = 3000
RIDGE = 0.002


@lru_cache(1)
def classifier() -> np.ndarray:
    """Weights of the logistic regression, by gradient steps on the labelled pages."""
    pages = [blocks_of(p) for p in TRAINING_PAGES]
    x = np.concatenate([features(b) for b in pages])
    y = np.array([float(bool(b.mask & _LABEL)) for p in pages for b in p])
    w = np.zeros(x.shape[1])
    for _ in range(TRAIN_STEPS):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 0.5 * (x.T @ (p - y) / len(y) + RIDGE * np.r_[w[:-1], 0.0] / 4)
    return w


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Edge weights between blocks: neighbours, and the nearest earlier block under the same parent or grandparent."""
    edges: dict[tuple[int, int], float] = {}
    parents: dict[int, int] = {}
    grandparents: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            edges[k - 1, k] = edges.get((k - 1, k), 0.0) + NEXT
        for seen, key, weight in ((parents, b.parent, PARENT), (grandparents, b.grandparent, GRANDPARENT)):
            if key in seen:
                edges[seen[key], k] = edges.get((seen[key], k), 0.0) + weight
            seen[key] = k
    return edges


def min_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes are on the content side of the minimum cut.

    A node whose own odds outweigh all its edges together has that label in
    every minimum cut; it is settled first, and its edges are added to its
    neighbours' odds. The flow then runs over what is left. A node that may be
    on either side counts as boilerplate.
    """
    n, odds = len(odds), list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(odds[k]) > sum(near[k].values()):
            label[k] = odds[k] > 0
            for j, w in near[k].items():
                odds[j] += w if label[k] else -w
                del near[j][k]
                todo.append(j)
            near[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        for k, side in zip(rest, _max_flow(rest, odds, near), strict=True):
            label[k] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Source sides of a maximum flow.

    Rounds of distances from the source, each followed by as much flow as
    shortest paths take; a node whose ways are used up is not tried again in
    its round.
    """
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {k: dict(near[k]) for k in nodes} | {source: {}, sink: {}}
    for k in nodes:
        if odds[k] > 0:
            room[source][k] = odds[k]
            room[k][source] = 0.0
        else:
            room[k][sink] = -odds[k]
            room[sink][k] = 0.0
    while True:
        far = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-12 and v not in far:
                    far[v] = far[u] + 1
                    queue.append(v)
        if sink not in far:
            return [k in far for k in nodes]
        ways, tried = {u: list(room[u]) for u in far}, dict.fromkeys(far, 0)
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                    if cut is None and room[a][b] <= 1e-12:
                        cut = k
                del path[cut + 1 :]
                continue
            while tried[u] < len(ways[u]):
                v = ways[u][tried[u]]
                if room[u][v] > 1e-12 and far.get(v) == far[u] + 1:
                    path.append(v)
                    break
                tried[u] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def main_text(page: str | None) -> str:
    """The content blocks of a page joined by one space; empty if there are none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    sides = min_cut((features(blocks) @ classifier()).tolist(), smoothness(blocks))
    return " ".join(b.text for b, content in zip(blocks, sides, strict=True) if content)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py()) for p in batch.column("html")]
        arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``.

    Reading takes time in proportion to the page, whatever its markup, so very
    long and hostile pages are read like any other; a tag that is still open
    where the page ends is markup, not text. A null or empty page has an empty text. Equal pages have equal texts; null
    ids and urls are given back as they are; other columns are ignored.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
