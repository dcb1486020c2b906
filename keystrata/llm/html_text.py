"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text.  Each block is described by its words and link density, those of the
blocks before and after it, and by hints of its containers (element names, classes, roles), graded by how plainly
they speak and by how much of the page's text they hold.  A CART tree, trained on the labelled blocks of
``html_labels``, keeps a block or drops it; no hint decides alone.  A page is handled whole inside one Arrow batch
row: no shuffle, and nothing is shared between pages.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe svg canvas object textarea select title head audio video annotation".split())
#: Those that hold no tags: a slash at the end of their start tag (or of an unquoted value) doesn't close them.
UNPARSED = frozenset(("script", "style", "textarea", "title"))
#: Elements that end a block where they begin and end.
BLOCK = frozenset(
    "p div section article main nav header footer aside form fieldset h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption "
    "blockquote pre figure figcaption address details summary hr body html center menu dialog legend button option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th img input".split())
#: Blocks whose end tag is often missing; they don't hold containers open.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option h1 h2 h3 h4 h5 h6 button".split())

BAD_NAMES = frozenset("nav footer aside form menu dialog fieldset button option legend".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
BAD_TOKENS = frozenset(
    "nav navbar navigation menu menubar submenu toc breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer foot sidebar side aside rail widget "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner teaser "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay toast disclaimer subscribe subscription newsletter signup signin login register paywall "
    "search share sharing social follow related recommend recommended recommendations trending popular "
    "comment comments commentlist commenter reply replies respond responses discussion disqus reactions form copyright legal skip".split()
)
HEADER_TOKENS = frozenset("header head".split())
#: In a class name these say how a wrapper is laid out, not what it holds.
LAYOUT_TOKENS = frozenset("layout has with no without grid theme template".split())
WRAP_TOKENS = frozenset("wrap wrapper container inner outer".split())
#: Words of place and shape: beside them a name still says plainly what it holds.
PLACE_TOKENS = frozenset(
    "site page top bottom left right center box block area section list item items bar slot unit link links title body text global mobile desktop js main content header head "
    "primary secondary region zone panel group wrap wrapper container inner outer row col column thread entry post posts article articles story icon icons btn button buttons user "
    "reader author meta info more you may also like us up in out the to and for my new old big small sticky fixed floating id".split()
)
GOOD_NAMES = frozenset(("article", "main"))
GOOD_TOKENS = frozenset("article content main post entry story articlebody".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ROUGH = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Values are taken whole, so that what is written inside another attribute's value isn't an attribute.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    bad: int  # 2: a container or the block itself is plainly boilerplate, 1: a name hints at it
    share: float  # of the page's words, those in the outermost such container
    header: bool
    good: bool
    heading: bool
    item: bool


@lru_cache(maxsize=1 << 14)
def _cue(name: str, attrs: str) -> tuple[int, bool, bool]:
    """Of an element: boilerplate (0 to 2), header, content."""
    bad, header, good = 2 * (name in BAD_NAMES), name == "header", name in GOOD_NAMES
    if attrs and name not in ("html", "body"):
        for key, a, b, c in _ATTR.findall(attrs):
            value, key = a or b or c, key.lower()
            if key not in ("class", "id", "role"):
                continue
            if key == "role":
                bad = max(bad, 2 * (value.strip().lower() in BAD_ROLES))
                good |= value.strip().lower() in ("main", "article")
                continue
            for one in value.split():
                tokens = {t.lower() for t in _TOKEN.findall(one)}
                if tokens & LAYOUT_TOKENS or tokens & WRAP_TOKENS and tokens & GOOD_TOKENS:
                    continue
                if tokens & BAD_TOKENS:
                    bad = max(bad, 2 if tokens <= BAD_TOKENS | PLACE_TOKENS else 1)
                header |= bool(tokens & HEADER_TOKENS)
                good |= bool(tokens & GOOD_TOKENS)
    if bad == 1 and name in GOOD_NAMES:
        bad = 0  # an article that is about notices isn't one
    return bad, header and not bad, good and bad < 2


def _joined(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def blocks(html: str | None) -> list[Block]:
    """The flat text blocks of a page in page order; text is decoded, its white space runs are single spaces."""
    out: list[Block] = []
    if not html:
        return out
    # open containers: name, boilerplate, header, content, and their place among the nodes
    stack: list[tuple[str, int, bool, bool, int]] = []
    open_names: Counter[str] = Counter()
    header = good = 0  # how many open containers say so
    # containers that hint at boilerplate or content, as a tree: parent, boilerplate, content, closed by their own end tag
    nodes: list[list] = [[-1, 0, False, True]]
    here = 0
    homes: list[int] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link = False
    kind = ""
    own: tuple[int, bool, bool] = (0, False, False)  # cues of a loose element itself

    def flush() -> None:
        nonlocal own, kind
        if parts:
            text = _joined(parts)
            if text:
                heading = kind[:1] == "h" and kind[1:].isdigit()
                out.append(Block(text, text.count(" ") + 1, len("".join(linked).split()), own[0], 0.0, bool(header or own[1]), bool(good or own[2]), heading, kind in ("li", "dt", "dd")))
                homes.append(here)
            parts.clear()
            linked.clear()
        own, kind = (0, False, False), ""

    def add(raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked.append(text)

    ends: dict[str, re.Match[str] | None] = {}

    def end_tag(name: str, at: int) -> re.Match[str] | None:
        """The next end tag of that name; each part of the page is searched once."""
        if name not in ends or (known := ends[name]) and known.start() < at:
            ends[name] = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(html, at)
        return ends[name]

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt + 2)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt) or _ROUGH.match(html, lt)
        if m is None:
            if re.match(r"</?[a-zA-Z]", html[lt : lt + 3]):  # cut off inside a tag
                break
            add("<")
            at = lt + 1
            continue
        at = m.end()
        name, attrs = m[2].lower(), m[3]
        if m[1]:
            if name in RAW:
                continue
            if name == "a":
                in_link = False
            elif name in BLOCK:
                flush()
                if name not in LOOSE and open_names[name]:
                    while True:
                        top, b, h, g, node = stack.pop()
                        open_names[top] -= 1
                        header, good = header - h, good - g
                        if node:
                            here = nodes[node][0]
                        if top == name:
                            if node:
                                nodes[node][3] = True
                            break
                    in_link = False
            elif name in SPACED:
                parts.append(" ")
            continue
        if name in RAW and not (name == "head"):
            slash = attrs.rstrip().endswith("/")
            close = end_tag(name, at) if name in UNPARSED or not slash else None
            if close and slash and re.compile(rf"<{name}(?=[\s/>])", re.IGNORECASE).search(html, at, close.start()):
                close = None  # that end tag is a later element's
            if close:
                end = html.find(">", close.end())
                at = size if end < 0 else end + 1
            elif name in UNPARSED and not slash:
                at = size
            if name in BLOCK:
                flush()
            continue
        if name == "a":
            in_link = True
            if linked:
                linked.append(" ")
            continue
        if name in SPACED:
            parts.append(" ")
            if name not in BLOCK:
                continue
        if name in BLOCK:
            flush()
            cue = (_cue if len(attrs) < 2000 else _cue.__wrapped__)(name, attrs)  # long ones aren't cached
            if name in VOID:
                continue
            if name in LOOSE:
                own, kind = cue, name
            else:
                node = 0
                if cue[0] or cue[2]:
                    nodes.append([here, cue[0], cue[2], False])
                    here = node = len(nodes) - 1
                stack.append((name, *cue, node))
                open_names[name] += 1
                header, good = header + cue[1], good + cue[2]
    flush()
    return _placed(out, homes, nodes)


def _placed(page: list[Block], homes: list[int], nodes: list[list]) -> list[Block]:
    """The blocks with what their containers say.

    A container whose end tag is missing says nothing of what stands in a content element inside it: the tag was
    forgotten before that.
    """
    n = len(nodes)
    words = [0] * n
    for b, home in zip(page, homes):
        words[home] += b.words
    for k in range(n - 1, 0, -1):
        words[nodes[k][0]] += words[k]
    said, closed, outer = [0] * n, [0] * n, [0] * n  # of a node and those around it; of closed ones alone; the outermost that counts
    closed_outer = [0] * n
    for k in range(1, n):
        parent, bad, content, shut = nodes[k]
        closed[k] = max(closed[parent], bad * shut)
        closed_outer[k] = closed_outer[parent] or k * (bad > 0 and shut)
        if content:
            said[k], outer[k] = max(closed[parent], bad), closed_outer[parent] or k * (bad > 0)
        else:
            said[k], outer[k] = max(said[parent], bad), outer[parent] or k * (bad > 0)
    total = max(1, words[0])
    return [b._replace(bad=max(b.bad, said[h]), share=words[outer[h]] / total if outer[h] else b.words / total * (b.bad > 0)) for b, h in zip(page, homes)]


FEATURES = ("words", "link_density", "before_words", "before_density", "after_words", "after_density", "near_density", "boilerplate", "share", "header", "content", "heading", "item", "sentence")


def features(page: list[Block]) -> np.ndarray:
    """One row for each block; beyond the page's ends neighbours have no words and no links.

    ``near_density`` is the greater of the two neighbours' link densities: links come in lists.
    """
    n = len(page)
    words = np.array([b.words for b in page], float)
    density = np.array([b.linked / b.words for b in page], float)
    around = lambda x: (np.concatenate([[0.0], x[:-1]]), np.concatenate([x[1:], [0.0]]))
    (bw, aw), (bd, ad) = around(words), around(density)
    flags = np.array([(b.bad, b.share, b.header, b.good, b.heading, b.item, b.text[-1] in ".!?…:;\"'”»)") for b in page], float).reshape(n, 7)
    return np.column_stack([words, density, bw, bd, aw, ad, np.maximum(bd, ad), flags])


class Tree(NamedTuple):
    """A CART tree in arrays: inner nodes test ``feature <= cut``; leaves have feature -1 and a label."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while (inner := self.feature[node] >= 0).any():
            k = np.flatnonzero(inner)
            go = x[k, self.feature[node[k]]] <= self.cut[node[k]]
            node[k] = np.where(go, self.left[node[k]], self.right[node[k]])
        return self.label[node]


def train(x: np.ndarray, y: np.ndarray, depth: int = 10, leaf: int = 3) -> Tree:
    """Gini splits, midpoints between neighbouring values; ties go to the earlier feature and lower cut."""
    rows: list[list[float]] = []

    def grow(k: np.ndarray, d: int) -> int:
        me = len(rows)
        ones = y[k].sum()
        rows.append([-1, 0.0, 0, 0, float(2 * ones >= len(k))])
        if d == 0 or ones in (0, len(k)):
            return me
        best = None
        for f in range(x.shape[1]):
            order = k[np.argsort(x[k, f], kind="stable")]
            v, t = x[order, f], np.cumsum(y[order])
            size = np.arange(1, len(k))
            at = np.flatnonzero((v[1:] > v[:-1]) & (size >= leaf) & (len(k) - size >= leaf))
            if not len(at):
                continue
            a, na = t[at], at + 1.0
            b, nb = ones - a, len(k) - na
            cost = 2 * (a * (na - a) / na + b * (nb - b) / nb)
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0] - 1e-12:
                best = (cost[i], f, (v[at[i]] + v[at[i] + 1]) / 2)
        if best is None:
            return me
        go = x[k, best[1]] <= best[2]
        rows[me][0], rows[me][1] = best[1], best[2]
        rows[me][2] = grow(k[go], d - 1)
        rows[me][3] = grow(k[~go], d - 1)
        return me

    grow(np.arange(len(y)), depth)
    f, c, left, right, label = (np.array(col) for col in zip(*rows))
    return Tree(f.astype(int), c, left.astype(int), right.astype(int), label.astype(bool))


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    from .html_labels import labelled_table

    return train(*labelled_table())


def main_text(html: str | None, tree: Tree | None = None) -> str:
    """The kept blocks joined by line feeds; empty for a null or empty page."""
    page = blocks(html)
    if not page:
        return ""
    keep = (tree or default_tree()).predict(features(page))
    return "\n".join(b.text for b, k in zip(page, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``.

    A null or empty page is empty; null ids and urls and repeated rows pass through; very long and broken pages are
    read whole in linear time; an empty table gives no rows; extra columns are ignored.
    """
    of = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return of.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
