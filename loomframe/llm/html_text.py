"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of elements whose leaves are text blocks (the inline text between two block
borders).  Every node is article or not; a node's potentials come from its tag, class and id words,
text length and link share, and tables tie each child to its parent by the parent's kind.  Messages go
up and down the tree once (sum-product), all pages of a chunk level by level, and blocks whose
marginal reaches one half are the text.  The weights are learned from labelled pages that
`labelled_pages` writes with a fixed seed: layouts with menus, side columns, notices, forms, comments
and articles, whose blocks are known.

Cases: null or empty html gives an empty text.  Open elements end where HTML lets them; stray end
tags are ignored; an unclosed comment, script or tag runs to the end.  Deep trees need no recursion.
Repeated rows are judged one by one, each page whole in one task; extra columns of any name stay, but for
text, which is replaced.  Formulas and drawings inside a sentence stay in it with their text; form controls
go without ending the block.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, chunks, plain_names, ship

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements whose inside is no page text.
_SILENT = frozenset("script style noscript template iframe textarea select option button datalist title head annotation".split())
#: Form controls and the like stand inside a line of text: they end no block.
_SILENT_INLINE = frozenset("script style noscript template iframe textarea select option button datalist annotation".split())
#: All elements inside these stand in one line.
_DRAWN = frozenset(("math", "svg"))
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("math svg object canvas audio video picture map nobr font output meter progress bdo slot ruby rb rtc a abbr acronym b bdi bdo big cite code data del dfn em i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split())
#: An element of the key ends open elements of the values, up to the nearest of the borders.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_BORDERS = frozenset("html body article section div aside nav header footer main table ul ol dl td th form blockquote".split())

#: Further elements that are blocks; of unknown ones those with a hyphen in their name, as pages use them as boxes.
_BLOCKS = frozenset("caption col colgroup legend optgroup summary search hgroup frameset noframes body html head title rp thead tfoot".split())
_GROUPS = {t: k for k, tags in enumerate(("html body", "div section center td th tr tbody table", "nav menu", "header", "footer", "aside", "form fieldset dialog", "article", "main", "p pre blockquote figcaption", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl", "figure details address")) for t in tags.split()}
_N_GROUPS = 15  # the last: any other element; text blocks have a feature of their own
_BAD = frozenset("nav menu sidebar side ad ads advert advertisement sponsor sponsored banner cookie cookies consent notice notices alert comment comments reply replies respond footer header masthead promo share sharing social related recommended widget login signup subscribe newsletter breadcrumb breadcrumbs pagination pager popup modal toolbar copyright legal disclaimer rail navigation search form tags".split())
_GOOD = frozenset("article content post entry main body story text page prose copy".split())
#: Kinds of parents with a table each: plain boxes, page furniture, the article, anything else.
_KIND = {**dict.fromkeys((0, 1), 0), **dict.fromkeys((2, 3, 4, 5, 6), 1), **dict.fromkeys((7, 8), 2)}
N_FEATURES = _N_GROUPS + 14


@dataclass
class Tree:
    """Nodes of one page in page order: parents come before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    good: list[bool] = field(default_factory=list)
    bad: list[bool] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)

    def add(self, parent: int, group: int, good: bool, bad: bool, text: str | None = None, links: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.group.append(group), self.good.append(good), self.bad.append(bad)
        self.chars.append(len(text) if text else 0), self.links.append(links), self.text.append(text)
        return len(self.parent) - 1


def parse(page: str) -> Tree:
    """The tree of a page; node 0 is the page itself."""
    tree = Tree()
    tree.add(-1, 0, False, False)
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open elements: tag, node (inline ones have that around them), inline
    open_ = Counter({"": 1})
    inner = [Counter()]  # inline elements open in each open block
    quiet = drawn = anchors = 0  # open elements of _SILENT, _DRAWN, and links
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                links = sum(len(p) for p, linked in parts if linked)
                total = sum(len(p) for p, _ in parts)
                tree.add(stack[-1][1], _N_GROUPS, False, False, text, round(len(text) * links / max(1, total)))
            parts.clear()

    def push(tag: str, node: int, inline: bool) -> None:
        nonlocal quiet, drawn, anchors
        stack.append((tag, node, inline))
        open_[tag] += 1
        quiet, drawn, anchors = quiet + (tag in _SILENT), drawn + (tag in _DRAWN), anchors + (tag == "a")
        if inline:
            inner[-1][tag] += 1
        else:
            inner.append(Counter())

    def close(at: int) -> None:
        nonlocal quiet, drawn, anchors
        if not all(inline for _, _, inline in stack[at:]):
            flush()
        while len(stack) > at:
            tag, _, inline = stack.pop()
            open_[tag] -= 1
            quiet, drawn, anchors = quiet - (tag in _SILENT), drawn - (tag in _DRAWN), anchors - (tag == "a")
            if inline:
                inner[-1][tag] -= 1
            else:
                inner.pop()

    def end_open(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        if not any(open_[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                close(k)
                return
            if stack[k][0] in stop:
                return

    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        stop = m.start() if m else n
        if stop > at and not quiet:
            parts.append((page[at:stop], anchors > 0))
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        ends, tag = bool(m[1] or m[4]), tag.lower()
        if tag == "br":  # its end tag counts as one, too
            parts.append((" ", False))
            continue
        inline = tag in _INLINE or tag in _SILENT_INLINE or drawn > 0 or (tag not in _GROUPS and tag not in _ENDS_P and tag not in _BLOCKS and "-" not in tag)
        if ends:
            # an inline end does not reach out of its block; ends of what is not open are passed over at once
            if inner[-1][tag] if inline else open_[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            if tag == "p":
                flush()
            continue
        if tag in _ENDS_P:
            end_open(("p",), _BORDERS)
        if tag in _ENDS:
            end_open(_ENDS[tag], frozenset(("ul", "ol", "dl", "table", "select")) if tag != "body" else frozenset())
        if tag in _VOID or (drawn and page[at - 2] == "/"):
            if tag == "hr":
                flush()
            continue
        if tag in _RAW and not (drawn and tag == "title"):
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
        if inline:
            push(tag, stack[-1][1], True)
            continue
        flush()
        words = {w for name in _NAMES.findall((m[3] if m[2] else m[6]) or "") for w in _WORD.findall("".join(name).lower())}
        push(tag, stack[-1][1] if tag in _SILENT else tree.add(stack[-1][1], _GROUPS.get(tag, _N_GROUPS - 1), bool(words & _GOOD), bool(words & _BAD)), False)
    flush()
    return tree


class Forest:
    """Trees of many pages as arrays; nodes keep their order, parents are absolute."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        sizes = [len(t.parent) for t in trees]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        join = lambda name, kind: np.concatenate([np.zeros(0, kind), *[np.array(getattr(t, name), kind) for t in trees]])
        parent = join("parent", np.int64)
        self.parent = np.where(parent >= 0, parent + np.repeat(self.first[:-1], sizes), -1)
        self.depth = join("depth", np.int64)
        self.group = join("group", np.int64)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)[1:] if len(parent) else []
        chars, links = join("chars", np.float64), join("links", np.float64)
        blocks = (self.group == _N_GROUPS).astype(np.float64)
        block = blocks.copy()
        for level in reversed(self.levels):
            for x in (chars, links, blocks):
                np.add.at(x, self.parent[level], x[level])
        page = np.repeat(self.first[:-1], sizes)
        share = links / np.maximum(chars, 1)
        self.kind = np.array([_KIND.get(g, 3) for g in range(_N_GROUPS + 1)])[self.group[np.maximum(self.parent, 0)]]
        onehot = np.zeros((len(parent), _N_GROUPS + 1))
        onehot[np.arange(len(parent)), self.group] = 1
        good, bad = join("good", np.float64), join("bad", np.float64)
        size = np.log1p(chars)
        self.x = np.column_stack([onehot, good, bad, good * (1 - bad), share, share > 0.5, size / 5, block * size / 5, block * (chars < 25), block * (chars > 150), block * share, np.minimum(blocks, 20) / 10, chars / np.maximum(chars[page], 1), self.depth == 0])

    def run(self, weight: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log beliefs from below, messages to parents, and marginal log beliefs of all nodes (nodes, 2)."""
        below = np.zeros((len(self.x), 2))
        below[:, 1] = np.einsum("ij,j->i", self.x, weight)  # such small products only wait for each other in several threads
        sent = np.zeros_like(below)
        for level in reversed(self.levels):
            t = tables[self.kind[level]]
            b = below[level]
            for y in (0, 1):
                sent[level, y] = np.logaddexp(t[:, y, 0] + b[:, 0], t[:, y, 1] + b[:, 1])
            np.add.at(below, self.parent[level], sent[level])
        whole = below.copy()
        for level in self.levels:
            t = tables[self.kind[level]]
            rest = whole[self.parent[level]] - sent[level]
            rest -= rest.max(1, keepdims=True)
            for y in (0, 1):
                whole[level, y] += np.logaddexp(t[:, 0, y] + rest[:, 0], t[:, 1, y] + rest[:, 1])
        return below, sent, whole

    def marginals(self, weight: np.ndarray, tables: np.ndarray) -> np.ndarray:
        whole = self.run(weight, tables)[2]
        return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500)))


@dataclass
class TreeModel:
    weight: np.ndarray
    tables: np.ndarray

    def texts(self, pages: list[str]) -> list[str]:
        """The article of each page."""
        if not pages:
            return []
        forest = Forest([parse(p) for p in pages])
        keep = forest.marginals(self.weight, self.tables) >= 0.5
        return ["\n\n".join(text for text, ok in zip(tree.text, keep[lo:].tolist(), strict=False) if text is not None and ok) for tree, lo in zip(forest.trees, forest.first[:-1].tolist(), strict=True)]


def fit(forest: Forest, label: np.ndarray, rounds: int = 250, ridge: float = 2e-3) -> TreeModel:
    """Maximum likelihood with a ridge, by Adam, from exact marginals of nodes and of parent-child pairs."""
    weight, tables = np.zeros(forest.x.shape[1]), np.zeros((4, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    up = forest.parent[child]
    seen = np.zeros_like(tables)
    np.add.at(seen, (forest.kind[child], label[up], label[child]), 1)
    n = len(forest.trees)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (weight, tables)]
    for step in range(1, rounds + 1):
        below, sent, whole = forest.run(weight, tables)
        p = 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500)))
        pair = (whole[up] - sent[child])[:, :, None] + tables[forest.kind[child]] + below[child][:, None, :]
        pair = np.exp(pair - pair.max((1, 2), keepdims=True))
        pair /= pair.sum((1, 2), keepdims=True)
        expected = np.zeros_like(tables)
        np.add.at(expected, forest.kind[child], pair)
        grads = [np.einsum("ij,i->j", forest.x, p - label) / n + ridge * weight, (expected - seen) / n + ridge * tables]
        for w, g, mv in zip((weight, tables), grads, moments, strict=True):
            mv[0] = 0.9 * mv[0] + 0.1 * g
            mv[1] = 0.99 * mv[1] + 0.01 * g**2
            w -= 0.08 * (mv[0] / (1 - 0.9**step)) / (np.sqrt(mv[1] / (1 - 0.99**step)) + 1e-8)
    return TreeModel(weight, tables)


def labelled_pages(n: int = 400, seed: int = 11) -> tuple[list[str], list[list[str]]]:
    """Pages of many layouts and the blocks of their articles."""
    pick = random.Random(seed)
    serial = 0

    def words(low: int, high: int) -> str:
        nonlocal serial
        serial += 1
        out = ["".join(pick.choice("aeiounrstlmdkpg") for _ in range(pick.randint(2, 9))) for _ in range(pick.randint(low, high))]
        out.insert(0, f"q{serial}")
        return " ".join(out) + pick.choice((".", ".", "", "!", "?"))

    def box(tag: str, names: str, inside: str) -> str:
        mark = pick.choice(("class", "id", "class"))
        return f'<{tag} {mark}="{names}">{inside}</{tag}>' if names else f"<{tag}>{inside}</{tag}>"

    def links(k: int) -> str:
        made = [f'<a href="/{i}">{words(0, 2)}</a>' for i in range(k)]
        return f"<ul>{''.join(f'<li>{a}</li>' for a in made)}</ul>" if pick.random() < 0.7 else " | ".join(made)

    def furniture() -> str:
        kind = pick.randrange(13)
        if kind == 0:
            return box(pick.choice(("nav", "div")), pick.choice(("menu", "nav", "navigation", "topnav menu", "breadcrumb")), links(pick.randint(2, 9)))
        if kind == 1:
            return f"<nav>{links(pick.randint(2, 9))}</nav>"
        if kind == 2:
            return box("div", pick.choice(("ad", "ads", "advert", "banner ad", "sponsored", "promo")), pick.choice(("", "<p>")) + words(3, 40))
        if kind == 3:
            return box(pick.choice(("aside", "div")), pick.choice(("sidebar", "side", "related", "widget")), f"<h3>{words(1, 3)}</h3>" + pick.choice((links(4), f"<p>{words(5, 60)}</p>")))
        if kind == 4:
            return f"<aside><p>{words(5, 60)}</p></aside>"
        if kind == 5:
            return box("div", pick.choice(("cookie-notice", "notice", "consent", "alert", "cookie")), f"<p>{words(5, 40)}</p>")
        if kind == 6:
            return f"<form action='/s'><label>{words(1, 3)}</label><input name=q><p>{words(3, 20)}</p><button>{words(0, 1)}</button></form>"
        if kind == 7:
            one = lambda: box("div", pick.choice(("comment", "reply", "")), f"<p>{words(4, 70)}</p>")
            return box(pick.choice(("div", "section", "ul", "ol")), pick.choice(("comments", "comment-list", "comments replies", "respond")), f"<h2>{words(1, 2)}</h2>" + "".join(one() for _ in range(pick.randint(1, 5))))
        if kind == 8:
            return f"<header>{pick.choice(('<h1>', '<p>', '<div>'))}{words(1, 6)}</header>"
        if kind == 9:
            return box("div", pick.choice(("share", "social", "pagination", "tags")), links(4))
        if kind == 10:
            return f"<footer>{pick.choice(('', '<p>'))}&copy; {words(3, 30)}{pick.choice(('', chr(10)))}{words(0, 4)}</footer>"
        if kind == 11:
            return box("div", pick.choice(("footer", "header", "masthead", "copyright")), f"<p>{words(3, 25)}</p>")
        return "<script>var t='<p>x</p>';</script><!-- note --><style>p{}</style>"

    def article(blocks: list[str]) -> str:
        out = ""

        def block(low: int, high: int) -> str:
            blocks.append(words(low, high))
            return blocks[-1]

        if pick.random() < 0.8:
            out += f"<h1>{block(2, 12)}</h1>"
        for _ in range(pick.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            kind = pick.random()
            if kind < 0.68:
                out += f"<p>{block(3, 120)}</p>"
            elif kind < 0.74:
                out += f"<p>{block(1, 6)}</p>"
            elif kind < 0.8:
                out += f"<h{(k := pick.choice((2, 3)))}>{block(1, 6)}</h{k}>"
            elif kind < 0.86:
                out += "<ul>" + "".join(f"<li>{block(2, 15)}</li>" for _ in range(pick.randint(2, 5))) + "</ul>"
            elif kind < 0.9:
                out += f"<blockquote><p>{block(5, 40)}</p></blockquote>"
            elif kind < 0.93:
                out += "<table>" + "".join(f"<tr><td>{block(1, 4)}</td><td>{block(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
            elif kind < 0.95:
                out += f"<p><b>{block(5, 60)}<br>"
            elif kind < 0.97:
                out += f"<div>{block(5, 60)}</div>"
            else:
                out += furniture()
        if not blocks:
            out += f"<p>{block(10, 60)}</p>"
        return out

    pages, kept = [], []
    for _ in range(n):
        blocks: list[str] = []
        inner = article(blocks)
        form = pick.random()
        if form < 0.5:
            body = f"<article>{inner}</article>"
        elif form < 0.65:
            body = f"<main>{inner}</main>"
        elif form < 0.75:
            body = f"<main><article>{inner}</article>{furniture()}</main>"
        elif form < 0.95:
            body = box("div", pick.choice(("content", "post", "entry-content", "article-body", "story", "main-content", "text")), inner)
        else:
            body = f"<section>{inner}</section>"
        around = [furniture() for _ in range(pick.randint(1, 7))]
        cut = pick.randint(0, len(around))
        page = "".join(around[:cut]) + body + "".join(around[cut:])
        if pick.random() < 0.3:
            page = f'<div {pick.choice(("id=wrapper", "class=container", "class=page-wrap"))}>{page}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 4)}</title></head><body>{page}" + pick.choice(("</body></html>", "")))
        kept.append(blocks)
    return pages, kept


@functools.cache
def trained(n: int = 400, seed: int = 11) -> TreeModel:
    """The model of the labelled pages: the same on every run."""
    pages, kept = labelled_pages(n, seed)
    forest = Forest([parse(p) for p in pages])
    label = np.zeros(len(forest.parent), np.int64)
    total, inside = np.zeros(len(label)), np.zeros(len(label))
    for tree, lo, blocks in zip(forest.trees, forest.first[:-1].tolist(), kept, strict=True):
        known = {" ".join(b.split()) for b in blocks}
        for k, text in enumerate(tree.text):
            if text is not None:
                label[lo + k] = text in known
                total[lo + k], inside[lo + k] = len(text), len(text) * (text in known)
    for level in reversed(forest.levels):
        np.add.at(total, forest.parent[level], total[level])
        np.add.at(inside, forest.parent[level], inside[level])
    element = forest.group != _N_GROUPS
    label[element] = ((inside > 0.8 * total) & (total > 0) & (forest.depth > 0))[element]
    return fit(forest, label)


def extract_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """`pages` (with an html column) plus text."""
    ship(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())
    pages, names, (page,) = plain_names(pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != "text"]), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, page):
                column = Texts(part.column(page))
                texts = sent.value.texts([column.bytes(i).decode() for i in range(column.n)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return pages.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema) + ", text string").toDF(*names, "text")
