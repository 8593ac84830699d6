"""Main-text extraction by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level
tags, each with the path of its open elements. Every block is a vector: hashed
path elements (tags, classes, ids), hashed own element, hashed words, and a few
shares (links, capitals, punctuation, length, place, and how much of the page's
text the elements around it hold). A path element counts by the share of blocks
that it leaves out, so an element around the whole page says nothing, whatever
it is called. A bidirectional LSTM, in numpy, reads the whole sequence in both
directions and labels every block main text or not, so a label depends on the
whole page. Pages go through it in batches of like length, a very long one in
pieces that hand their state on.

The labeller is trained at each use on composed layouts, whose labels are known:
an article in some container, and menus, headers, footers, side bars, notices,
adverts, forms and reader comments around and in it, in wrappers of any name.
Their texts come from a bounded sample of pages (``SAMPLE_PAGES``, and
``SAMPLE_BLOCKS`` of each); a page's own names are never taken for a label.

Rows: a null or empty page has an empty text. White space and character
references are handled in blocks of any length; scripts, styles, the head and
comments are never blocks. Repeated rows are labelled each; with no pages at all
nothing is left to label. Columns ``text`` and ``n_chars`` of the input are
replaced, others are kept.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.scratch import slices
from quillspark.llm.word_hash import word_digests

#: Expected number of pages whose texts train the labeller, drawn by a hash of the id, and the texts of one page.
SAMPLE_PAGES, SAMPLE_BLOCKS = 100, 30
LAYOUTS, EPOCHS, RATE, LAST = 1600, 10, 0.02, 3
HIDDEN = 32
_PATH, _OWN, _WORDS, _SHARES = 96, 32, 16, 9
INPUTS = _PATH + _OWN + _WORDS + _SHARES
BATCH, STEP = 256, 4096
#: A page of which no block is likely to be main text gives its likeliest run of blocks, if that is likelier than this.
DOUBT = 0.1

BLOCK_TAGS = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = set("head iframe noscript object script style svg template title".split())
#: A start tag here ends an open element there.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# a quote opens a value only behind an equals sign; elsewhere it is a letter of a name
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|</?[a-zA-Z][^>]*\Z""", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Block:
    """A text and the numbers of the elements around it, outermost first."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


Element = tuple[str, tuple[str, ...], int]  # tag, names, number of the parent (-1: none)


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The leaf blocks of a page in order, and its elements."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[int] = []
    held: list[str] = []
    linked = at = 0
    in_link = False

    def close() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", unescape("".join(held))).strip()
            if text:
                out.append(Block(tuple(stack), text, min(linked, len(text))))
            held.clear()
        linked = 0

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            held.append(page[at:end])
            if in_link:
                linked += end - at
        if not m:
            break
        at, name = m.end(), m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCK_TAGS and any(elements[e][0] == tag for e in stack):
                close()
                while elements[stack.pop()][0] != tag:
                    pass
            continue
        if tag in SILENT_TAGS:
            if tag in ("head", "title") or not m[3].endswith("/"):
                if tag == "head":
                    body = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                    at = (body.start() if body[0][1] in "bB" else body.end()) if body else at
                else:
                    over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = over.end() if over else size
            held.append(" ")
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag == "a":
            in_link = True
            continue
        if tag not in BLOCK_TAGS:
            continue
        close()
        if stack and elements[stack[-1]][0] == "p":
            stack.pop()
        if tag in ENDS:
            for i in range(len(stack) - 1, -1, -1):
                if elements[stack[i]][0] in ENDS[tag]:
                    del stack[i:]
                    break
                if elements[stack[i]][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if tag not in VOID_TAGS:
            elements.append((tag, names_of(m[3]), stack[-1] if stack else -1))
            stack.append(len(elements) - 1)
    close()
    return out, elements


def names_of(attributes: str) -> tuple[str, ...]:
    """The words of an element's class, id and role."""
    return tuple(sorted({n for found in _NAMES.findall(attributes) for n in _SPLIT.split("".join(found).lower()) if n})) if attributes else ()


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


def _hashed(tokens: list[str], size: int) -> np.ndarray:
    v = np.zeros(size, np.float32)
    for t in tokens:
        for salt in "ab":  # two places each, so that no two names share both
            v[_slot(salt + t, size)] += 1
    return v


def vectors_of(blocks: list[Block], elements: list[Element], cache: dict | None = None) -> np.ndarray:
    """One input vector for each block; ``cache`` keeps the hashed vectors of elements."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    if not blocks:
        return x
    cache = {} if cache is None else cache
    if len(cache) > 100_000:
        cache.clear()
    depth = np.array([len(b.path) for b in blocks])
    inside = np.fromiter((e for b in blocks for e in b.path), np.int64, int(depth.sum()))
    length = np.array([len(b.text) for b in blocks], float)
    held = np.bincount(inside, minlength=len(elements) + 1) / len(blocks)  # share of the blocks in each element
    share = np.append(np.bincount(inside, np.repeat(length, depth), minlength=len(elements))[: len(elements)] / length.sum(), 1.0)  # of the text; the last stands for the page
    paths = np.zeros((len(elements) + 1, _PATH), np.float32)
    own = np.zeros((len(elements) + 1, _OWN), np.float32)
    branch = np.ones(len(elements) + 1)  # share of the text in the outermost element that doesn't hold nearly all
    for i, (tag, names, parent) in enumerate(elements):
        if not held[i]:
            continue
        if (v := cache.get((tag, names))) is None:
            tokens = [tag, *("." + n for n in names)]
            v = cache[tag, names] = _hashed(tokens, _PATH), _hashed(tokens, _OWN)
        paths[i] = paths[parent] + np.float32(1 - held[i]) * v[0]
        own[i] = v[1]
        branch[i] = branch[parent] if branch[parent] < 0.95 else share[i]
    last = np.array([b.path[-1] if b.path else -1 for b in blocks])
    above = np.array([elements[e][2] if e >= 0 else -1 for e in last])
    x[:, :_PATH] = np.minimum(paths[last], 3)
    x[:, _PATH : _PATH + _OWN] = own[last]
    tail = x[:, -_SHARES:]
    tail[:, 0] = np.minimum(np.log1p(length) / 8, 2)
    tail[:, 1] = [b.linked / len(b.text) for b in blocks]
    tail[:, 2] = [b.text[0].isupper() for b in blocks]
    tail[:, 3] = [b.text[-1] in ".!?…" for b in blocks]
    tail[:, 4] = np.minimum([(b.text.count(" ") + 1) / 50 for b in blocks], 2)
    tail[:, 5] = np.minimum(depth / 10, 2)
    tail[:, 6] = np.where(depth > 0, branch[last], 1)
    tail[:, 7] = share[above]
    tail[:, 8] = share[last]
    texts = [b.text.lower().encode("utf-8", "replace") + b"\n" for b in blocks]
    start, _, digest = word_digests(np.frombuffer(b"".join(texts), np.uint8))
    owner = np.searchsorted(np.cumsum([len(t) for t in texts]), start, "right")
    counts = np.bincount(owner * _WORDS + (digest % np.uint64(_WORDS)).astype(np.int64), minlength=len(blocks) * _WORDS).reshape(-1, _WORDS)
    x[:, _PATH + _OWN : -_SHARES] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output for each block.

    Both directions run side by side: arrays are time x direction x page x value, and the second direction reads every
    page from its end, so that padding follows in both.
    """

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = n = hidden
        scale = 1 / np.sqrt(INPUTS + n)
        bias = np.zeros((2, 1, 4 * n))
        bias[:, :, n : 2 * n] = 1
        made = {"w": rng.normal(0, scale, (2, INPUTS, 4 * n)), "u": rng.normal(0, scale, (2, n, 4 * n)), "b": bias, "out": rng.normal(0, scale, 2 * n), "bias": np.zeros(1)}
        self.weights = {k: v.astype(np.float32) for k, v in made.items()}
        self.slope = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), n)  # the first three gates are logistic, by tanh of the half
        self.shift = np.repeat(np.array([0.5, 0.5, 0.5, 0], np.float32), n)

    def _run(self, x: np.ndarray, state: list, kept: list | None = None) -> np.ndarray:
        """Hidden states; ``state`` (h, c) is taken up and left behind; ``kept`` gets all (gates, cells)."""
        n = self.hidden
        ahead = (np.matmul(x.transpose(1, 0, 2, 3).reshape(2, -1, INPUTS), self.weights["w"]) + self.weights["b"]).reshape(2, len(x), -1, 4 * n).transpose(1, 0, 2, 3) * self.slope
        u = self.weights["u"] * self.slope
        h, c = state
        out = np.empty((*x.shape[:3], n), np.float32)
        for t, z in enumerate(ahead):
            a = np.tanh(z + h @ u) * self.slope + self.shift
            c = a[..., n : 2 * n] * c + a[..., :n] * a[..., 3 * n :]
            h = a[..., 2 * n : 3 * n] * np.tanh(c)
            out[t] = h
            if kept is not None:
                kept.append((a, c))
        state[:] = h, c
        return out

    def _start(self, pages: int) -> list:
        return [np.zeros((2, pages, self.hidden), np.float32)] * 2

    def _output(self, both: np.ndarray) -> np.ndarray:
        z = both @ self.weights["out"] + self.weights["bias"]
        return 0.5 + 0.5 * np.tanh(z / 2)

    def probabilities_of_long(self, x: np.ndarray, step: int = STEP) -> np.ndarray:
        """The probability of main text for the blocks of one page, in pieces of ``step``: memory grows only by the hidden states."""
        both, state = np.empty((2, len(x), self.hidden), np.float32), self._start(1)
        for low in range(0, len(x), step):
            part = np.stack((x[low : low + step], x[::-1][low : low + step]), axis=1)[:, :, None]
            both[:, low : low + step] = self._run(part, state)[:, :, 0].transpose(1, 0, 2)
        return self._output(np.concatenate((both[0], both[1, ::-1]), axis=1))

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The same for pages of like length."""
        found = self._run(_padded(pages), self._start(len(pages)))
        return [self._output(np.concatenate((found[: len(v), 0, i], found[: len(v), 1, i][::-1]), axis=1)) for i, v in enumerate(pages)]

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray], adam: dict, rate: float) -> None:
        """One step of Adam on a batch, by back-propagation through time."""
        n, x, kept = self.hidden, _padded(pages), []
        found = self._run(x, self._start(len(pages)), kept)
        total = sum(map(len, labels))
        away = np.zeros_like(found)  # the loss by each hidden state
        grads = {"out": np.zeros(2 * n, np.float32), "bias": np.zeros(1, np.float32)}
        for i, y in enumerate(labels):
            both = np.concatenate((found[: len(y), 0, i], found[: len(y), 1, i][::-1]), axis=1)
            error = (self._output(both) - y) / total
            grads["out"] += error @ both
            grads["bias"] += error.sum()
            away[: len(y), 0, i] = error[:, None] * self.weights["out"][:n]
            away[: len(y), 1, i] = (error[:, None] * self.weights["out"][n:])[::-1]
        gates, cells = np.stack([a for a, _ in kept]), np.stack([c for _, c in kept])
        turn = np.concatenate((gates[..., : 3 * n] * (1 - gates[..., : 3 * n]), 1 - gates[..., 3 * n :] ** 2), axis=-1)
        squashed = np.tanh(cells)
        through = gates[..., 2 * n : 3 * n] * (1 - squashed**2)
        dz = np.empty_like(gates)
        back = np.ascontiguousarray(self.weights["u"].transpose(0, 2, 1))
        dh = dc = np.zeros_like(cells[0])
        nothing = np.zeros_like(cells[0])
        for t in range(len(x) - 1, -1, -1):
            dh = dh + away[t]
            dc = dc + dh * through[t]
            a = gates[t]
            dz[t] = np.concatenate((dc * a[..., 3 * n :], dc * (cells[t - 1] if t else nothing), dh * squashed[t], dc * a[..., :n]), axis=-1) * turn[t]
            dh, dc = dz[t] @ back, dc * a[..., n : 2 * n]
        flat = lambda v: v.transpose(1, 0, 2, 3).reshape(2, -1, v.shape[-1])
        before = np.concatenate((nothing[None], found[:-1]))
        grads |= {"w": flat(x).transpose(0, 2, 1) @ flat(dz), "u": flat(before).transpose(0, 2, 1) @ flat(dz), "b": flat(dz).sum(axis=1, keepdims=True)}
        adam["t"] = adam.get("t", 0) + 1
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            m, v = adam.get(k, (0, 0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            adam[k] = m, v
            self.weights[k] -= (rate * (m / (1 - 0.9 ** adam["t"])) / (np.sqrt(v / (1 - 0.99 ** adam["t"])) + 1e-8)).astype(np.float32)


def _padded(pages: list[np.ndarray]) -> np.ndarray:
    """Time x direction x page x input; the second direction holds every page from its end."""
    x = np.zeros((max(map(len, pages)), 2, len(pages), INPUTS), np.float32)
    for i, v in enumerate(pages):
        x[: len(v), 0, i], x[: len(v), 1, i] = v, v[::-1]
    return x


# What composed layouts are made of. The labeller sees only hashes of these, beside random names on both sides.
_MAIN = ["article", "main", "div.content", "div.post-body", "div#main", "section.story", "div.entry-content", "div", "section", "div.text", "td", "div.article-body", "div#page-text", "article.post", "div.single", "div.prose", "body.story"]
_AROUND = {
    "nav": ["nav", "div.nav", "ul.menu", "div.navigation", "div.topbar", "div.breadcrumbs", "div#menu", "nav.navbar", "div.pagination", "div.toolbar", "menu", "td.menu"],
    "header": ["header", "div.header", "div#masthead", "div.banner", "header.site-header", "div.logo"],
    "footer": ["footer", "div.footer", "div#footer", "div.copyright", "footer.site-footer", "div.bottom", "div.legal"],
    "side": ["aside", "div.sidebar", "div#secondary", "div.widget", "section.related", "div.related-posts", "div.recommended", "div.trending", "aside.widget-area", "div.rail", "td.side"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "aside.promo", "section.sponsored", "div.banner-ad", "div.sponsor", "section.advert", "p.ad", "div.promoted"],
    "notice": ["div.cookie-notice", "div.cookie-banner", "div.consent", "div.gdpr", "div.alert", "div.notice", "div.modal", "div.popup", "dialog", "section.disclaimer", "div#cookies", "p.notice"],
    "form": ["form", "form.search", "form#signup", "div.newsletter", "div.subscribe", "div.login", "fieldset", "form.contact", "section.signup"],
    "comments": ["section#comments", "div#comments", "div.comments", "section.comments", "ol.commentlist", "div.disqus", "div.replies", "section.discussion", "div.comment-list"],
    "share": ["div.share", "div.social", "ul.sharing", "div.tags", "ul.share-links", "div.share-buttons"],
}
_COMMENT = ["article.comment", "div.comment", "li.comment", "div.reply", "div.comment-body", "article", "li"]
#: How an article's text is set: most often as blocks of several tags.
_FORMS = ["mixed"] * 10 + ["lines", "lines", "lines", "divs", "divs", "items", "items", "sections", "sections", "cells"]
_JOINERS = ["with", "has", "no", "left", "is", "page", "site"]


class _Layout:
    """One composed page: blocks, elements, and which blocks are main text."""

    def __init__(self, texts: list[str], rng: random.Random):
        self.texts, self.rng = texts, rng
        self.blocks: list[Block] = []
        self.elements: list[Element] = []
        self.labels: list[bool] = []

    def element(self, kind: str, within: tuple, invent: float = 0.0) -> tuple:
        """The path into a new element, written like ``tag.name`` or ``tag#name``; its names are random ones at times."""
        tag, *names = re.split(r"[.#]", kind)
        if self.rng.random() < invent:
            tag, names = tag if self.rng.random() < 0.3 or tag in ("li", "td", "ul", "ol") else "div", [self.invented() for _ in range(self.rng.randint(0, 2))]
        if self.rng.random() < 0.15:
            names = [*names, self.invented()]
        self.elements.append((tag, tuple(sorted({n for name in names for n in _SPLIT.split(name) if n})), within[-1] if within else -1))
        return (*within, len(self.elements) - 1)

    def invented(self) -> str:
        return "".join(self.rng.choice("abcdeghiklmnoprstuvx0123") for _ in range(self.rng.randint(2, 8)))

    def misleading(self) -> str:
        """A name that tells of what else is on the page, as wrappers have it."""
        kind = self.rng.choice(_AROUND[self.rng.choice([*_AROUND])])
        return f"{self.rng.choice(_JOINERS)}-{re.split('[.#]', kind)[-1]}"

    def words(self, most: int) -> str:
        w = self.rng.choice(self.texts).split()
        at = self.rng.randrange(len(w))
        return " ".join(w[at : at + self.rng.randint(1, most)])

    def add(self, path: tuple, text: str, main: bool, linked: float = 0.0) -> None:
        self.blocks.append(Block(path, text, round(len(text) * linked)))
        self.labels.append(main)

    def around(self, kind: str, within: tuple, invent: float = 0.2) -> None:
        """One element that isn't main text, of a kind of ``_AROUND``."""
        rng = self.rng
        top = self.element(rng.choice(_AROUND[kind]), within, invent)
        if rng.random() < 0.2:
            top = self.element("div", top)
        if kind in ("nav", "share") and rng.random() < 0.12:  # links that only line breaks part
            self.add(top, " ".join(self.words(3) for _ in range(rng.randint(2, 9))), False, rng.choice([0.8, 1.0]))
        elif kind in ("nav", "share"):
            inner = rng.choice(["li", "li", "div", ""])
            listed = self.element("ul", top) if inner == "li" and self.elements[top[-1]][0] not in ("ul", "menu") else top
            for _ in range(rng.randint(1, 9)):
                self.add(self.element(inner, listed) if inner else listed, self.words(3), False, 1.0 if rng.random() < 0.8 else 0.0)
        elif kind == "comments":
            if rng.random() < 0.7:
                self.add(self.element(rng.choice(["h2", "h3", "p"]), top), self.words(3), False)
            for _ in range(rng.randint(1, 9)):
                one = self.element(rng.choice(_COMMENT), top) if rng.random() < 0.7 else top
                if rng.random() < 0.4:
                    self.add(self.element(rng.choice(["p", "div.author", "h4", "header"]), one), self.words(3), False, rng.choice([0.0, 1.0]))
                for _ in range(rng.randint(1, 2)):
                    text = rng.choice(self.texts) if rng.random() < 0.4 else self.words(25)
                    self.add(self.element("p", one) if rng.random() < 0.8 else one, text, False)
        elif kind == "form":
            for _ in range(rng.randint(1, 6)):
                self.add(self.element(rng.choice(["label", "button", "option", "legend", "p", "div", "li", "h3"]), top), self.words(rng.choice([2, 2, 12])), False)
        else:
            if kind == "side" and rng.random() < 0.6:
                self.add(self.element(rng.choice(["h2", "h3", "h4"]), top), self.words(3), False)
            listed = self.element("ul", top) if rng.random() < 0.3 else None
            for _ in range(1 if rng.random() < 0.5 else rng.randint(1, 5)):
                inner = listed and self.element("li", listed) or rng.choice([top, self.element("p", top), self.element("div", top)])
                text = self.words(4) if rng.random() < 0.4 else rng.choice(self.texts) if rng.random() < 0.4 else self.words(25)
                if kind == "footer" and rng.random() < 0.6:
                    text = f"© {self.words(2)} · {text}"
                self.add(inner, text, False, rng.choice([0.0, 0.0, 1.0]) if kind != "side" else rng.choice([0.0, 1.0]))
            if kind == "notice" and rng.random() < 0.4:
                self.add(self.element("button", top), self.words(2), False)

    def article(self, within: tuple) -> None:
        rng = self.rng
        form = rng.choice(_FORMS)
        if form == "divs":  # nothing but its place and its text tells such an article from what is around it
            body = within
            for _ in range(rng.randint(1, 3)):
                body = self.element("div", body)
        else:
            body = self.element(rng.choice(_MAIN), within, 0.3)
            for _ in range(rng.choice([0, 0, 1, 2])):
                body = self.element(rng.choice([*_MAIN, "div", "div"]), body, 0.3)
        tag, names, parent = self.elements[body[-1]]
        if form != "divs" and rng.random() < 0.25:
            self.elements[body[-1]] = tag, tuple(sorted({*names, *_SPLIT.split(self.misleading())})), parent
        if rng.random() < (0.5 if form in ("lines", "divs") else 0.85):
            at = within if rng.random() < 0.08 else body
            self.add(self.element("div" if form == "divs" and rng.random() < 0.7 else rng.choice(["h1", "h1", "h1", "h2"]), at), self.words(12), True)
        asides = rng.random() < 0.5  # in the article only names and texts tell them: few are without
        made = {"mixed": self.mixed, "lines": self.lines, "divs": self.divs, "items": self.items, "sections": self.sections, "cells": self.cells}[form]
        for _ in range(rng.choice([1, 2, 4, 8, 8, 16, 30]) if form in ("mixed", "divs") else rng.randint(1, 5) if form == "sections" else rng.choice([1, 1, 2])):
            made(body)
            if asides and rng.random() < 0.25:
                self.around(rng.choice(["ad", "ad", "side", "share", "form", "notice"]), body, 0.02)
        if asides:
            for kind in rng.sample(["share", "side", "form", "comments", "notice", "ad"], rng.randint(0, 3)):
                self.around(kind, body, 0.02)

    def prose(self) -> str:
        return self.rng.choice(self.texts) if self.rng.random() < 0.75 else self.words(self.rng.choice([2, 6, 25]))

    def mixed(self, body: tuple) -> None:
        """A block of any tag."""
        inner = self.rng.choice(["p"] * 8 + ["h2", "blockquote", "li", "pre", "", "td", "dd", "div", "figcaption"])
        path = self.element("ul", body) if inner == "li" else self.element("tr", self.element("table", body)) if inner == "td" else body
        self.add(self.element(inner, path) if inner else path, self.prose(), True, 1.0 if self.rng.random() < 0.03 else self.rng.choice([0.0] * 5 + [0.2]))

    def lines(self, body: tuple) -> None:
        """Paragraphs that only line breaks part: one block, right in the container."""
        self.add(body, " ".join(self.prose() for _ in range(self.rng.randint(1, 8))), True, self.rng.choice([0.0, 0.0, 0.1]))

    def divs(self, body: tuple) -> None:
        """A paragraph as a ``div`` without a name."""
        self.add(self.element("div", body), self.prose(), True, self.rng.choice([0.0] * 5 + [0.2]))

    def items(self, body: tuple) -> None:
        """A list of short or long items, with a paragraph before it at times."""
        rng = self.rng
        if rng.random() < 0.4:
            self.add(self.element("p", body), self.prose(), True)
        listed, most = self.element(rng.choice(["ul", "ul", "ol", "dl"]), body), rng.choice([3, 5, 12, 25])
        for _ in range(rng.randint(3, 20)):
            if self.elements[listed[-1]][0] == "dl":
                self.add(self.element("dt", listed), self.words(3), True)
            self.add(self.element("dd" if self.elements[listed[-1]][0] == "dl" else "li", listed), self.words(most), True, 1.0 if rng.random() < 0.03 else 0.0)

    def sections(self, body: tuple) -> None:
        """A section, with a heading at times."""
        part = self.element(self.rng.choice(["section", "section", "div", "article"]), body)
        if self.rng.random() < 0.5:
            self.add(self.element(self.rng.choice(["h2", "h3"]), part), self.words(6), True)
        for _ in range(self.rng.choice([1, 1, 2, 4])):
            self.add(self.element("p", part), self.prose(), True)

    def cells(self, body: tuple) -> None:
        """A table, between paragraphs at times."""
        rng = self.rng
        for _ in range(rng.choice([0, 1, 3])):
            self.add(self.element("p", body), self.prose(), True)
        table, columns = self.element("table", body), rng.randint(2, 4)
        if rng.random() < 0.3:
            self.add(self.element("caption", table), self.words(6), True)
        for row in range(rng.randint(2, 7)):
            line = self.element("tr", table)
            for _ in range(columns):
                self.add(self.element("th" if row == 0 and rng.random() < 0.8 else "td", line), self.words(rng.choice([1, 2, 4, 12])), True)
        for _ in range(rng.choice([0, 1, 3])):
            self.add(self.element("p", body), self.prose(), True)


def composed(texts: list[str], rng: random.Random) -> _Layout:
    """A layout of known labels: an article (seldom none) with other elements around it, inside wrappers of any name."""
    page = _Layout(texts, rng)
    outer = page.element("body", page.element("html", ())) if rng.random() < 0.8 else ()
    for _ in range(rng.choice([0, 0, 1, 2])):
        outer = page.element(rng.choice(["div", "div.wrapper", "div#page", "form", "form#main-form", "main", "section", "div.container", "center", "td"]), outer, 0.2)
    for e in outer:
        tag, names, parent = page.elements[e]
        if tag != "html" and rng.random() < 0.45:
            page.elements[e] = tag, tuple(sorted({*names, *(n for _ in range(rng.randint(1, 3)) for n in _SPLIT.split(page.misleading()))})), parent
    for kind in [k for k in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < 0.4]:
        page.around(kind, outer)
    if rng.random() < 0.95:
        page.article(outer)
    for kind in [k for k in ("ad", "share", "comments", "side", "form", "nav", "notice") if rng.random() < 0.22] + (["footer"] if rng.random() < 0.7 else []):
        page.around(kind, outer)
    return page


def train(texts: list[str], seed: int = 7, layouts: int = LAYOUTS, epochs: int = EPOCHS, batch: int = 16) -> Labeller:
    """A labeller trained on composed layouts of these texts (made-up words, if there are none)."""
    model, rng = Labeller(seed), random.Random(seed)
    texts = [t for t in texts if t.split()] or [" ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(2, 60))) + "." for _ in range(200)]
    pages = [composed(texts, rng) for _ in range(layouts)]
    data = sorted(((vectors_of(p.blocks, p.elements), np.array(p.labels, np.float32)) for p in pages if p.blocks), key=lambda d: len(d[1]))
    parts = [data[low : low + batch] for low in range(0, len(data), batch)]  # like lengths, so that little is padded
    adam: dict = {}
    mean, steps = {k: np.zeros_like(w) for k, w in model.weights.items()}, 0  # of the last epochs' steps, so that no single batch decides
    for epoch in range(epochs):
        rng.shuffle(parts)
        for part in parts:
            model.step([x for x, _ in part], [y for _, y in part], adam, RATE if epoch < epochs - LAST else RATE / 4)
            if epoch >= epochs - LAST:
                mean, steps = {k: m + model.weights[k] for k, m in mean.items()}, steps + 1
    if steps:
        model.weights = {k: m / np.float32(steps) for k, m in mean.items()}
    return model


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """Train with texts of about ``sample_pages`` pages of any length, drawn by a hash of ``key``; the driver gets ``SAMPLE_BLOCKS`` blocks of each."""
    rows = pages.where(F.length(html) > 0)
    share = int(min(1.0, sample_pages / max(rows.count(), 1)) * (1 << 30))

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, page in zip(pdf["key"], pdf[html]):
                blocks, _ = blocks_of(page)
                every = max(1, len(blocks) // SAMPLE_BLOCKS)
                yield pd.DataFrame({"key": k, "text": [b.text[:2000] for b in blocks[::every]][:SAMPLE_BLOCKS]})

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    drawn = rows.where(F.pmod(F.xxhash64(name, F.lit(6)), F.lit(1 << 30)) < share).groupBy(name.alias("key")).agg(F.min(html).alias(html))  # one of each id
    return train(sorted(r.text for r in drawn.mapInPandas(some, "key string, text string").collect()))


def texts_of(pages: list[str], model: Labeller) -> list[str]:
    """Main texts: the blocks that the labeller keeps, joined by line ends."""
    cache: dict = {}
    out, ready = [""] * len(pages), []
    for i, page in enumerate(pages):
        blocks, elements = blocks_of(page)
        if not blocks:
            continue
        x = vectors_of(blocks, elements, cache)
        if len(blocks) > STEP:
            out[i] = _kept(blocks, model.probabilities_of_long(x))
        else:
            ready.append((i, blocks, x))
    ready.sort(key=lambda r: len(r[1]))
    while ready:
        part = ready[-max(1, min(BATCH, 20_000 // len(ready[-1][1]))) :]
        del ready[-len(part) :]
        for (i, blocks, _), p in zip(part, model.probabilities([x for _, _, x in part])):
            out[i] = _kept(blocks, p)
    return out


def _kept(blocks: list[Block], p: np.ndarray) -> str:
    """The texts of the blocks above a half; if there are none, of those around the likeliest one, if it is above ``DOUBT``."""
    keep = p > 0.5
    if not keep.any() and p.max() > DOUBT:
        near = p > max(DOUBT, p.max() / 2)
        top = int(p.argmax())
        run = np.cumsum(np.diff(near, prepend=False))
        keep = near & (run == run[top])
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, model: Labeller, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages = [p if isinstance(p, str) else "" for p in pdf[html]]
            for low, high in slices(pages, 4_000_000):
                part = pdf.iloc[low:high]
                texts = texts_of(pages[low:high], model)
                yield part.drop(columns=html).assign(text=texts, n_chars=[len(t) for t in texts])

    pages = pages.drop(*{"text", "n_chars"} - {html})
    return pages.mapInPandas(run, pages.drop(html).schema.add("text", "string").add("n_chars", "long"))
