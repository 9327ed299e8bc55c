"""Main text of HTML pages: a recurrent labeller over each page's sequence of leaf blocks.

A page becomes its blocks, the runs of text between block-level tags, in page order.  Every block has a vector of its
hashed tag path (names, classes and ids on the way down), of its hashed words, and of a few figures (length, share of
link text, marks).  A bidirectional LSTM in numpy reads the whole sequence and labels each block as article or not, so
that a block is judged by what stands before and after it in the document.

It is trained when a table is extracted: on a bounded sample of the table's pages, labelled by rules where their
structure says enough, and on pages made from the sample's texts in other layouts with known labels.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import Words, text_pieces

#: Pages of the table that the labeller learns from, at most (those of the smallest hash), and blocks of a training sequence: a longer page is several.
TRAIN_PAGES = 240
TRAIN_BLOCKS = 60
PATH_SIZE, WORD_SIZE, FIGURES, HIDDEN = 96, 48, 6, 16
#: Entries of the path memo before it is emptied, and blocks that one pass of the network holds.
MEMO, PASS_BLOCKS = 50_000, 60_000

#: Fixed values of HTML: elements within a line, without end tag, and whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What may stand in a head; any other tag ends it.
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
UNSEEN = frozenset("head template textarea select iframe object svg math noframes".split())
#: Words in tag names, classes and ids that tell article and boilerplate apart in the rule labels.
ARTICLE_HINTS = ("article", "main", "articlebody", "post-body", "entry-content", "story")
OTHER_HINTS = ("nav", "menu", "footer", "header", "aside", "sidebar", "ad", "ads", "advert", "promo", "sponsored", "banner", "cookie", "notice", "consent", "popup", "form", "newsletter", "subscribe", "comment", "comments", "reply", "related", "share", "social", "breadcrumb", "widget")
_HINTS = frozenset(ARTICLE_HINTS + OTHER_HINTS)
#: Layouts of made pages, as (tag, class or id).
ARTICLE_BOXES = (("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("section", "story"), ("div", "article"), ("article", "post"), ("div", "main"))
OTHER_BOXES = (
    ("nav", ""), ("nav", "menu"), ("header", ""), ("header", "site-header"), ("div", "header"), ("footer", ""), ("div", "footer"), ("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "promo"), ("div", "sponsored"),
    ("div", "cookie-notice"), ("div", "notice"), ("div", "consent"), ("form", ""), ("form", "newsletter"), ("div", "subscribe"), ("section", "comments"), ("div", "comment"), ("div", "related"), ("div", "share"), ("ul", "breadcrumb"), ("div", "banner"), ("div", "menu"), ("div", "widget"),
)
FILLER = "the of and a to in is it that was for on are with as be this by at from or an have not but they which you were her all she there would their we him been has when who will more no if out so".split()

#: Elements whose content up to their end tag is no markup.
RAW = frozenset("script style noscript xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Innermost open elements that a block's path names in full.
PATH_DEPTH = 64

_OPEN = re.compile("<(?=[a-zA-Z/!?])")
#: A tag as browsers read it: names end at white space, / and >; a value is quoted only if the quote comes right behind =.  No part gives back what it took.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+)*+)>""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|$)", re.I) for name in RAW}
_MARKS = re.compile(r"""(?<![^\s/])(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))""", re.I)


@dataclass
class Block:
    path: tuple[str, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        raw = "".join(self.parts)
        return " ".join((html.unescape(raw) if "&" in raw else raw).split())


def _words_of(attrs: str) -> tuple[str, ...]:
    return tuple(x.lower() for m in _MARKS.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").split())


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, tag, whether it ends one, attributes), the text standing before the tag; the tag is empty for text alone.

    One pass: every character is looked at a bounded number of times.  Comments, declarations and raw elements are passed
    over; one that never ends takes the rest of the page, as a tag does.
    """
    at = start = 0
    while (m := _OPEN.search(page, at)) is not None:
        at = m.start()
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            comment = page.startswith("<!--", at)
            close = "-->" if comment else "]]>"
            end = page.find(close, at + (4 if comment else 9))
            inner = "" if comment else html.escape(page[at + 9 : end if end >= 0 else len(page)])
            yield page[start:at] + inner, "", False, ""
            if end < 0:
                return
            at = start = end + 3
        elif page[at + 1] in "!?" or (page[at + 1] == "/" and not page[at + 2 : at + 3].isalpha()):
            yield page[start:at], "", False, ""
            end = page.find(">", at)
            if end < 0:
                return
            at = start = end + 1
        else:
            tag = _TAG.match(page, at)
            if tag is None:
                # letters of other alphabets begin no tag; a tag that the page's end cut off is none
                if not page[at + 1 : at + 3].lstrip("/")[:1].isascii():
                    at += 1
                    continue
                yield page[start:at], "", False, ""
                return
            name = tag[2].lower()
            yield page[start:at], name, bool(tag[1]), tag[3]
            at = start = tag.end()
            if name in RAW and not tag[1]:
                end = _RAW_END[name].search(page, at)
                if end is None:
                    return
                at = start = end.end()
                yield "", name, True, ""
    yield page[start:], "", False, ""


class _Open:
    """The open elements, with what is asked about them kept at hand."""

    def __init__(self):
        self.names: list[str] = []
        self.words: list[tuple[str, ...]] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []  # places of elements that are no inline ones
        self.walls: list[int] = []  # those of them that are no headings either
        self.told: list[frozenset[str]] = []  # of each of them and those around it: the names and words that tell article and boilerplate apart
        self.unseen = self.links = 0

    def push(self, name: str, words: tuple[str, ...]) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.solid.append(len(self.names))
            around, own = self.told[-1] if self.told else frozenset(), _HINTS.intersection((name, *words))
            self.told.append(around if own <= around else around | own)
            if name not in HEADINGS:
                self.walls.append(len(self.names))
        self.names.append(name)
        self.words.append(words)
        self.unseen += name in UNSEEN
        self.links += name == "a"

    def cut(self, depth: int) -> None:
        """Closes the elements from ``depth`` on."""
        while len(self.names) > depth:
            name = self.names.pop()
            self.words.pop()
            self.places[name].pop()
            if self.solid and self.solid[-1] == len(self.names):
                self.solid.pop()
                self.told.pop()
            if self.walls and self.walls[-1] == len(self.names):
                self.walls.pop()
            self.unseen -= name in UNSEEN
            self.links -= name == "a"

    def last(self, name: str) -> int:
        at = self.places.get(name)
        return at[-1] if at else -1

    def path(self) -> tuple[str, ...]:
        """Of the innermost elements all names and words, before them what tells article and boilerplate apart of the others."""
        inner = tuple(x for k in self.solid[-PATH_DEPTH:] for x in (self.names[k], *self.words[k]))
        return (*sorted(self.told[-PATH_DEPTH - 1]), *inner) if len(self.solid) > PATH_DEPTH else inner


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of link text) of each block with any text.

    A path lists the open elements' names, each followed by its class and id words.  Wrong nesting is mended as browsers
    do for the common cases: a block closes an open paragraph, an end tag closes what it finds open, else nothing.
    """
    stack, found = _Open(), []
    now: Block | None = None

    def text(raw: str) -> None:
        nonlocal now
        if stack.unseen or not raw:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(stack.path())
            found.append(now)
        now.parts.append(raw)
        if stack.links:
            now.linked += len(raw)

    for before, tag, ends, attrs in tokens(page):
        text(before)
        if not tag:
            continue
        if tag == "br":
            text(" ")
        elif tag not in INLINE:
            now = None
        if ends:
            depth = stack.last(tag)
            if depth >= 0 and not (tag in INLINE and stack.solid and stack.solid[-1] > depth):
                stack.cut(depth)
            continue
        if tag not in IN_HEAD and stack.last("head") > stack.last("template"):
            stack.cut(stack.last("head"))
        if tag in VOID:
            continue
        if tag not in INLINE and stack.walls:
            closes = (tag,) if tag in ("li", "dt", "dd", "tr", "option") else ("td", "th") if tag in ("td", "th") else ("p",)
            if stack.names[stack.walls[-1]] in closes:
                stack.cut(stack.walls[-1])
        if tag == "body":
            if stack.last("body") >= 0:  # a second one only adds attributes to the first
                continue
            stack.cut(stack.last("html") + 1)
        if attrs.endswith("/") and tag in ("svg", "math"):
            continue
        stack.push(tag, _words_of(attrs) if "=" in attrs else ())
    return [(b.path, t, b.linked / max(1, sum(map(len, b.parts)))) for b in found if (t := b.text())]


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


class Vectors:
    """Block vectors; what a path gives is kept in a memo of bounded size."""

    def __init__(self):
        self.memo: dict[tuple[str, ...], np.ndarray] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        v = self.memo.get(path)
        if v is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            v = np.zeros(PATH_SIZE, np.float32)
            for depth, x in enumerate(reversed(path)):
                for part in {x, *re.split(r"[-_]", x)}:
                    v[_bucket(part, PATH_SIZE)] += 1.0 if depth < 12 else 0.5
            v = self.memo[path] = np.minimum(v, 1.5)
        return v

    def of(self, found: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
        """(blocks, PATH_SIZE + WORD_SIZE + FIGURES)"""
        n = len(found)
        if not n:
            return np.zeros((0, PATH_SIZE + WORD_SIZE + FIGURES), np.float32)
        w = Words(pa.array([t for _, t, _ in found], pa.string()))
        bag = np.bincount(w.doc * WORD_SIZE + (w.hashes() % np.uint64(WORD_SIZE)).astype(np.int64), minlength=n * WORD_SIZE).reshape(n, WORD_SIZE)
        bag = np.sqrt(bag / np.maximum(w.count, 1)[:, None])
        size = np.diff(w.off)
        marks = np.concatenate([[0], np.cumsum((w.raw == 46) | (w.raw == 44))])
        marked = (marks[w.off[1:]] - marks[w.off[:-1]]) / np.maximum(w.count, 1)
        figures = np.stack([np.log1p(w.count) / 5, np.log1p(size) / 8, [x for _, _, x in found], marked, w.count < 4, w.count > 30], axis=1)
        return np.concatenate([np.stack([self.path(p) for p, _, _ in found]), bag, figures], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM and a linear output, with training by back-propagation through time and Adam."""

    def __init__(self, seed: int = 11):
        r, d, h = np.random.default_rng(seed), PATH_SIZE + WORD_SIZE + FIGURES, HIDDEN
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = r.normal(0, 0.15, (d, 4 * h))
            self.w[f"h{side}"] = r.normal(0, 0.2, (h, 4 * h))
            self.w[f"c{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.w["o"], self.w["p"] = r.normal(0, 0.2, (2 * h, 1)), np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, side: str, keep: bool):
        """States of one direction over x (steps, pages, inputs); the backward side gets its pages turned round."""
        n, b, _ = x.shape
        z = x.reshape(n * b, -1) @ self.w[f"x{side}"] + self.w[f"c{side}"]
        z = z.reshape(n, b, -1)
        h = c = np.zeros((b, HIDDEN), np.float32)
        out, saved = np.empty((n, b, HIDDEN), np.float32), []
        for t in range(n):
            g = z[t] + h @ self.w[f"h{side}"]
            i, f, o = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN])
            u = np.tanh(g[:, 3 * HIDDEN :])
            last, c = c, f * c + i * u
            s = np.tanh(c)
            if keep:
                saved.append((h, last, i, f, o, u, s))
            h = o * s
            out[t] = h
        return out, saved

    def _back(self, x: np.ndarray, side: str, saved: list, d_out: np.ndarray, grads: dict) -> None:
        n, b, d = x.shape
        dz = np.empty((n, b, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        dw = np.zeros_like(self.w[f"h{side}"])
        for t in range(n - 1, -1, -1):
            h, last, i, f, o, u, s = saved[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - s * s)
            dz[t] = np.concatenate([dc * u * i * (1 - i), dc * last * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            dw += h.T @ dz[t]
            dh, dc = dz[t] @ self.w[f"h{side}"].T, dc * f
        flat = dz.reshape(n * b, -1)
        grads[f"x{side}"], grads[f"h{side}"], grads[f"c{side}"] = x.reshape(n * b, d).T @ flat, dw, flat.sum(0)

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps, pages, inputs), where each step stands when a page is turned round, and which steps are real."""
        size = np.array([len(p) for p in pages])
        n = size.max()
        x = np.zeros((n, len(pages), pages[0].shape[1]), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k] = p
        step = np.arange(n)[:, None]
        real = step < size
        return x, np.where(real, size - 1 - step, step), real

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The share of article for each block of each page; pages of like length go through together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if len(p)), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(pages[order[to]]) <= PASS_BLOCKS:
                to += 1
            part = [pages[k] for k in order[at:to]]
            x, turn, _ = self._padded(part)
            cols = np.arange(len(part))
            hf, _ = self._run(x, "f", False)
            hb, _ = self._run(x[turn, cols], "b", False)
            z = _sigmoid(np.concatenate([hf, hb[turn, cols]], axis=2) @ self.w["o"] + self.w["p"])[:, :, 0]
            for j, k in enumerate(order[at:to]):
                out[k] = z[: len(pages[k]), j]
            at = to
        return out

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], steps: int = 160, batch: int = 16, rate: float = 0.015, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = r.integers(0, len(pages), batch)
            part = []
            for k in pick:
                p = pages[k].copy()
                p[:, :PATH_SIZE] *= r.random((1, PATH_SIZE)) > 0.12  # no one name may decide alone
                part.append(p)
            x, turn, real = self._padded(part)
            cols = np.arange(batch)
            y = np.zeros(real.shape, np.float32)
            for j, k in enumerate(pick):
                y[: len(labels[k]), j] = labels[k]
            hf, sf = self._run(x, "f", True)
            xb = x[turn, cols]
            hb, sb = self._run(xb, "b", True)
            both = np.concatenate([hf, hb[turn, cols]], axis=2)
            p = _sigmoid(both @ self.w["o"] + self.w["p"])[:, :, 0]
            dz = ((p - y) * real / real.sum()).astype(np.float32)[:, :, None]
            grads = {"o": both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), "p": dz.sum((0, 1))}
            d = dz @ self.w["o"].T
            self._back(x, "f", sf, d[:, :, :HIDDEN], grads)
            self._back(xb, "b", sb, d[:, :, HIDDEN:][turn, cols], grads)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= (rate * (1 - step / steps * 0.9) * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def rule_labels(found: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray | None:
    """1 for blocks inside an article element, 0 for the others and for boilerplate within it; None if there is no article."""
    out = np.zeros(len(found), np.float32)
    for k, (path, _, _) in enumerate(found):
        inside = [i for i, x in enumerate(path) if x in ARTICLE_HINTS]
        after = path[inside[0] :] if inside else ()
        out[k] = bool(inside) and not any(part in OTHER_HINTS for x in after for part in (x, *re.split(r"[-_]", x)))
    return out if out.any() else None


def _made_page(r: np.random.Generator, texts: list[str], short: list[str]) -> str:
    """A page in a random layout: HTML whose article is a run of <p>, and everything else boilerplate."""
    pick = lambda options: options[int(r.integers(len(options)))]
    body: list[str] = []

    def box(kind: tuple[str, str], inner: str) -> str:
        name, word = kind
        mark = f' {"id" if r.random() < 0.3 else "class"}="{word}"' if word else ""
        return f"<{name}{mark}>{inner}</{name}>"

    def other() -> str:
        kind = pick(OTHER_BOXES)
        if kind[0] in ("nav", "ul") or r.random() < 0.25:
            inner = "<ul>" * (kind[0] != "ul") + "".join(f'<li><a href="/x">{pick(short)}</a></li>' for _ in range(int(r.integers(2, 9)))) + "</ul>" * (kind[0] != "ul")
        elif kind[1] in ("comments", "comment") or r.random() < 0.35:
            inner = "".join(f"<p>{pick(texts)}</p>" for _ in range(int(r.integers(1, 4))))
        else:
            inner = pick(short) if r.random() < 0.6 else f"<p>{pick(texts)[:160]}</p>"
        return box(kind, inner)

    for _ in range(int(r.integers(1, 5))):
        body.append(other())
    article = f"<h1>{pick(short)}</h1>" * (r.random() < 0.8)
    for _ in range(int(r.integers(1, 14))):
        tag = pick(("p", "p", "p", "p", "blockquote", "h2", "li"))
        article += f"<{tag}>{pick(texts) if tag in ('p', 'blockquote', 'li') else pick(short)}</{tag}>"
        if r.random() < 0.06:
            article += other()
    body.append(box(pick(ARTICLE_BOXES), article))
    for _ in range(int(r.integers(1, 5))):
        body.append(other())
    inner = "".join(body)
    if r.random() < 0.5:
        inner = box(("div", pick(("wrapper", "page", "container", "site"))), inner)
    return f"<html><body>{inner}</body></html>"


def _path_labels(found: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """Labels of a made page by its boxes: the innermost box on the path that is one or the other decides."""
    good, bad = ({x for kind in boxes for x in kind if x and x not in ("div", "section", "ul")} for boxes in (ARTICLE_BOXES, OTHER_BOXES))
    out = np.zeros(len(found), np.float32)
    for k, (path, _, _) in enumerate(found):
        for x in reversed(path):
            if x in bad:
                break
            if x in good:
                out[k] = 1
                break
    return out


def fit(pages: DataFrame, column: str = "html", limit: int = TRAIN_PAGES) -> Labeller:
    """A labeller for the table; at most ``limit`` of its pages, whole, come to the driver."""
    key = F.xxhash64(column)
    # the bound on the hash first, so that no task sends pages which others replace
    bound = pages.where(F.col(column).isNotNull()).select(key.alias("k")).distinct().orderBy("k").limit(limit).agg(F.max("k")).first()[0]
    some = pages.where(F.col(column).isNotNull() & (key <= bound)) if bound is not None else pages.limit(0)
    some = some.select(F.col(column).alias("h"), key.alias("k")).dropDuplicates(["k"]).orderBy("k")
    seen = [blocks(r.h) for r in some.collect()]  # a page that is there more than once counts once
    made, labels = [], []
    texts, short = [], []
    for found in seen:
        y = rule_labels(found)
        if y is not None:
            made.append(found)
            labels.append(y)
        for (_, t, _), good in zip(found, y if y is not None else [0] * len(found)):
            (texts if good and len(t) > 80 else short).append(t)
    r = np.random.default_rng(3)
    while len(texts) < 200:
        texts.append(" ".join(r.choice(FILLER, int(r.integers(15, 60)))).capitalize() + ".")
    while len(short) < 100:
        short.append(" ".join(r.choice(FILLER, int(r.integers(1, 5)))))
    for _ in range(max(160, len(made))):
        found = blocks(_made_page(r, [html.escape(t) for t in texts], [html.escape(t) for t in short]))
        made.append(found)
        labels.append(_path_labels(found))
    vectors, labeller = Vectors(), Labeller()
    cut = [(vectors.of(f[k : k + TRAIN_BLOCKS]), y[k : k + TRAIN_BLOCKS]) for f, y in zip(made, labels) for k in range(0, len(f), TRAIN_BLOCKS)]
    labeller.train([x for x, _ in cut], [y for _, y in cut])
    return labeller


def extract(pages: DataFrame, labeller: Labeller, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text string and n_chars long of every page."""
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in text_pieces(batches, column):
            found = [blocks(x.as_py() or "") for x in batch.column(batch.schema.get_field_index(column))]
            flat = vectors.of([b for f in found for b in f])
            ends = np.cumsum([len(f) for f in found])
            scores = labeller.scores(np.split(flat, ends[:-1]))
            texts = [" ".join(t for (_, t, _), s in zip(f, y) if s >= 0.5) for f, y in zip(found, scores)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


def op8_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null html is an empty page, and a page without article blocks has an empty text.  Pages are read one by one and
    whole, so repeated rows and ids, ties and clashing columns change nothing.  No pages: no rows.
    """
    return extract(pages, fit(pages))
