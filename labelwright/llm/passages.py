"""Substring dedup: near-duplicate passages by compact windows.

Tokens are the hashes of a text's 5-word shingles.  Under one hash function, the Cartesian tree over a text's tokens
gives each token c the widest window (l, c, r) of which it has the least value: every run of tokens from [l, c] to
[c, r] has c as its min-hash.  Only windows of at least ``LEAST_WORDS`` words matter, about two for each such length of
text; they are found as the distinct minima of a sliding window, and a stack over those gives the tree's exact spans.

Windows of different texts with one min-hash meet by one shuffle on (function, min-hash).  Those whose key stands in one
text only are passed over; the others get the tokens about their place, so that texts are compared where they meet.  Two
texts run alike there if a run of ``LEAST_WORDS`` words over the place has, in both, a weighted Jaccard similarity of
``SIMILARITY`` over shingles, which is worked out exactly.  One meeting under any function is enough, so a passage of
just that similarity and length is met with probability 1 - (1 - SIMILARITY) ** FUNCTIONS, a longer one in more places,
and one that is equal always.

Within a group all texts are laid against the first.  What is then still apart meets by a prefix filter: such a run
covers the ``SIDE`` tokens left or right of the place but for ``MISSED`` of them, so two texts that are alike share one of
any ``MISSED`` + 1; the rarest of the group are looked for.  Nothing is lost by it.  Where even those are common, each text
outside the largest class is laid against the texts of other classes that have enough tokens in common with it, which are counted.

Equal texts are one text throughout, known by two 64-bit digests of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwright.llm.common import Words, arrow_rows, checkpointed, few, freed, mix64, text_pieces
from labelwright.llm.decontaminate import BITMAP_BITS, bitmap
from labelwright.llm.graph import components
from labelwright.llm.simhash import spanning, with_least

LEAST_WORDS = 50
SIMILARITY = 0.8
FUNCTIONS = 4
WIDTH = 5
#: Windows of a group that meet in one task, and texts up to which a passage's pairs are counted one by one.
CHUNK, COMMON = 1024, 64
#: Chunks of a key from which on several go together, and how many at most.
APART, MERGED = 8, 4
#: Rows that go to Python at once: texts with all their tokens, or windows with those about their place.
PYTHON_ROWS = 500
#: Parts of the keys that meet one after the other: the shuffles of one part, most of the disk that is needed, are gone before the next.
TURNS = 2
_SPAN = LEAST_WORDS - WIDTH + 1
_REACH = _SPAN - 1
#: Tokens that two runs of the least length must share.
NEED = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * _SPAN - 1e-9))
#: Tokens on the longer side of a run's place, and how many of them the other text may lack.
SIDE, MISSED = _SPAN // 2, _SPAN - NEED
#: Pairs that are compared at once, and candidates for each text of a group up to which they are listed.
_PART, _LISTED = 2048, 64
#: Runs that are compared token by token at once.
_RUNS = 8192
#: Rows whose tokens are counted against a group's at once, and holders of a token from which on they are counted in a table.
_BLOCK, _OFTEN = 512, 16
_LOW = np.uint64((1 << 20) - 1)


def _least(v: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each run of ``span`` values."""
    width = 1
    while 2 * width <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return v if width == span else np.minimum(v[: len(v) - (span - width)], v[span - width :])


def compact_windows(tokens: np.ndarray, first: np.ndarray, size: np.ndarray, function: int, span: int = _SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of every compact window of at least ``span`` tokens; texts are tokens[first : first + size].

    Of equal tokens within a window c is the first, and windows that touch with one least value are one.
    """
    if len(tokens) < span:
        return (np.zeros(0, np.int64),) * 3
    place = np.arange(len(tokens), dtype=np.uint64)
    v = (mix64(tokens + np.uint64(0x9E3779B97F4A7C15 * (function + 1) % (1 << 64))) & ~_LOW) | (place & _LOW)
    low = _least(v, span)
    text = np.repeat(np.arange(len(size)), size)[: len(low)]
    start = np.flatnonzero(np.arange(len(low)) + span <= (first + size)[text])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    lowest, text = low[start], text[start]
    value = lowest >> np.uint64(20)
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    l, r = start[at], start[np.concatenate([at[1:], [len(start)]]) - 1] + span - 1
    value, text = value[at], text[at]
    c = l + ((lowest[at] & _LOW).astype(np.int64) - l) % (1 << 20)
    # the sliding window sees span - 1 tokens beside c; where it saw no end, the nearest smaller minimum is the end
    left, right = first[text], (first + size)[text] - 1
    stack: list[int] = []
    values, texts, cs = value.tolist(), text.tolist(), c.tolist()
    open_l, open_r = l == c - span + 1, r >= c + span - 1
    for i in range(len(cs)):
        while stack and (texts[stack[-1]] != texts[i] or values[stack[-1]] > values[i]):
            j = stack.pop()
            if texts[j] == texts[i]:
                right[j] = cs[i] - 1
        if stack:
            left[i] = cs[stack[-1]] + 1
        stack.append(i)
    return np.where(open_l, left, l), c, np.where(open_r, right, r)


class Tokens:
    """Shingle tokens of a text column: ``tokens``, ``first`` and ``size`` of each row's, each row's digest and number of words.

    ``twins``: sorted digests that different texts share; theirs are made from a second digest too.
    """

    def __init__(self, col: pa.Array, twins: np.ndarray | None = None):
        w = Words(col)
        h = w.hashes()
        at, s = w.shingles(WIDTH, h)
        self.words = w.count
        self.size = np.maximum(w.count - WIDTH + 1, 0)
        whole = np.repeat(w.count >= WIDTH, np.maximum(self.size, (w.count > 0).astype(np.int64)))
        self.tokens = s[whole]
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.node = digests(w, twins=twins)[0]


def digests(w: Words, h: np.ndarray | None = None, twins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each text; ``h``, the hashes of its words, is not needed."""
    node, check = w.digests()
    if twins is not None and len(twins):
        odd = np.isin(node.astype(np.int64), twins)
        node[odd] = mix64(node[odd] ^ check[odd])
    return node.astype(np.int64), check.astype(np.int64)


def _keys(t: Tokens) -> list[np.ndarray]:
    """key, node, place of the least token in its text: a row for each compact window of the texts under each function."""
    held = []
    for f in range(FUNCTIONS):
        _, c, _ = compact_windows(t.tokens, t.first, t.size, f)
        row = np.searchsorted(t.first, c, "right") - 1
        held.append([mix64(t.tokens[c] ^ np.uint64(f + 1)).astype(np.int64), t.node[row], c - t.first[row]])
    return [np.concatenate(x) for x in zip(*held)]


def _distinct(cols: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort(cols[::-1])
    cols = [x[order] for x in cols]
    new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in cols], axis=0)]) if len(order) else np.zeros(0, bool)
    return [x[new] for x in cols]


#: Windows that a task holds before it sends on the different ones.
_BATCH = 150_000


def _longs(cols: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.int64)) for x in cols], names=names)


def texts(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """id, node, check, words of every row: ``doc``, two digests of the words, their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            w = Words(batch.column(batch.schema.get_field_index(text)))
            cols = [batch.column(batch.schema.get_field_index(doc)), *map(pa.array, digests(w)), pa.array(w.count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "node", "check", "words"])

    return docs.select(doc, text).mapInArrow(run, f"id {docs.schema[doc].dataType.simpleString()}, node long, check long, words long")


def second_node(node, check):  # noqa: ANN001, ANN201
    """``digests`` of texts among the twins, as a column."""

    @F.pandas_udf("long")
    def mixed(a, b):  # noqa: ANN001, ANN202
        return pd.Series(mix64(a.to_numpy().astype(np.uint64) ^ b.to_numpy().astype(np.uint64)).astype(np.int64))

    return mixed(node, check)


def shared_twins(rows: DataFrame) -> np.ndarray:
    """Digests that different texts share, ascending: a few of any number of texts (two of a thousand million with a chance of 0.03)."""
    same = rows.groupBy("node").agg((F.min("check") != F.max("check")).alias("differ")).where("differ").select("node")
    found = [r.node for r in same.limit(100_001).collect()]
    if len(found) > 100_000:
        raise ValueError("digests of texts collide too often")
    return np.sort(np.array(found, np.int64))


def windows(docs: DataFrame, text: str, twins: np.ndarray) -> DataFrame:
    """key, node, c (place of the least token) of every compact window; copies within a part of a task are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        kept = 0
        for batch in text_pieces(batches, text):
            held.append(_keys(Tokens(batch.column(batch.schema.get_field_index(text)), twins)))
            kept += len(held[-1][0])
            if kept > _BATCH:
                yield _longs(_distinct([np.concatenate(x) for x in zip(*held)]), ["key", "node", "c"])
                held, kept = [], 0
        if held:
            yield _longs(_distinct([np.concatenate(x) for x in zip(*held)]), ["key", "node", "c"])

    return docs.select(text).mapInArrow(run, "key long, node long, c long")


def shared(rows: DataFrame) -> DataFrame:
    """Of ``windows``, each once, those whose key stands in several texts, with chunk: the key's windows counted off by ``CHUNK``.

    A key's windows pass by in order; only those of its first text are held back, until a second one shows.
    """
    rows = rows.repartition("key").sortWithinPartitions("key", "node", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # windows of the key at the end of what was seen, of one text so far
        going, n, last = None, 0, None  # a key of several texts that may go on, how many it had, and its last window
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, c = (np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held))
            new = np.concatenate([[last is None or (key[0], node[0], c[0]) != last], (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (c[1:] != c[:-1])])
            key, node, c = key[new], node[new], c[new]
            if not len(key):
                continue
            start, size = _groups(key)
            several = np.logical_or.reduceat(np.concatenate([[False], (node[1:] != node[:-1]) & (key[1:] == key[:-1])]), start)
            before = np.zeros(len(start), np.int64)
            if key[0] == going:
                several[0], before[0] = True, n
            keep = np.repeat(several, size)
            rank = np.arange(len(key)) - np.repeat(start - before, size)
            if keep.any():
                yield _longs([key[keep], node[keep], c[keep], rank[keep] // CHUNK], ["key", "node", "c", "chunk"])
            at = start[-1]
            if several[-1]:
                held, going, n, last = [np.zeros(0, np.int64)] * 3, key[-1], int(rank[-1]) + 1, (key[-1], node[-1], c[-1])
            else:
                held, going, n, last = [key[at:], node[at:], c[at:]], None, 0, None

    return rows.mapInArrow(run, "key long, node long, c long, chunk long")


def contents(docs: DataFrame, bits: np.ndarray, text: str, twins: np.ndarray) -> DataFrame:
    """node, tokens binary (four bytes each) of the texts whose digest is in the bitmap (and of a few others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            t = Tokens(batch.column(batch.schema.get_field_index(text)), twins)
            node, lead = np.unique(t.node, return_index=True)
            b = node.astype(np.uint64) & np.uint64(BITMAP_BITS - 1)
            hit = (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
            low = (t.tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            found = [low[t.first[i] : t.first[i] + t.size[i]].tobytes() for i in lead[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(found, pa.binary())], names=["node", "tokens"])

    return docs.select(text).mapInArrow(run, "node long, tokens binary")


def surrounded(rows: DataFrame, docs: DataFrame, text: str, twins: np.ndarray) -> DataFrame:
    """``shared`` rows with near: the tokens about the place (binary, 2 _REACH + 1 of four bytes), left, right: how many of them lie in the text on either side.

    A text's tokens go before its windows to the task of its digest, once for each part of a task that holds a copy.  Its
    windows leave in the order of their places, so that what neighbours have in common is compressed away on the way to the keys.
    """
    bits = bitmap(rows.select(F.col("node").alias("h")))
    wanted = rows.select("node", F.lit(None).cast("binary").alias("tokens"), "key", "c", "chunk", F.lit(1).alias("kind"))
    none = F.lit(None).cast("long")
    body = contents(docs, bits, text, twins).select("node", "tokens", none.alias("key"), none.alias("c"), none.alias("chunk"), F.lit(0).alias("kind"))
    both = body.unionByName(wanted).repartition("node").sortWithinPartitions("node", "kind", "c")
    width = 2 * _REACH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, padded, size = None, None, 0

        def around(node: int, key: np.ndarray, c: np.ndarray, chunk: np.ndarray) -> pa.RecordBatch:
            near = np.ascontiguousarray(padded[c[:, None] + np.arange(width)])
            cut = pa.py_buffer(np.arange(len(c) + 1, dtype=np.int32) * (width * 4))
            data = pa.Array.from_buffers(pa.binary(), len(c), [None, cut, pa.py_buffer(near)])
            sides = (pa.array(np.minimum(x, _REACH).astype(np.int32)) for x in (c, size - 1 - c))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(chunk), pa.array(np.full(len(c), node)), pa.array(c), *sides, data], names=["key", "chunk", "node", "c", "left", "right", "near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node, kind = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("node", "kind"))
            start, length = _groups(node * 2 + kind)
            tokens = batch.column(batch.schema.get_field_index("tokens"))
            cols = [batch.column(batch.schema.get_field_index(x)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("key", "c", "chunk")]
            for lo, n in zip(start.tolist(), length.tolist()):
                if kind[lo] == 0:
                    if node[lo] != have:
                        body = np.frombuffer(tokens[lo].as_py(), np.uint32)
                        have, size = node[lo], len(body)
                        padded = np.concatenate([np.zeros(_REACH, np.uint32), body, np.zeros(_REACH, np.uint32)])
                else:
                    for k in range(lo, lo + n, 2048):
                        yield around(int(node[lo]), *(x[k : min(k + 2048, lo + n)] for x in cols))

    return both.mapInArrow(run, "key long, chunk long, node long, c long, left int, right int, near binary")


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run of equal values, length of the run)"""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(key)]]))


class Around:
    """Tokens about places: ``near`` (n x 2 _REACH + 1), and how many of them lie in the text to the left and right."""

    def __init__(self, near: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.near, self.left, self.right = near, left, right
        place = np.arange(-_REACH, _REACH + 1)
        self.inside = (place >= -left[:, None]) & (place <= right[:, None])
        self._sorted = None

    def keys(self, rows: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The rows' tokens, told apart by group; places outside the text have values of their own."""
        t = (group[:, None].astype(np.int64) << 33) + self.near[rows]
        return np.where(self.inside[rows], t, (group[:, None].astype(np.int64) << 33) + (1 << 32))

    def _windows(self, same: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each run over the place (_SPAN of them, the leftmost first): tokens of ``same`` in it; -1 if it is not in both texts."""
        run = np.concatenate([np.zeros((len(same), 1), np.int16), np.cumsum(same, axis=1, dtype=np.int16)], axis=1)
        i = np.arange(_SPAN)
        left, right = np.minimum(self.left[a], self.left[b]), np.minimum(self.right[a], self.right[b])
        whole = (i - _SPAN + 1 >= -left[:, None]) & (i <= right[:, None])
        return np.where(whole, run[:, _SPAN:] - run[:, :_SPAN], -1)

    def _there(self, a: np.ndarray, b: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which tokens of b at these places stand anywhere about the place in a."""
        if self._sorted is None:
            self._sorted = np.sort(self.keys(np.arange(len(self.near)), np.arange(len(self.near))), axis=1).ravel()
        want = (a[:, None].astype(np.int64) << 33) + self.near[b[:, None], places]
        at = np.minimum(np.searchsorted(self._sorted, want.ravel()), len(self._sorted) - 1)
        return (self._sorted[at].reshape(want.shape) == want) & self.inside[b[:, None], places]

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of rows, the runs over the place that are alike in both, as first and last; -1 and -1 if none is.

        The third column tells whether they agree place by place.  A run holds the ``MISSED`` + 1 tokens next to the place
        on one side, of which the other text has one.
        """
        out = np.tile(np.array([-1, -1, 1]), (len(a), 1))
        every = np.arange(2 * _REACH + 1)
        beside = np.concatenate([np.arange(_REACH - MISSED - 1, _REACH), np.arange(_REACH + 1, _REACH + MISSED + 2)])
        for k in range(0, len(a), _PART):
            p, q, part = a[k : k + _PART], b[k : k + _PART], out[k : k + _PART]
            some = np.flatnonzero((self.near[p[:, None], beside] == self.near[q[:, None], beside]).any(1))
            x, y = p[some], q[some]
            ok = self._windows((self.near[x] == self.near[y]) & self.inside[x] & self.inside[y], x, y) >= NEED
            self._note(part, some, ok, 1)
            # what agrees place by place is settled; else no run can share more than the tokens of it that stand anywhere in the other
            rest = np.flatnonzero(part[:, 0] < 0)
            rest = rest[self._there(p[rest], q[rest], beside).any(1)]
            if len(rest):
                ok = self._windows(self._there(p[rest], q[rest], every), p[rest], q[rest]) >= NEED
                pair, at = np.nonzero(ok)
                for w in range(0, len(pair), _RUNS):
                    i, j = pair[w : w + _RUNS], at[w : w + _RUNS]
                    run = j[:, None] + np.arange(_SPAN)
                    ok[i, j] = common(self.near[p[rest[i]][:, None], run], self.near[q[rest[i]][:, None], run]) >= NEED
                self._note(part, rest, ok, 0)
        return out

    @staticmethod
    def _note(out: np.ndarray, rows: np.ndarray, ok: np.ndarray, straight: int) -> None:
        hit = ok.any(1)
        out[rows[hit]] = np.stack([ok[hit].argmax(1), _SPAN - 1 - ok[hit][:, ::-1].argmax(1), np.full(hit.sum(), straight)], axis=1)

    def extent(self, a: np.ndarray, b: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last token, counted from the place, of what the alike runs of each pair cover, without what differs at the ends."""
        i = np.arange(2 * _REACH + 1)
        same = (self.near[a] == self.near[b]) | (runs[:, 2:] == 0)
        same &= (i >= runs[:, :1]) & (i < runs[:, 1:2] + _SPAN)
        return same.argmax(1) - _REACH, _REACH - same[:, ::-1].argmax(1)


def _counted(tokens: np.ndarray) -> np.ndarray:
    """Each row's tokens, sorted and told apart by how many equal ones the row has before, so that rows share them as multisets."""
    s = np.sort(tokens.astype(np.int64), axis=1)
    at = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    begin = np.where(np.diff(s, axis=1, prepend=-1) != 0, at, 0)
    return s * 128 + (at - np.maximum.accumulate(begin, axis=1))


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row, the tokens that the two runs share, each as often as in both."""
    both = np.sort(np.concatenate([_counted(a), _counted(b)], axis=1), axis=1)
    return (both[:, 1:] == both[:, :-1]).sum(axis=1)


def _probed(around: Around, rows: np.ndarray, group: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, groups left out): pairs of a group's rows of which one is ``apart``, that share one of its rarest tokens on a side.

    A token's second place in a row is another token than its first, so that rows of a few repeated tokens are told apart too.
    ``rows`` are row numbers, ``group`` theirs from 0 on.  Groups with too many such pairs are left out and named.
    """
    keys = around.keys(rows, group)
    counted = _counted(keys)
    every, n = np.unique(counted, return_counts=True)
    ask = np.flatnonzero(apart)
    probe_key, probe_row = [], []
    for cut, whole in ((slice(_REACH - SIDE, _REACH), around.left[rows[ask]] >= SIDE), (slice(_REACH + 1, _REACH + 1 + SIDE), around.right[rows[ask]] >= SIDE)):
        who = ask[whole]
        side = _counted(keys[who, cut])
        rare = np.argpartition(n[np.searchsorted(every, side)], MISSED, axis=1)[:, : MISSED + 1]
        probe_key.append(np.take_along_axis(side, rare, axis=1).ravel())
        probe_row.append(np.repeat(who, MISSED + 1))
    probe_key, probe_row = np.concatenate(probe_key), np.concatenate(probe_row)
    flat = np.stack([counted.ravel(), np.repeat(np.arange(len(rows)), keys.shape[1])], axis=1)
    order = np.lexsort([flat[:, 1], flat[:, 0]])
    have, who = flat[order, 0], flat[order, 1]
    lo, hi = np.searchsorted(have, probe_key), np.searchsorted(have, probe_key, "right")
    cost = np.bincount(group[probe_row], hi - lo, group.max() + 1)
    left_out = cost > _LISTED * np.bincount(group, minlength=len(cost))
    listed = ~left_out[group[probe_row]]
    lo, hi, probe_row = lo[listed], hi[listed], probe_row[listed]
    size = hi - lo
    a = np.repeat(probe_row, size)
    b = who[np.repeat(lo - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())]
    pair = np.unique(np.minimum(a, b) * len(rows) + np.maximum(a, b))
    return pair // len(rows), pair % len(rows), np.flatnonzero(left_out)


def _laid(around: Around, node: np.ndarray, at: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links and their runs, of a group's rows from ``at`` on, that join what is alike: rows outside the largest class against all of other classes.

    Rows that are alike have ``NEED`` tokens about the place in common; those that rows share are counted for all of them
    at once, so that few pairs are left to lay.  Of each class those with most in common come first, more and more in turn.
    """
    everyone, none = len(label), 1 << 39
    tokens = _counted(around.keys(np.arange(at, at + everyone), np.zeros(everyone, np.int64)))
    every, which, n = np.unique(tokens, return_inverse=True, return_counts=True)
    which, n = which.reshape(tokens.shape), np.where(every < none, n, 0)  # places outside the text are from ``none`` on
    often, some = n > _OFTEN, (n > 1) & (n <= _OFTEN)
    held = np.zeros((everyone, int(often.sum())), np.float32)
    row, at_token = np.nonzero(often[which])
    held[row, (np.cumsum(often) - 1)[which[row, at_token]]] = 1
    holder = np.argsort(which, axis=None, kind="stable") // which.shape[1]
    before = np.searchsorted(np.sort(which, axis=None), np.arange(len(every)))
    names, size = np.unique(label, return_counts=True)
    outside = label != names[size.argmax()]
    apart, found = np.flatnonzero(outside), []
    for k in range(0, len(apart), _BLOCK):
        part = apart[k : k + _BLOCK]
        alike = held[part] @ held.T
        row, at_token = np.nonzero(some[which[part]])
        token = which[part[row], at_token]
        many = n[token]
        other = holder[np.repeat(before[token] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        alike += np.bincount(np.repeat(row, many) * everyone + other, minlength=alike.size).reshape(alike.shape)
        a, b = np.nonzero(alike >= NEED)
        shared_ = alike[a, b]
        a = part[a]
        new = (node[a] != node[b]) & ~(outside[b] & (b < a))  # else they have met the other way round
        a, b, shared_, width = a[new], b[new], shared_[new], 1
        while True:
            new = label[a] != label[b]
            a, b, shared_ = a[new], b[new], shared_[new]
            if not len(a):
                break
            order = np.lexsort([-shared_, label[a]])
            a, b, shared_ = a[order], b[order], shared_[order]
            start, length = _groups(label[a])
            first = np.arange(len(a)) - np.repeat(start, length) < width
            runs = around.alike(a[first] + at, b[first] + at)
            hit = runs[:, 0] >= 0
            one, two = label[a[first][hit]], label[b[first][hit]]
            lead = np.unique(np.minimum(one, two) * everyone + np.maximum(one, two), return_index=True)[1]
            u, v, runs = a[first][hit][lead], b[first][hit][lead], runs[hit][lead]
            found.append((u + at, v + at, runs))
            label = spanning(everyone, np.concatenate([np.arange(everyone), u]), np.concatenate([label, v]))
            a, b, shared_, width = a[~first], b[~first], shared_[~first], width * 4
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (apart[:0], apart[:0], np.zeros((0, 3), np.int64))


def solved(group: np.ndarray, node: np.ndarray, around: Around) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, runs): links of rows, sorted by group, that connect what is alike within each group, directly or over others."""
    start, size = _groups(group)
    number = np.repeat(np.arange(len(start)), size)
    first = np.repeat(start, size)
    label = np.arange(len(group))
    q = np.flatnonzero(node != node[first])
    runs = around.alike(first[q], q)
    found = [(first[q][runs[:, 0] >= 0], q[runs[:, 0] >= 0], runs[runs[:, 0] >= 0])]
    # windows of one text need not be laid against each other
    same = np.flatnonzero(node[1:] == node[:-1]) + 1
    same = same[group[same] == group[same - 1]]
    label = spanning(len(group), np.concatenate([found[0][0], same - 1]), np.concatenate([found[0][1], same]))
    whole = np.bincount(number, label == first, len(start)) == size
    open_ = ~whole & (size > 2)
    rows = np.flatnonzero(open_[number])
    if len(rows):
        own = np.unique(number[rows], return_inverse=True)[1]
        apart = label[rows] != first[rows]
        a, b, left = _probed(around, rows, own, apart)
        a, b = rows[a], rows[b]
        other = (label[a] != label[b]) & (node[a] != node[b])
        a, b = a[other], b[other]
        runs = around.alike(a, b)
        hit = runs[:, 0] >= 0
        found.append((a[hit], b[hit], runs[hit]))
        names = np.flatnonzero(open_)
        for g in names[left]:
            s = slice(start[g], start[g] + size[g])
            found.append(_laid(around, node[s], int(start[g]), label[s] - start[g]))
    return tuple(np.concatenate(x) for x in zip(*found))


def chunked(met: DataFrame) -> DataFrame:
    """key, chunks of the keys of over ``CHUNK`` windows, from ``shared``."""
    return few(met.where("chunk > 0").groupBy("key").agg((F.max("chunk") + 1).alias("chunks")))


def paired(met: DataFrame, large: DataFrame) -> DataFrame:
    """``met`` with lo and hi in place of chunk: once for each pair of chunks that a row's chunk is one of, once in all where the key has one.

    ``large`` says how many chunks a key has; of those of over ``APART`` up to ``MERGED`` go together, so that fewer pairs hold more rows.
    """
    step = F.least(F.lit(MERGED), F.ceil(F.col("chunks") / APART))
    rows = met.join(large, "key", "left").withColumns({"chunk": F.coalesce(F.floor(F.col("chunk") / step), "chunk"), "chunks": F.ceil(F.col("chunks") / step)})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1))).where("chunks IS NULL OR chunk <> other")
    return rows.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("chunk", "chunks", "other")


def links(met: DataFrame, large: DataFrame) -> DataFrame:
    """u, v, u_first, u_words, v_first, v_words: verified passages that connect, in each key's group, all texts that have one in common there.

    A group of over CHUNK windows is dealt into chunks (``large`` says how many), each pair of which meets in a task.
    """
    rows = paired(met, large).select("key", "lo", "hi", "node", "c", "left", "right", "near")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node", "c")
    names = ("key", "lo", "hi", "node", "c", "left", "right")

    def gathered(batches: Iterator[pa.RecordBatch], rows: int = 8 * PYTHON_ROWS) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in some) >= rows:
                yield pa.concat_batches(some)
                some = []
        if some:
            yield pa.concat_batches(some)

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, lo, hi, node, c, left, right, near = cols
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        around = Around(near, left, right)
        a, b, runs = solved(group, node, around)
        lo_, hi_ = around.extent(a, b, runs)
        words = hi_ - lo_ + WIDTH
        return _longs([node[a], node[b], c[a] + lo_, words, c[b] + lo_, words], ["u", "v", "u_first", "u_words", "v_first", "v_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in gathered(batches):
            cols = [batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]
            data = b"".join(batch.column(batch.schema.get_field_index("near")).to_pylist())
            cols.append(np.frombuffer(data, np.uint32).reshape(batch.num_rows, -1))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield solve([x[:cut] for x in cols])
            held = [x[cut:] for x in cols]
        if held is not None and len(held[0]):
            yield solve(held)

    return rows.mapInArrow(run, "u long, v long, u_first long, u_words long, v_first long, v_words long").distinct()


def partners(held: DataFrame) -> DataFrame:
    """node, n_links: of (node, passage), the other nodes that have a passage of the node's, each counted once.

    Nodes with the same common passages are counted together, so that a passage of n nodes makes no n * n rows.
    """
    held = checkpointed(held.distinct())
    size = held.groupBy("passage").agg(F.count("*").alias("size"))
    held = held.join(size, "passage")
    sets = checkpointed(held.where(f"size > {COMMON}").groupBy("node").agg(F.array_sort(F.collect_list("passage")).alias("common")))
    kinds = sets.groupBy("common").agg(F.count("*").alias("n"))
    each = kinds.select(F.explode("common").alias("passage"), "common", "n")
    met = each.join(each.select("passage", F.col("common").alias("with"), F.col("n").alias("m")), "passage").select("common", "with", "m").distinct()
    many = sets.join(met.groupBy("common").agg((F.sum("m") - 1).alias("n_links")), "common").select("node", "n_links")
    rare = held.where(f"size <= {COMMON}").select("passage", "node")
    pairs = rare.join(rare.withColumnRenamed("node", "other"), "passage").where("node <> other").select("node", "other").distinct()
    pairs = pairs.join(sets, "node", "left").join(sets.select(F.col("node").alias("other"), F.col("common").alias("with")), "other", "left")
    few = pairs.where("NOT coalesce(arrays_overlap(common, with), false)").groupBy("node").agg(F.count("*").alias("n_links"))
    return many.unionByName(few).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def repeated_passages(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row for each document that shares a passage with another: doc, class_id, n_links, n_copies, passages.

    class_id is the least doc that the document reaches over shared passages; passages lists first_word, n_words and
    other_doc (the least that it was found alike with) of its repeated stretches, those that overlap as one, sorted;
    n_links counts the other texts that have one of these stretches too, whichever of them it was laid against; n_copies
    the other documents of the very same words.  Texts of under LEAST_WORDS words, null and empty ones have no row.
    Repeated rows with one id are one document; a passage that only one document repeats is none.
    """
    known = checkpointed(texts(docs, text, doc))
    twins = shared_twins(known)
    if len(twins):
        odd = F.col("node").isin([int(x) for x in twins])
        known = known.withColumn("node", F.when(odd, second_node(F.col("node"), F.col("check"))).otherwise(F.col("node")))
    texts_ = known.where(f"words >= {LEAST_WORDS}").select(F.col("id").alias(doc), "node", "words").distinct()
    nodes = checkpointed(texts_.groupBy("node").agg(F.min(doc).alias("least"), F.count("*").alias("n"), F.max("words").alias("words")))
    met = freed(shared(windows(docs, text, twins)))
    large = chunked(met)
    with arrow_rows(docs.sparkSession, PYTHON_ROWS):
        turns = [met.where(F.pmod("key", F.lit(TURNS)) == k) for k in range(TURNS)]
        found = [freed(links(surrounded(some, docs, text, twins), large)) for some in turns]
    found = freed(reduce(DataFrame.unionByName, found).distinct())
    roots = components(found.select("u", "v"))
    # the stretches of each text that others have too; those that overlap are one
    side = lambda a, b: found.select(F.col(a).alias("node"), F.col(b).alias("other"), F.col(f"{a}_first").alias("first_word"), F.col(f"{a}_words").alias("n_words"))
    ends = side("u", "v").unionByName(side("v", "u")).join(nodes.select(F.col("node").alias("other"), F.col("least").alias("other_doc")), "other")
    each = ends.groupBy("node", "first_word", "n_words").agg(F.min("other_doc").alias("other_doc"))
    order = Window.partitionBy("node").orderBy("first_word", "n_words")
    reach = F.max(F.col("first_word") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach > F.col("first_word"), 0).otherwise(1)
    each = checkpointed(each.withColumn("new", new).withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    merged = each.groupBy("node", "nth").agg(F.min("first_word").alias("first_word"), F.max(F.col("first_word") + F.col("n_words")).alias("end"), F.min("other_doc").alias("other_doc"))
    listed = merged.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("first_word", (F.col("end") - F.col("first_word")).alias("n_words"), "other_doc"))).alias("passages"))
    # links between whole stretches: many windows of two texts come to one
    end = lambda x: each.select(F.col("node").alias(x), F.col("first_word").alias(f"{x}_first"), F.col("n_words").alias(f"{x}_words"), F.xxhash64("node", "nth").alias(f"{x}_at"))
    alike = found.join(end("u"), ["u", "u_first", "u_words"]).join(end("v"), ["v", "v_first", "v_words"]).select(F.col("u_at").alias("u"), F.col("v_at").alias("v"))
    same = components(alike)
    held = each.select("node", F.xxhash64("node", "nth").alias("at")).distinct().join(same, F.col("at") == same.node, "left").select(each.node, F.coalesce("root", "at").alias("passage"))
    counted = partners(held)
    known = with_least(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "class_id")
    known = known.join(listed, "node", "left").join(counted, "node", "left").where("n > 1 OR n_links > 0")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first_word"), F.col("words").cast("long").alias("n_words"), F.col("least").alias("other_doc")))
    known = known.select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"), F.coalesce("passages", whole).alias("passages"))
    return texts_.select(doc, "node").join(known, "node").drop("node")


def op5_passages(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, passages of every document with a passage that another has too.

    See ``repeated_passages`` for nulls, repeats and ties.  A very long text is read whole by one task, its windows are sent on
    in batches.  No documents: no rows.  Further columns, whatever their names, are not looked at.
    """
    return repeated_passages(documents)
