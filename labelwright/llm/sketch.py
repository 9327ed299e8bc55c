"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is a set of digests of its paragraphs: its lines, each cut further after words chosen by their own hash (one in
four), so that a text of one long line is not one paragraph.  The k-th repeat of a paragraph is a digest of its own.
A sketch has ``cells`` cells; each digest goes into one cell of each of three equal parts, as a count, a sum
of digests and one of check hashes (modulo 2^64).  Sketches of one size subtract cell by cell; a cell whose count is 1 or
-1 and whose check agrees gives up a digest, which is taken out of its other cells, until all are empty.  If peeling stops early, both
texts are sketched anew with four times the cells.  What is peeled are the digests that only one version has.

The likeness of two versions is 2 * common / (digests of both), 1 for equal sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import Words, mix64, text_pieces

#: Cells of a fingerprint, a multiple of 3; a larger sketch has four times as many each time.
CELLS = 24
PARTS = 3


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(digests of all texts one after another, bounds of each text's): paragraphs, repeats told apart; no zero."""
    w = Words(pa.array(texts, pa.string()), lower=False)
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = w.hashes()
    lines = np.concatenate([[0], np.cumsum(w.raw == 10)])
    cut = (h & np.uint64(3)) == 0
    cut[:-1] |= (lines[w.start[1:]] > lines[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
    cut[-1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1])
    body, doc = memoryview(w.raw.tobytes()), w.doc[first]
    para = np.fromiter((xxhash.xxh3_64_intdigest(body[a:b]) for a, b in zip(w.start[first].tolist(), w.end[last].tolist())), np.uint64, len(first))
    order = np.lexsort([np.arange(len(para)), para, doc])
    p, d = para[order], doc[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
    nth = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    out = mix64(p + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out[out == 0] = 1
    return out, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(texts)))])


def _slots(keys: np.ndarray, cells: np.ndarray | int) -> np.ndarray:
    """(PARTS, keys): the key's cell in each part."""
    part = np.asarray(cells) // PARTS
    return np.stack([(mix64(keys ^ np.uint64(0xA5A5A5A5 * (j + 1))) % np.asarray(part, np.uint64)).astype(np.int64) + j * part for j in range(PARTS)])


def check(keys: np.ndarray) -> np.ndarray:
    return mix64(keys + np.uint64(0xC0FFEE123456789)) >> np.uint64(32)


class Sketches:
    """Sketches of many texts in one run of cells; sketch i has ``cells[i]`` cells from ``base[i]``."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.base = cells, np.concatenate([[0], np.cumsum(cells)])
        n = int(self.base[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, which: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        at = (_slots(keys, self.cells[which]) + self.base[which]).ravel()
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        times = sign.astype(np.uint64)  # -1 is 2^64 - 1
        np.add.at(self.count, at, np.tile(sign, PARTS))
        np.add.at(self.keys, at, np.tile(keys * times, PARTS))
        np.add.at(self.checks, at, np.tile(check(keys) * times, PARTS))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sketch, digest, side) of all that was peeled from these differences, and which sketches were emptied; uses the cells up."""
        owner = np.repeat(np.arange(len(self.cells)), self.cells)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.arange(len(owner))
        for _ in range(500):  # far more rounds than peeling takes; a wrong digest could go to and fro for ever
            pure = look[np.abs(self.count[look]) == 1]
            times = self.count[pure].astype(np.uint64)
            keys = self.keys[pure] * times
            true = self.checks[pure] * times == check(keys)
            pure, keys = pure[true], keys[true]
            if not len(pure):
                break
            which, side = owner[pure], self.count[pure]
            _, one = np.unique(mix64(keys ^ mix64(which.astype(np.uint64))), return_index=True)
            which, keys, side = which[one], keys[one], side[one]
            found.append((which, keys, side))
            self.add(which, keys, -side)
            look = np.unique(_slots(keys, self.cells[which]) + self.base[which])
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        ok = np.bincount(owner, left, len(self.cells)) == 0
        none = np.zeros(0, np.int64)
        which, keys, side = (np.concatenate(x) for x in zip(*found)) if found else (none, none.astype(np.uint64), none)
        return which, keys, side, ok

    def text(self) -> list[str]:
        """Each sketch as hex digits: counts (4 digits), digests (16) and checks (8) of its cells."""
        rows = np.zeros(len(self.count), np.dtype([("n", ">u2"), ("k", ">u8"), ("c", ">u4")]))
        rows["n"], rows["k"], rows["c"] = self.count & 0xFFFF, self.keys, self.checks & np.uint64(0xFFFFFFFF)
        data, size = rows.tobytes().hex(), 28
        return [data[a * size : b * size] for a, b in zip(self.base, self.base[1:])]


def sketches(keys: np.ndarray, bounds: np.ndarray, cells: int = CELLS) -> Sketches:
    out = Sketches(np.full(len(bounds) - 1, cells, np.int64))
    out.add(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), keys)
    return out


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, side 1 or -1): what only a's or only b's text of each pair has, by subtraction, peeling and retries."""
    (ka, ba), (kb, bb) = a, b
    na, nb = np.diff(ba), np.diff(bb)
    pair_a, pair_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    todo, size, out = np.arange(len(na)), np.full(len(na), cells, np.int64), []
    # no fewer cells than the difference in numbers needs
    while (low := (size < 1.3 * np.abs(na - nb)) & (size < 1 << 40)).any():
        size[low] *= 4
    while len(todo):
        index = np.full(len(na), -1)
        index[todo] = np.arange(len(todo))
        s = Sketches(size[todo])
        in_a, in_b = index[pair_a] >= 0, index[pair_b] >= 0
        s.add(index[pair_a[in_a]], ka[in_a])
        s.add(index[pair_b[in_b]], kb[in_b], -1)
        which, keys, side, ok = s.peel()
        good = ok[which] if len(which) else np.zeros(0, bool)
        out.append((todo[which[good]], keys[good], side[good]))
        todo = todo[~ok]
        size[todo] *= 4
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each pair of texts 2 * common / (digests of both), 1 if neither has any."""
    pair, _, _ = differences(a, b)
    n = len(a[1]) - 1
    total = np.diff(a[1]) + np.diff(b[1])
    return np.where(total > 0, (total - np.bincount(pair, minlength=n)) / np.maximum(total, 1), 1.0)


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """``order``, text, and _bucket, _seam, for ``following``: ranges of about equal numbers of rows, each in one task in order.

    Ranges come from quantiles of the ids, at most as many as shuffle partitions.  Each range also gets the first row of
    the range after it (after the last: of the first) with _seam 1, so that every row's successor is in its task: the
    text is shuffled once.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(order, F.coalesce(text, F.lit("")).alias(text))
    ids = docs.select(order)
    cuts = ids.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    at = np.array(sorted(set(cuts)))

    def bucket_of(ids_: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, ids_, "right") + 1 if len(at) else np.ones(len(ids_), np.int64)

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(values.to_numpy()).astype(np.int32))

    zero = F.lit(0).cast(docs.schema[order].dataType)
    # null ids come first, in a range of their own
    placed = F.when(F.col(order).isNull(), 0).otherwise(bucket(F.coalesce(order, zero)))
    firsts = ids.select(order, placed.alias("b")).groupBy("b").agg(F.min(order).alias("first")).orderBy("b").collect()
    before = {firsts[i].b: firsts[i - 1].b for i in range(len(firsts))}
    first_of = {f.b: f.first for f in firsts}

    @F.pandas_udf("int")
    def seam_of(values: pd.Series) -> pd.Series:
        """The range before, if a row has the first id of its own; else -1."""
        own = bucket_of(values.to_numpy())
        kinds, which = np.unique(own, return_inverse=True)
        first = np.array([first_of.get(int(k), 0) for k in kinds])[which] if len(kinds) else own
        earlier = np.array([before.get(int(k), -1) for k in kinds])[which] if len(kinds) else own
        return pd.Series(np.where(values.to_numpy() == first, earlier, -1).astype(np.int32))

    seam = F.when(F.col(order).isNull(), F.lit(before.get(0, -1))).otherwise(seam_of(F.coalesce(order, zero)))
    marked = rows.withColumn("_bucket", placed).withColumn("_before", seam)
    places = F.array(F.struct(F.col("_bucket"), F.lit(0).alias("_seam")))
    places = F.when(F.col("_before") < 0, places).otherwise(F.array_append(places, F.struct(F.col("_before").alias("_bucket"), F.lit(1).alias("_seam"))))
    both = marked.select(order, text, F.explode(places).alias("_place")).select(order, text, "_place.*")
    # rows that share a range's first id all stand at the seam; the first of them in order counts
    return both.repartitionById(len(at) + 2, F.col("_bucket")).sortWithinPartitions("_bucket", "_seam", order, text)


def fingerprinted(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """A row for each of ``docs`` with its fingerprint, that of its edited text, and their likeness; see ``op1_fingerprints``."""
    schema = T.StructType([docs.schema[order]] + T._parse_datatype_string("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long").fields)

    def work(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        changed = [edited(a, b) for a, b in zip(texts, nexts)]
        a, b, c = digests(texts), digests(changed), digests(nexts)
        cols = [
            ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], sketches(*a).text(), sketches(*b).text(), likeness(a, b), likeness(a, c), np.diff(a[1]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=schema.names)

    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen, still without its successor: (bucket, id, text)
        for batch in text_pieces(batches, text):
            kinds[0] = batch.column(batch.schema.get_field_index(order)).type
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_bucket", "_seam", order, text)]
            ids, texts, nexts = [], [], []
            for bucket, seam, key, t in zip(*cols):
                if held is not None and held[0] == bucket:
                    ids.append(held[1])
                    texts.append(held[2])
                    nexts.append(t)
                held = None if seam else (bucket, key, t)
            if ids:
                yield work(ids, texts, nexts)

    return with_next(docs, order, text).mapInArrow(run, schema)


def op1_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs of every document.

    No documents: no rows.  A very long text is one row of one task, and its sketch as small as any other; further columns, whatever
    their names, are not looked at.
    Null texts count as empty.  Documents follow each other by ascending doc_id (null first), rows of one doc_id by text;
    the first follows the last, a single document itself.  Texts without words have an empty sketch and are alike.
    """
    return fingerprinted(documents)
