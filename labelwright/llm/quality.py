"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import Words, held_out, labelled, mix64, text_pieces
from labelwright.llm.trees import BoostedTrees

#: Labelled rows that a model is fitted on, at most (those of the smallest hash of doc_id).
TRAIN_ROWS = 20_000
STATISTICS = (
    "chars words word_bytes word_spread long_words short_words distinct top_word repeated letters upper digits blanks marks symbols wide "
    "lines line_bytes repeated_lines marked_words symbol_words capital_words"
).split()

_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE < 128)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_BLANK = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_MARK = np.isin(_BYTE, np.frombuffer(b".,;:?'\"()-", np.uint8))
_LEAD = _BYTE >= 0xC0
_TAIL = (_BYTE & 0xC0) == 0x80
_SYMBOL = (_BYTE < 128) & ~_LETTER & ~_DIGIT & ~_BLANK & ~_MARK


def _distinct(doc: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: its number of distinct hashes, and the count of its most frequent one."""
    _, first, n = np.unique(mix64(h ^ (doc.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))), return_index=True, return_counts=True)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, doc[first], n)
    return np.bincount(doc[first], minlength=rows), most


def statistics(col: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; null counts as empty, and an empty text has zeros."""
    w = Words(col, lower=False)
    raw, off, rows = w.raw, w.off, w.rows

    def total(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return c[off[1:]] - c[off[:-1]], c

    size = np.diff(off)
    tails, _ = total(_TAIL)
    chars = size - tails
    letters, upper, digits, blanks, marks = (total(t)[0] for t in (_LETTER, _UPPER, _DIGIT, _BLANK, _MARK))
    symbols, symbol_sum = total(_SYMBOL)
    wide, _ = total(_LEAD)
    n, length = w.count, w.end - w.start
    per = np.maximum(n, 1)
    mean = np.bincount(w.doc, length, rows) / per
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length.astype(float) ** 2, rows) / per - mean**2, 0))
    h = w.hashes()
    distinct, top = _distinct(w.doc, h, rows)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    share = lambda mask: np.bincount(w.doc[mask], minlength=rows) / per
    last = raw[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    first = raw[w.start] if len(h) else last
    with_symbol = symbol_sum[w.end] > symbol_sum[w.start]
    breaks = np.flatnonzero(raw == 10)
    edges = np.unique(np.concatenate([off, breaks, breaks + 1]))
    lo, hi = edges[:-1], edges[1:]
    line = hi > lo
    line &= ~((hi - lo == 1) & (raw[np.minimum(lo, max(len(raw) - 1, 0))] == 10)) if len(raw) else line
    lo, hi = lo[line], hi[line]
    in_doc = np.searchsorted(off, lo, "right") - 1
    lines = np.bincount(in_doc, minlength=rows)
    kinds, _ = _distinct(in_doc, w.span_hash(lo, hi), rows)
    a = np.maximum(chars, 1)
    out = [
        np.log1p(chars), np.log1p(n), mean, spread, share(length > 12), share(length <= 3), distinct / per, top / per, share(again), letters / a, upper / a, digits / a, blanks / a, marks / a,
        symbols / a, wide / a, np.log1p(lines), size / np.maximum(lines, 1), 1 - kinds / np.maximum(lines, 1), share(_MARK[last]), share(with_symbol), share(_UPPER[first]),
    ]
    return np.stack(out, axis=1)


def _featured(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            x = statistics(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    return docs.select("y", text).mapInArrow(run, "y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", text: str = "text", hold_mod: int = 4, hold_rest: int = 2, limit: int = TRAIN_ROWS) -> BoostedTrees:
    """A model of at most ``limit`` labelled documents outside the fold; without any, the score is 0.5."""
    y = F.broadcast(labelled(labels, column, hold_mod, hold_rest, limit))
    # one text of an id, the least, so that rows are as many as ids at most
    one = docs.select("doc_id", text).join(y, "doc_id").groupBy("doc_id", "y").agg(F.min(text).alias(text))
    rows = _featured(one, text).toPandas()
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(STATISTICS)))
    order = np.lexsort([*x.T, rows["y"].to_numpy()]) if len(rows) else []
    return BoostedTrees(x[order], rows["y"].to_numpy().astype(float)[order])


def score(docs: DataFrame, model: BoostedTrees, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score double."""
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            s = model.score(statistics(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(s)], names=[*keep, "score"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def op9_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Rows are scored one by one from the text alone, so repeats, ties and clashing columns change nothing.  Null texts
    score as empty ones.  Labels that are null, contradict each other or have no document are left out.  A very long text is
    read whole by one task.  No documents: no rows; no labels: a model that knows nothing.
    """
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
