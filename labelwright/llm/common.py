"""Helpers shared by the corpus operators: tables, checkpoints, and word tables over Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.sources.shared import fresh_path, shared_dir  # noqa: F401

#: Text bytes and rows that a task turns into arrays at once; one longer text is taken alone.
PIECE_BYTES, PIECE_ROWS = 1 << 19, 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def freed(df: DataFrame) -> DataFrame:
    """``checkpointed``, and the files of the shuffles that led to it are removed as soon as it is written, not when the driver's garbage is collected."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return checkpointed(df.select("*"))  # a plan of its own: ``df`` may be run again
    finally:
        conf.set(name, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it holds, jobs that run pass at most so many rows to Python at once: for rows that carry long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of few narrow columns that may be broadcast.
FEW = 200_000


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """``df`` from the shared folder, with a broadcast hint if it has at most ``limit`` rows, which are counted; narrow rows only."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def labelled(labels: DataFrame, column: str, hold_mod: int, hold_rest: int, limit: int) -> DataFrame:
    """(doc_id, y): at most ``limit`` labelled ids outside the held-out fold, those of the smallest hash.

    Null ids and null or contradicting labels are left out.
    """
    y = labels.groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("y_max"))
    y = y.where("doc_id IS NOT NULL AND y = y_max")
    y = y.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % hold_mod != hold_rest)
    return y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", F.col("y").cast("int").alias("y"))


def held_out(hold_mod: int, hold_rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % hold_mod == hold_rest, F.lit(False))


def text_pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        wide = np.dtype(np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)
        off = np.frombuffer(col.buffers()[1], wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = min(at + PIECE_ROWS, max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the machine: an executor's idle Python workers count against its memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_POWER, _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words (runs of other than ASCII white space; with ``letters``: of ASCII letters and other than ASCII) of a text column as arrays.

    ``data``: the bytes, A-Z in lower case if asked; ``off``: text bounds in them; ``start``, ``end``: word bounds;
    ``doc``: each word's row; ``count``: words a row.  Null and empty texts have no words.
    """

    def __init__(self, col: pa.Array, lower: bool = True, letters: bool = False):
        arr = col.cast(pa.large_string())
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        body = arr.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
        self.raw, self.off, self.rows = raw, off - off[0], len(arr)
        self.data = raw
        if lower:
            up = (raw - np.uint8(65)) < 26
            self.data = raw + (up * np.uint8(32)).astype(np.uint8)
        blank = ((raw | np.uint8(32)) - np.uint8(97) >= 26) & (raw < 128) if letters else (raw == 32) | ((raw - np.uint8(9)) < 5)
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.off] = True
        before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        self.start = np.flatnonzero(~blank & (before | edge[:-1]))
        self.end = np.flatnonzero(~blank & (after | edge[1:])) + 1
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.rows)
        self._sums = None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_tables(len(self.data) + 1)[0][: len(self.data)], out=self._sums[1:])
        return self._sums

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        s = self.sums()
        return mix64((s[end] - s[start]) * _powers[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of an XXH3 digest of 128 bits of each text's words, in order, with one space between them."""
        mark = np.zeros(len(self.data) + 1, np.int8)
        mark[self.start] += 1
        mark[self.end] -= 1
        inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        later = self.start[1:][self.doc[1:] == self.doc[:-1]]
        keep = inside.copy()
        keep[later - 1] = True
        body = memoryview(np.where(inside, self.data, np.uint8(32))[keep].tobytes())
        at = np.concatenate([[0], np.cumsum(keep)])[self.off].tolist()
        both = b"".join(xxhash.xxh3_128_digest(body[i:j]) for i, j in zip(at, at[1:]))
        halves = np.frombuffer(both, ">u8").astype(np.uint64).reshape(-1, 2)
        return halves[:, 0], halves[:, 1]

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def shingles(self, k: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words within one text; a text of fewer words has its whole run; none, none."""
        h = self.hashes() if h is None else h
        first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        n = len(h)
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            part = np.zeros(n, np.uint64)
            part[: max(n - j, 0)] = h[j:]
            acc += part * np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64))
        rank = np.arange(n) - first[self.doc]
        whole = rank + k <= self.count[self.doc]
        at = np.flatnonzero(whole)
        out = acc[at]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            extra = np.array([int(sum(int(h[first[d] + j]) * pow(0xA0761D6478BD642F, j + 1, 1 << 64) for j in range(self.count[d]))) % (1 << 64) for d in short], np.uint64)
            at, out = np.concatenate([at, first[short]]), np.concatenate([out, extra])
            order = np.argsort(at, kind="stable")
            at, out = at[order], out[order]
        return at, mix64(out)


def shingle_hash(words: list[bytes]) -> int:
    """The hash that ``Words.shingles`` gives to these words, each already in lower case."""
    w = Words(pa.array([b" ".join(words)], pa.large_binary()).cast(pa.large_string()), lower=False)
    return int(w.shingles(max(len(words), 1))[1][0])


def string_rows(col: pa.Array) -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in col.to_pylist()]
