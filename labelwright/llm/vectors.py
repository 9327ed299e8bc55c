"""Compression of vectors to short codes: integer components, equal parts, one codebook a part, exact nearest entries.

The nearest entry is found by slices of bitmasks.  In every dimension of a part the entries' coordinates are sorted, and the
i-th prefix mask holds the entries of the first i coordinates.  The least distance to a few entries, those next to the vector
in the widest dimensions, is an initial radius: no nearer entry can be off by more in any dimension.  In each dimension the radius
cuts a range out of the sorted coordinates, whose entries are the difference of two prefix masks; the masks of all dimensions
are ANDed, and only the entries left are measured.  Nothing is lost, as the box holds the ball of that radius.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from labelwright.llm.common import checkpointed, few, fresh_path

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Widest dimensions that each propose an entry for the initial radius.
GUESSES = 3
#: Bytes of components that a task turns into arrays at once.
PIECE = 1 << 22


class Book:
    """The entries of one part with what their search needs: (entries, dimensions) integers, at most 64 entries."""

    def __init__(self, entries: np.ndarray):
        if not 1 <= len(entries) <= 64:
            raise ValueError("1 to 64 entries")
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, 0)
        bits = np.uint64(1) << self.order.astype(np.uint64)
        self.prefix = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        self.prefix[1:] = np.bitwise_or.accumulate(bits, axis=0)
        self.widest = np.argsort(self.sorted[0] - self.sorted[-1], kind="stable")[:GUESSES]

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """A mask of entries for each row of ``x``, which holds the nearest."""
        first = np.full(len(x), np.iinfo(np.int64).max)
        for k in self.widest:
            near = np.minimum(np.searchsorted(self.sorted[:, k], x[:, k]), len(self.entries) - 1)
            first = np.minimum(first, ((x - self.entries[self.order[near, k]]) ** 2).sum(1))
        radius = np.sqrt(first.astype(np.float64)).astype(np.int64) + 1  # a root's rounding never makes it too small
        mask = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            mask &= self.prefix[high, j] & ~self.prefix[low, j]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry; the lower index of equals."""
        mask = self.candidates(x)
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        for j in range(len(self.entries)):
            rows = np.flatnonzero(mask >> np.uint64(j) & np.uint64(1))
            far = ((x[rows] - self.entries[j]) ** 2).sum(1)
            nearer = far < best[rows]
            best[rows[nearer]], at[rows[nearer]] = far[nearer], j
        return at, best


def _kept(kind: np.dtype):  # noqa: ANN202
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            size = np.asarray(v.value_lengths().fill_null(0), np.int64)
            flat = v.flatten()
            bad = ~np.isfinite(np.asarray(flat.fill_null(float("nan")), np.float64))
            end = np.cumsum(size)
            sums = np.concatenate([[0], np.cumsum(bad)])
            keep = np.asarray(v.is_valid()) & (sums[end] == sums[end - size])
            raw = np.asarray(flat.fill_null(0), kind).tobytes()
            wide = kind.itemsize
            packed = [raw[(e - n) * wide : e * wide] for e, n in zip(end[keep].tolist(), size[keep].tolist())]
            rows = batch.select([0, 1]).filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(packed, pa.binary())], names=["vec_id", "label", "packed"])

    return each


def kept(vectors: DataFrame) -> tuple[DataFrame, int, np.dtype]:
    """(vec_id, label and the components as bytes of the vectors that count, written once; components of the longest; their type)."""
    array = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = np.dtype("<f4" if array == "float" else "<f8")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<float>" if kind.itemsize == 4 else "array<double>").alias("embedding"))
    types = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    seen, path = Observation(), fresh_path(vectors.sparkSession, "vectors")
    rows = rows.mapInArrow(_kept(kind), f"vec_id {types['vec_id']}, label {types['label']}, packed binary")
    rows.observe(seen, F.max(F.octet_length("packed")).alias("most")).write.parquet(path)
    return vectors.sparkSession.read.parquet(path), (seen.get["most"] or 0) // kind.itemsize, kind


def components(packed: pa.Array, width: int, kind: np.dtype) -> Iterator[np.ndarray]:
    """Integer components, rows by ``width``, of as many rows at a time as fit a piece."""
    step = max(1, PIECE // (8 * width))
    limit = np.float64(1 << (62 - int(width - 1).bit_length()) // 2 - 1)
    for k in range(0, len(packed), step):
        rows = packed.slice(k, step).to_pylist()
        full = width * kind.itemsize
        flat = np.frombuffer(b"".join(r if len(r) == full else r.ljust(full, b"\0") for r in rows), kind)
        yield np.clip(np.floor(flat.astype(np.float64) * SCALE), -limit, limit).astype(np.int64).reshape(len(rows), width)


def _sums(books: np.ndarray, width: int, kind: np.dtype):  # noqa: ANN202
    """What a task's vectors add to every component of every entry."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for x in components(batch.column(0), width, kind):
                for p, (book, part) in enumerate(zip(search, np.split(x, len(search), axis=1))):
                    at, _ = book.nearest(part)
                    count[p] += np.bincount(at, minlength=len(book.entries))
                    np.add.at(total[p], at, part)
        place = np.flatnonzero(np.repeat(count > 0, books.shape[2]))
        n = np.repeat(count, books.shape[2])[place]
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.reshape(-1)[place]), pa.array(n)], names=["place", "total", "n"])

    return each


def _codes(books: np.ndarray, width: int, kind: np.dtype):  # noqa: ANN202
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        for batch in batches:
            code, error = [], []
            for x in components(batch.column(2), width, kind):
                found = [book.nearest(part) for book, part in zip(search, np.split(x, len(search), axis=1))]
                code += [row.tobytes().hex() for row in np.stack([at for at, _ in found], axis=1).astype(np.uint8)]
                error.append(sum(far for _, far in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(np.concatenate([*error, np.zeros(0, np.int64)]))], names=["vec_id", "label", "code", "error"])

    return each


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error) of every vector that counts, final codebooks as (parts, entries, dimensions) or None without any).

    A round's sums come to the driver: entries * components numbers, whatever the number of vectors.
    """
    rows, width, kind = kept(vectors)
    width = max(parts, -(-width // parts) * parts)
    ids = [r[0] for r in rows.where("vec_id IS NOT NULL").select("vec_id").orderBy("vec_id").limit(entries).collect()]
    start = rows.where(F.col("vec_id") <= ids[-1]) if len(ids) == entries else rows
    start = [r[0] for r in start.orderBy(F.col("vec_id").asc_nulls_last(), "packed").limit(entries).select("packed").collect()]
    types = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    if not start:
        return rows.sparkSession.createDataFrame([], schema), None
    first = np.concatenate(list(components(pa.array([bytes(s) for s in start], pa.binary()), width, kind)))
    books = np.stack(np.split(first, parts, axis=1))
    for _ in range(rounds):
        found = rows.select("packed").mapInArrow(_sums(books, width, kind), "place long, total long, n long")
        for r in found.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books.reshape(-1)[r["place"]] = r["total"] // r["n"]
    return rows.mapInArrow(_codes(books, width, kind), schema), books


def op12_vector_codes(vectors: DataFrame) -> DataFrame:
    """Codes, errors and the errors of equal labels of every vector, and the digest of the codebooks.

    Null vectors and those with null or non-finite components are dropped.  Vectors of fewer components than the longest
    are filled up with zeros, and so is a length that 8 does not divide.  Components so large (at 64 components: 32,768)
    that a squared distance would not fit 63 bits count as the largest that does.  Vectors without an id come last in the
    choice of entries, those of one id in the order of their bytes; with fewer than 16 vectors the codebooks are
    shorter.  Equal vectors have equal codes.  No vectors: no rows.  Further columns are not looked at.
    """
    coded, books = compressed(vectors)
    said = "" if books is None else ",".join(map(str, books.reshape(-1).tolist()))
    coded = checkpointed(coded)
    sums = few(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, for vectors of one length that ``parts`` divides: distances to all entries, the rounds written out."""
    with_ = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"""parts AS MATERIALIZED (
            SELECT r, (i - 1) // (len(embedding) // {parts}) AS p, (i - 1) % (len(embedding) // {parts}) AS d, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
            FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept) AS u)""",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, d, v AS c FROM parts WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        with_.append(f"""near{k} AS MATERIALIZED (
            SELECT r, p, min_by(e, far * 1000 + e) AS e, min(far) AS far
            FROM (SELECT r, p, e, CAST(sum((v - c) * (v - c)) AS BIGINT) AS far FROM parts JOIN book{k} USING (p, d) GROUP BY ALL) AS u GROUP BY ALL)""")
        if k < rounds:
            with_.append(f"""book{k + 1} AS MATERIALIZED (
                SELECT p, e, d, coalesce(m, c) AS c FROM book{k} LEFT JOIN (
                    SELECT p, e, d, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM parts JOIN near{k} USING (r, p) GROUP BY ALL) AS u USING (p, e, d))""")
    with_.append(f"coded AS MATERIALIZED (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{rounds} GROUP BY ALL)")
    with_.append(f"said AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, d)) AS codebooks_sha256 FROM book{rounds})")
    return "WITH " + ",\n".join(with_) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r) CROSS JOIN said"
