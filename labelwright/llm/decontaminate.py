"""Benchmark decontamination: windows of a benchmark item's size whose shingles are those of the item.

A text holds an item if one of its windows of the item's number of words (the whole text if it is shorter) has a
weighted Jaccard similarity of at least ``SIMILARITY`` to it over 5-word shingles, weights being multiplicities.

1. Such a window shares at least ceil(SIMILARITY * m) of the item's m shingles, so it has one of any m - ceil(...) + 1
   of them: only the item's rarest so many are looked for.  A bitmap of fixed size goes to every task and passes over
   texts without any of them; what stays are short stretches of word hashes around the hits.
2. Hits meet items by a shuffle join on the shingle's hash; a benchmark of any size fits.  The words of a stretch follow
   once for each item that it may hold, however many hits they share.
3. Every item-sized window of a stretch that covers a hit gets a SimHash.  Windows and item are compared by
   multi-index Hamming blocks: with more blocks than the radius, fingerprints within it agree on a block.
4. What is left is verified exactly on the multisets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from labelwright.llm.common import Words, checkpointed, mix64, text_pieces

SIMILARITY = 0.8
WIDTH = 5
#: Bits of the bitmap of sought shingles: 2 MB whatever the benchmark's size.
BITMAP_BITS = 1 << 24
#: Differing bits of 64 that a window may have; at a similarity of 0.8 about 10 are expected, with a deviation of 3.
RADIUS = 21
BLOCKS = 22


def item_table(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, words array<long> (word hashes) and shingles array<long>; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            w = Words(batch.column(batch.schema.get_field_index(text)))
            h = w.hashes()
            ends = np.cumsum(w.count)
            words = [h[e - n : e] for e, n in zip(ends, w.count)]
            cols = [pa.array([x.astype(np.int64) for x in words], pa.list_(pa.int64())), pa.array([shingles(x).astype(np.int64) for x in words], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_item")), *cols], names=["_item", "words", "shingles"])

    schema = T.StructType([T.StructField("_item", items.schema[item].dataType), *T._parse_datatype_string("words array<long>, shingles array<long>").fields])
    return items.select(F.col(item).alias("_item"), text).mapInArrow(run, schema).where("size(words) > 0").distinct()


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of WIDTH words, as ``Words.shingles``; fewer words are one run."""
    k = min(WIDTH, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64))
    return mix64(out)


def sought(items: DataFrame) -> DataFrame:
    """(h, _item): of each item the shingles of which any window like it has at least one, the rarest among the items."""
    each = items.select("_item", F.size("shingles").alias("m"), F.explode(F.array_distinct("shingles")).alias("h"))
    n = each.groupBy("h").agg(F.count("*").alias("n"))
    order = Window.partitionBy("_item", "m").orderBy("n", "h")
    need = F.col("m") - F.ceil(F.col("m") * SIMILARITY) + 1
    return each.join(n, "h").withColumn("at", F.row_number().over(order)).where(F.col("at") <= need).select("h", "_item")


def bitmap(rows: DataFrame) -> np.ndarray:
    """The bits h mod BITMAP_BITS of column h; comes to the driver as at most BITMAP_BITS / 64 longs."""
    bit = F.pmod(F.col("h"), F.lit(BITMAP_BITS))
    one = F.expr(f"shiftleft(1L, cast(pmod(h, {BITMAP_BITS}) % 64 as int))")
    cells = rows.groupBy(F.floor(bit / 64).cast("int").alias("cell")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).astype(np.uint64)
    return out


def stretches(docs: DataFrame, bits: np.ndarray, widths: list[int], longest: int, text: str, keep: list[str]) -> DataFrame:
    """keep, first long (word number), words array<long>, hits array<long> (shingle hashes): the words around hits of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            w = Words(batch.column(batch.schema.get_field_index(text)))
            h = w.hashes()
            at, found = [], []
            for k in widths:
                first, s = w.shingles(k, h)
                b = s & np.uint64(BITMAP_BITS - 1)
                hit = (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
                at.append(first[hit])
                found.append(s[hit])
            if not at or not sum(map(len, at)):
                continue
            at, found = np.concatenate(at), np.concatenate(found)
            order = np.argsort(at, kind="stable")
            at, found = at[order], found[order]
            begin = np.concatenate([[0], np.cumsum(w.count)])[:-1]
            lo = np.maximum(at - longest, begin[w.doc[at]])
            hi = np.minimum(at + longest + WIDTH, (begin + w.count)[w.doc[at]])
            new = np.concatenate([[True], (w.doc[at[1:]] != w.doc[at[:-1]]) | (lo[1:] > hi[:-1])])
            # a long run of overlapping stretches is cut, so that no row grows with a text; each part keeps its whole surroundings
            starts = []
            for i in range(len(at)):
                if new[i] or at[i] - at[starts[-1]] > 8 * longest:
                    starts.append(i)
            ends = [*starts[1:], len(at)]
            rows = pa.array([int(w.doc[at[a]]) for a in starts], pa.int64())
            cols = [
                pa.array([int(lo[a] - begin[w.doc[at[a]]]) for a in starts], pa.int64()),
                pa.array([h[lo[a] : hi[b - 1]].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())),
                pa.array([np.unique(found[a:b]).astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(rows) for c in keep), *cols], names=[*keep, "first", "words", "hits"])

    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string("first long, words array<long>, hits array<long>").fields)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def simhashes(sh: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of each run of ``size`` shingles."""
    bits = np.unpackbits(sh.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[size:] - sums[:-size]
    return np.packbits(2 * ones > size, axis=1).view(">u8").ravel().astype(np.uint64)


def in_radius(fps: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Which of fps differ from fp in at most RADIUS bits, among those that agree with it on a block."""
    diff = fps ^ fp
    edges = np.linspace(0, 64, BLOCKS + 1).astype(int)
    agree = np.zeros(len(fps), bool)
    for a, b in zip(edges, edges[1:]):
        agree |= (diff >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) == 0
    out = np.zeros(len(fps), bool)
    out[agree] = np.bitwise_count(diff[agree]) <= RADIUS
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[ia], nb[ib]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def best_window(words: np.ndarray, item: np.ndarray) -> tuple[float, int] | None:
    """(similarity, first word) of the window most like the item, if any reaches SIMILARITY; the first of equals."""
    n = min(len(item), len(words))
    target = shingles(item)
    own = shingles(words) if len(item) >= WIDTH else np.array([shingles(words[i : i + n])[0] for i in range(len(words) - n + 1)], np.uint64)
    size = max(n - WIDTH + 1, 1)
    if len(own) < size:
        return None
    shared = np.concatenate([[0], np.cumsum(np.isin(own, target))])
    near = np.flatnonzero(shared[size:] - shared[:-size] >= SIMILARITY * len(target))
    near = near[in_radius(simhashes(own, size)[near], simhashes(target, len(target))[0])] if len(near) else near
    best = None
    for i in near:
        s = weighted_jaccard(own[i : i + size], target)
        if s >= SIMILARITY and (best is None or s > best[0]):
            best = s, int(i)
    return best


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """doc, item, similarity double, first_word, n_words long: every text and every item it holds, with the window most like it.

    Null and empty texts hold nothing; items without words are held by nothing.  Repeated rows with one id count as one
    document, and ties go to the first window.  Words are runs of other than ASCII white space, A-Z in lower case.
    """
    known = checkpointed(item_table(items, item))
    wanted = sought(known)
    size = known.agg(F.max(F.size("words")).alias("longest"), F.collect_set(F.least(F.size("words"), F.lit(WIDTH))).alias("widths")).first()
    out = f"{doc} {docs.schema[doc].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, similarity double, first_word long, n_words long"
    if not size.longest:
        return docs.sparkSession.createDataFrame([], out)
    wanted = checkpointed(wanted)
    # a stretch's number is written with it, so it is the same in both uses; hits meet items without the words
    rows = checkpointed(stretches(docs, bitmap(wanted), sorted(size.widths), size.longest, text, [doc]).withColumn("_stretch", F.monotonically_increasing_id()))
    pairs = rows.select("_stretch", F.explode("hits").alias("h")).join(wanted, "h").select("_stretch", "_item").distinct()
    rows = rows.select(doc, "_stretch", "first", "words").join(pairs, "_stretch").join(known.select("_item", F.col("words").alias("item_words")), "_item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found = [], []
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("words", "item_words", "first")}
            for i in range(batch.num_rows):
                words, target = (cols[c][i].values.to_numpy(zero_copy_only=False).astype(np.uint64) for c in ("words", "item_words"))
                best = best_window(words, target)
                if best:
                    take.append(i)
                    found.append((best[0], cols["first"][i].as_py() + best[1], min(len(words), len(target))))
            kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(take, pa.int64())) for c in (doc, "_item")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64())))], names=[doc, item, "similarity", "first_word", "n_words"])

    rows = rows.select(doc, "_item", "first", "words", "item_words").mapInArrow(verify, out)
    best = F.max_by(F.struct("similarity", "first_word", "n_words"), F.struct("similarity", -F.col("first_word"))).alias("b")
    return rows.groupBy(doc, item).agg(best).select(doc, item, "b.*")


def op7_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of every document that holds a benchmark item.

    Null and empty texts hold none, null and empty items are held by none.  Rows of one id are one document, of whose hits the most
    alike counts.  A very long text is read whole by one task.  No documents or no items: no rows.  Further columns are not
    looked at.
    """
    return contaminated(documents, benchmark)
