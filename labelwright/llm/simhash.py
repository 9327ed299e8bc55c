"""SimHash fingerprints and near-duplicate components by BK-trees.

A fingerprint has a bit for each bit that over half of the text's shingle hashes set.  Two fingerprints of 64 bits with
at most 3 differing bits agree on one of four 16-bit blocks, and the other 48 bits on one of four 12-bit parts: so each
distinct fingerprint goes to the 16 shards named by block, part and their 28 bits, and any linked pair meets in one.
A shard has a BK-tree, children keyed by their Hamming distance to the parent, and each of its fingerprints follows
only edges within the radius.  Trees come to their shard's task by shuffle, not by broadcast: their number and size
grow with the corpus.  A shard of over ``CHUNK`` fingerprints is dealt into chunks, and a task holds the tree of one
chunk and the queries of another, so that no task grows with a group.  Copies are one fingerprint from the start, and a
task returns the spanning links of what it joined, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.llm.common import Words, checkpointed, few, fresh_path, mix64, spare, text_pieces
from labelwright.llm.graph import components

#: Fingerprints of a shard that meet in one task.
CHUNK = 1024
#: Pairs of a shard that one numpy pass may visit.
VISITS = 1_000_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SEGMENT = 1 << 20
_BLANKS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def _segments(text: bytes) -> Iterator[bytes]:
    """A text in parts that end between words."""
    at = 0
    while len(text) - at > _SEGMENT:
        cut = max(text.rfind(b, at, at + _SEGMENT) for b in _BLANKS)
        if cut < at:  # a word longer than a segment ends at the next blank, or with the text
            later = [k for b in _BLANKS if (k := text.find(b, at + _SEGMENT)) >= 0]
            cut = min(later) if later else len(text) - 1
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of the shingles of ``width`` words, repeats included; 0 without words."""
    digest = xxhash.xxh64_digest
    ones, total, carry = np.zeros(64, np.int64), 0, []
    whole: list[bytes] = []
    text = text.translate(_LOWER)
    for part in _segments(text) if len(text) > _SEGMENT else (text,):
        words = carry + part.split()
        if total == 0 and len(words) < width:
            carry = whole = words
            continue
        found = b"".join([digest(x, seed) for x in map(b" ".join, zip(*(words[k:] for k in range(width))))])
        carry = words[len(words) - width + 1 :] if width > 1 else []
        if found:
            bits = np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(bits)
    if not total:
        if not whole:
            return 0
        return int.from_bytes(digest(b" ".join(whole), seed), "big")
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp long (the fingerprint's bits, signed).  A null text counts as empty."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).cast(pa.large_binary())
            found = np.array([fingerprint(x.as_py() or b"", width) for x in col], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(found)], names=[*keep, "fp"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def shard_keys(fp: Column) -> list[Column]:
    """(key, rest): the 16 shards of a 64-bit fingerprint for radius 3, and the 36 bits that a shard leaves open."""
    keys = []
    for block in range(4):
        at = 16 * block
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << at) - 1))
        high = F.shiftleft(F.shiftrightunsigned(fp, at + 16), at) if block < 3 else F.lit(0)
        rest = low.bitwiseOR(high)
        for part in range(4):
            sub = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(F.lit(0xFFF))
            open_low = rest.bitwiseAND(F.lit((1 << 12 * part) - 1))
            open_high = F.shiftleft(F.shiftrightunsigned(rest, 12 * (part + 1)), 12 * part) if part < 3 else F.lit(0).cast("long")
            key = F.lit((4 * block + part) << 28).bitwiseOR(F.shiftleft(sub, 16)).bitwiseOR(value)
            keys.append(F.struct(key.cast("long").alias("key"), open_low.bitwiseOR(open_high).cast("long").alias("rest")))
    return keys


def finer(rows: DataFrame) -> DataFrame:
    """``rows`` (node, key, rest) of shards of two nodes or more, with n, how many; a shard of over ``CHUNK`` is divided once more.

    Of the 36 open bits three may differ, so two linked fingerprints agree on one of four parts of nine: each node of a
    large shard goes to the four shards that the parts name.
    """
    sized = lambda df: df.join(df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    all_ = sized(rows)
    parts = F.array(*(F.xxhash64("key", F.lit(p), F.shiftrightunsigned("rest", 9 * p).bitwiseAND(F.lit(511))) for p in range(4)))
    large = all_.where(F.col("n") > CHUNK).select("node", "rest", F.explode(parts).alias("key"))
    return all_.where(F.col("n") <= CHUNK).select("node", "key", "n").unionByName(sized(large).select("node", "key", "n"))


def distances(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints a[at_a] and b[at_b], in one or more 64-bit words each; wide ones a part at a time."""
    if a.ndim == 1:
        return np.bitwise_count(a[at_a] ^ b[at_b]).astype(np.int64)
    out = np.empty(len(at_a), np.int64)
    for k in range(0, len(out), 1 << 16):
        s = slice(k, k + (1 << 16))
        out[s] = np.bitwise_count(a[at_a[s]] ^ b[at_b[s]]).sum(1, dtype=np.int64)
    return out


class BKForest:
    """BK-trees over fingerprints (n words, or n rows of words), one for each group; ``group`` ascends."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp, self.top = fp, 64 * (1 if fp.ndim == 1 else fp.shape[1])
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(fp) else np.zeros(0, np.int64)
        self.groups, self.roots = group[first], first
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.repeat(first, np.diff(np.concatenate([first, [len(fp)]])))
        rest = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        at = at[rest]
        while len(rest):
            edge, lead, which = np.unique(at * (self.top + 1) + distances(fp, rest, fp, at), return_index=True, return_inverse=True)
            keys.append(edge)
            children.append(rest[lead])
            stay = np.ones(len(rest), bool)
            stay[lead] = False
            rest, at = rest[stay], rest[lead][which][stay]
        key, child = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def search(self, fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of every tree node of the query's group within the radius."""
        slot = np.searchsorted(self.groups, group)
        known = slot < len(self.groups)
        known[known] = self.groups[slot[known]] == group[known]
        q = np.flatnonzero(known)
        node = self.roots[slot[q]]
        found_q, found_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(q):
            d = distances(fp, q, self.fp, node)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            lo = np.searchsorted(self.key, node * (self.top + 1) + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * (self.top + 1) + np.minimum(d + radius, self.top), "right")
            n = hi - lo
            q = np.repeat(q, n)
            node = self.child[np.repeat(lo - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
        return np.concatenate(found_q), np.concatenate(found_n)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n items the least one that the pairs (a, b) connect it to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def similar(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of the sets (sorted distinct values) have a Jaccard similarity of at least ``SIMILARITY``."""
    out = np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = sets[i], sets[j]
        if min(len(x), len(y)) * 100 < round(SIMILARITY * 100) * max(len(x), len(y)) or not len(x):
            continue
        both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
        out[k] = both * 100 >= round(SIMILARITY * 100) * (len(x) + len(y) - both)
    return out


def verified(n: int, a: np.ndarray, b: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """``spanning`` over those of the pairs (a, b) whose sets are similar; pairs of items already joined are not compared."""
    label = np.arange(n)
    links = [np.zeros((2, 0), np.int64)]
    order = np.lexsort([a, b])
    a, b = a[order], b[order]
    while True:
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return label
        lead = np.zeros(len(a), bool)
        lead[np.unique(b, return_index=True)[1]] = True
        ok = similar(sets, a[lead], b[lead])
        links.append(np.stack([a[lead][ok], b[lead][ok]]))
        a, b = a[~lead], b[~lead]
        if ok.any():
            label = spanning(n, *np.concatenate(links, axis=1))


def _shard_links(radius: int, wide: bool = False):
    """Rows of (key, lo, hi, node, chunk), sorted by shard, and bits and set binary if ``wide`` (else node is the fingerprint): links of nodes."""

    def solve(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, node: np.ndarray, chunk: np.ndarray, bits: np.ndarray, sets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        change = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.concatenate([[0], np.cumsum(change)])
        sizes = np.bincount(group)
        ends, out = np.cumsum(sizes), []
        cost, g0 = np.cumsum(sizes.astype(np.int64) ** 2), 0
        while g0 < len(sizes):
            g1 = max(g0 + 1, int(np.searchsorted(cost, (cost[g0 - 1] if g0 else 0) + VISITS, "right")))
            s = slice(ends[g0] - sizes[g0], ends[g1 - 1])
            f, g, name = bits[s], group[s], node[s]
            at = np.flatnonzero(chunk[s] == lo[s])
            forest = BKForest(f[at], g[at])
            ask = np.flatnonzero(chunk[s] == hi[s])
            q, found = forest.search(f[ask], g[ask], radius)
            label = spanning(len(f), ask[q], at[found]) if sets is None else verified(len(f), ask[q], at[found], sets[s])
            moved = np.flatnonzero(label != np.arange(len(f)))
            out.append((name[moved], name[label[moved]]))
            g0 = g1
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    names = ("key", "lo", "hi", "node", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
            u, v = solve(*rows)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            if wide:
                data = b"".join(batch.column(batch.schema.get_field_index("bits")).to_pylist())
                rows.append(np.frombuffer(data, np.uint64).reshape(batch.num_rows, -1))
                sets = np.empty(batch.num_rows, object)
                for i, x in enumerate(batch.column(batch.schema.get_field_index("set")).to_pylist()):
                    sets[i] = np.frombuffer(x, np.uint32)
                rows.append(sets)
            else:
                rows.append(rows[3].astype(np.uint64))
            if held is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield flush([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield flush(held)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, n, node, ...) of shards of n nodes, dealt so that no task holds more than two chunks of a shard."""
    rows = rows.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    rows = rows.withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("node"), F.col("chunks"))).otherwise(0).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "chunks", "n")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v): links of distinct fingerprints (fp long) that connect just what differs in at most 3 bits."""
    if radius > 3:
        raise ValueError("the 16 shards guarantee radius 3 at most")
    rows = fps.select(F.col("fp").alias("node"), F.explode(F.array(*shard_keys(F.col("fp")))).alias("s")).select("node", "s.*")
    rows = _dealt(finer(rows)).select("key", "lo", "hi", "node", "chunk")
    return rows.mapInArrow(_shard_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    Rows link if their fingerprints differ in at most ``radius`` bits; component_id is the least doc_id that a row
    reaches, itself included, nulls left out (null if all are).  Null and empty texts have fingerprint 0 and link like
    any other.  Repeated ids and texts keep their rows; ties cannot arise.  Further columns are not looked at.
    """
    marked = checkpointed(fingerprints(docs, text, width))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, radius))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = with_least(nodes, "component_id").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def with_least(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (root, least, ...) and the least of each root's; only roots of several nodes are joined, so that no root is hot."""
    top = nodes.groupBy("root").agg(F.min("least").alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return nodes.join(few(top), "root", "left").withColumn(name, F.coalesce("_least", "least")).drop("_least")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Null, empty and blank texts have fingerprint zero and link like others.  Repeated rows keep their places, and so do rows of
    one id with different texts.  A very long text is read whole by one task, cut between words.  No documents: no rows.  Further
    columns are not looked at.
    """
    return near_duplicates(documents).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: Wide fingerprints: bits, the similarity of the five-word shingle sets that links two texts, and the radius within which
#: sets of that similarity lie.  Four shingles and the same with a fifth differ most: in 96 of 512 bits, with a deviation of 9.
WIDE_BITS, SIMILARITY, WIDE_RADIUS = 512, 0.8, 136
#: Shards of wide fingerprints: a text is in one for each band of min-hashes, and misses a text of similarity s in all of
#: them with probability (1 - s ** ROWS) ** BANDS, a hundred-thousandth at 0.8.
BANDS, ROWS = 16, 3
_STEP = 16_384


def wide_signatures(col: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(rows x words fingerprints, rows x BANDS shard keys, two digests of each row's words, sorted 32-bit set) of the texts' shingles; no words: zeros."""
    w = Words(col)
    h = w.hashes()
    at, s = w.shingles(width, h)
    row = w.doc[at] if len(at) else np.zeros(0, np.int64)
    n = np.bincount(row, minlength=w.rows)
    some, first = np.flatnonzero(n), np.concatenate([[0], np.cumsum(n)])[:-1]
    lanes = WIDE_BITS // 64
    ones = np.zeros((w.rows, WIDE_BITS), np.int64)
    for lo in range(0, len(s), _STEP):
        part, own = s[lo : lo + _STEP], row[lo : lo + _STEP]
        words = np.stack([mix64(part + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))) for j in range(lanes)], axis=1)
        bits = np.unpackbits(words.view(np.uint8), axis=1).view(np.uint64)  # eight counters of a byte in each word
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        cuts = np.unique(np.concatenate([begin, *(np.arange(a, b, 255) for a, b in zip(begin, [*begin[1:], len(own)]) if b - a > 255)]))
        np.add.at(ones, own[cuts], np.add.reduceat(bits, cuts, axis=0).view(np.uint8).reshape(len(cuts), WIDE_BITS).astype(np.int64))
    fps = np.packbits(2 * ones > n[:, None], axis=1).view(np.uint64)
    keys = np.zeros((w.rows, BANDS), np.uint64)
    if len(some):
        for b in range(BANDS):
            for r in range(ROWS):
                odd = np.uint64(int(mix64(np.array([b * ROWS + r + 1], np.uint64))[0]) | 1)
                keys[some, b] = mix64(keys[some, b] * np.uint64(0x8CB92BA72F3D8DD7) + np.minimum.reduceat(s * odd, first[some]))
    node, check = w.digests()
    low = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    sets = [np.unique(low[a : a + k]) for a, k in zip(first, n)]
    return fps, keys, node, check, sets


def wide_near_duplicates(docs: DataFrame, text: str = "text", width: int = 5, radius: int = WIDE_RADIUS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and root long of every row: ``near_duplicates`` by wide fingerprints of longer shingles, for a similarity rather than bits.

    Rows link if they have one root.  Shards are bands of min-hashes, since blocks of bits guarantee nothing at such a
    radius.  Texts of the same words are one from the start; null and empty texts are one another's copies.  Fingerprints
    only choose the pairs to compare: two texts link if their shingle sets have a Jaccard similarity of ``SIMILARITY``.
    Repeated rows keep their places.  Texts are told apart by a digest of 128 bits of their words.
    """
    kept = [spare(docs, "_c") + str(k) for k in range(len(keep))]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(kept, keep)] + T._parse_datatype_string("node long, check long, bits binary, set binary, keys array<long>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_pieces(batches, text):
            fps, keys, digest, check, sets = wide_signatures(batch.column(batch.schema.get_field_index(text)), width)
            tagged = (keys & np.uint64((1 << 60) - 1)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(60))
            flat = pa.array(tagged.astype(np.int64).ravel())
            at = pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32())
            cols = [pa.array(digest.astype(np.int64)), pa.array(check.astype(np.int64)), pa.array([f.tobytes() for f in fps], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.ListArray.from_arrays(at, flat)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *cols], names=schema.names)

    marked = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(kept, keep)), F.col(text)).mapInArrow(run, schema)
    out = fresh_path(docs.sparkSession, "signatures")
    marked.write.parquet(out)
    marked = told_apart(docs.sparkSession.read.parquet(out))
    nodes = checkpointed(marked.groupBy("node").agg(F.first("keys").alias("keys")))
    rows = nodes.select("node", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "key")
    bits = marked.select("node", "bits", "set").join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first(F.struct("bits", "set")).alias("one")).select("node", "one.bits", "one.set")
    rows = _dealt(rows.join(bits, "node")).select("key", "lo", "hi", "node", "chunk", "bits", "set")
    roots = few(components(rows.mapInArrow(_shard_links(radius, wide=True), "u long, v long")))
    out = marked.select(*kept, "node").join(roots, "node", "left")
    return out.select(*(F.col(n).alias(c) for n, c in zip(kept, keep)), F.coalesce("root", "node").alias("root"))


def told_apart(marked: DataFrame) -> DataFrame:
    """``marked`` (node, check, ...) with another node for texts that share a first digest but not the second."""
    same = marked.groupBy("node").agg((F.min("check") != F.max("check")).alias("differ")).where("differ").select("node")
    same = few(same)
    if not same.limit(1).count():
        return marked
    odd = same.withColumn("odd", F.lit(True))
    return marked.join(odd, "node", "left").withColumn("node", F.when(F.col("odd"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("odd")
