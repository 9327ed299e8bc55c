"""Mixing sources to target weights: exact block quotas, split over output shards, drawn as permuted blocks.

The words of a source's documents, one document after another in a random order, are its stream, cut into blocks of equal
length.  A source's target becomes a quota of blocks; one pass over all its blocks in a permuted order is an epoch, and a
quota of more than one epoch goes on with the next, so that a place in the draw is an epoch and a block.  A binary tree
over the output shards halves the blocks at every node: how many of each source go left is a multivariate hypergeometric
draw, exactly what a shuffle of all drawn blocks would give, without shuffling them.  A leaf holds a range of every source's
draw; the ranges are disjoint and cover the quotas.  Blocks are shuffled within their shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.llm.common import checkpointed, few, fresh_path, mix64

#: Weights of the sources in their order, repeating; a document is taken so many times at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block, of which a source has FINE at least if it has as many words; blocks of a shard.
BLOCK_WORDS, FINE, SHARD_BLOCKS = 256, 1024, 8192
#: Blocks of a whole mix, below what numpy draws from; larger mixes have longer blocks.
ALL_BLOCKS = 400_000_000
WORD = r"[^\x20\x09-\x0D]++"
SEED = 13


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and h (a hash of id and text, which orders a source's documents)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", text, F.lit(SEED)).alias("h"))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with nth, from 0 in code point order, null last: numbered within ranges, then by what stands before a range."""
    width = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = checkpointed(sources.repartitionByRange(width, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    before, at = {}, 0
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():  # one row a range
        before[r["_range"]], at = at, at + r["count"]
    if not before:
        return ranges.select(*sources.columns, F.lit(0).cast("long").alias("nth"))
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("_range"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1 + offset
    return ranges.withColumn("nth", nth.cast("long")).drop("_range")


def weight(nth: Column, weights: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (nth, source_size) with target: shares of all sizes by weight, none above ``most`` times its source's size.

    The level, a target of weight 1, rises until no further source is above its limit; each step is one sum over the sources.
    """
    rows = sources.withColumn("_w", weight(F.col("nth"), weights))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = Fraction(0), -1
    if total:
        level = Fraction(total, int(rows.agg(F.sum("_w")).first()[0]))
    big = "decimal(38,0)"
    above = lambda: F.col("source_size").cast(big) * F.lit(most * level.denominator).cast("decimal(19,0)") < F.col("_w").cast(big) * F.lit(level.numerator).cast("decimal(19,0)")
    while total:
        n, limited, rest = rows.agg(F.count_if(above()), F.sum(F.when(above(), F.col("source_size") * most)), F.sum(F.when(~above(), F.col("_w")))).first()
        if n == full or not rest:
            break
        full, level = n, Fraction(total - int(limited or 0), int(rest))
    share = F.col("_w") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    return rows.withColumn("target", F.when(above(), F.col("source_size") * float(most)).otherwise(share)).drop("_w")


def with_quotas(sources: DataFrame, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``sources`` with block (words of one), blocks (in its stream) and quota (blocks that the mix draws)."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    longest = max(block_words, -(-total // ALL_BLOCKS))
    block = F.greatest(F.lit(1), F.least(F.lit(longest), F.expr(f"source_size div {FINE}"))).cast("long")
    rows = sources.withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    quota = F.floor(F.col("target") * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1)) + 0.5).cast("long")
    return rows.withColumn("quota", F.least(quota, F.col("blocks") * most))


def _split(depth: int, seed: int):  # noqa: ANN202
    """Subtrees of ``depth`` levels: rows (node, nth, low, n) of one node become those of its 2^depth descendants."""

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        nth, out = rows["nth"].to_numpy(), []
        stack = [(int(rows["node"].iloc[0]), depth, np.arange(len(rows)), rows["low"].to_numpy(), rows["n"].to_numpy())]
        while stack:
            node, left, at, low, n = stack.pop()
            if not left:
                out.append(pd.DataFrame({"node": node, "nth": nth[at], "low": low, "n": n}))
                continue
            draw = np.random.Generator(np.random.PCG64([seed, node])).multivariate_hypergeometric(n, int(n.sum()) // 2, method="marginals")
            for child, a, b in ((2 * node, low, draw), (2 * node + 1, low + draw, n - draw)):
                some = np.flatnonzero(b)
                if len(some):
                    stack.append((child, left - 1, at[some], a[some], b[some]))
        return pd.concat(out)

    return each


def split(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """nth, shard, low, n: which places of every source's draw go to each of 2^depth shards; sources without any have no row.

    ``quotas``: nth, quota.  The upper half of the levels is one task with one number a source, the lower half a task for
    each of its nodes.
    """
    schema = "node long, nth long, low long, n long"
    rows = quotas.where("quota > 0").select(F.lit(1).cast("long").alias("node"), "nth", F.lit(0).cast("long").alias("low"), F.col("quota").alias("n"))
    for levels in (depth // 2, depth - depth // 2):
        if levels:
            rows = rows.groupBy("node").applyInPandas(_split(levels, seed), schema)
    return rows.select("nth", (F.col("node") - 2**depth).alias("shard"), "low", "n")


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1 by ``key``, elementwise: a Feistel network over the next power of four, walked until within n."""
    half = np.zeros(len(n), np.uint64)
    while (short := (np.uint64(1) << (np.uint64(2) * half)) < n.astype(np.uint64)).any():
        half[short] += np.uint64(1)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], low[todo], key[todo]
        a, b = x >> h, x & m
        for r in range(rounds):
            a, b = b, a ^ (mix64(b + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        out[todo] = a << h | b
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _drawn(columns: list[str], seed: int):  # noqa: ANN202
    """Every drawn overlap of a document with a block."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 2000):
                part = rows.iloc[k : k + 2000]
                start, size, block, blocks, quota, nth = (part[c].to_numpy(np.int64) for c in ("start", "size", "block", "blocks", "quota", "nth"))
                first, last = start // block, (start + size - 1) // block
                epochs = -(-quota // blocks)
                times = (last - first + 1) * epochs
                row = np.repeat(np.arange(len(part)), times)
                i = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                b, epoch = first[row] + i // epochs[row], i % epochs[row]
                key = mix64(nth[row].astype(np.uint64) * np.uint64(1 << 20) + epoch.astype(np.uint64) + np.uint64(seed << 8))
                place = epoch * blocks[row] + permuted(b, blocks[row], key)
                take = place < quota[row]
                row, b, epoch, place = row[take], b[take], epoch[take], place[take]
                begin = np.maximum(start[row], b * block[row])
                end = np.minimum(start[row] + size[row], (b + 1) * block[row])
                out = part[columns].iloc[row].reset_index(drop=True)
                yield out.assign(epoch=epoch.astype(np.int32), block=b, place=place, first_word=begin - start[row], words=end - begin)

    return each


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with their source's columns and start, the words before them in its stream.

    A source's documents are dealt into about as many buckets as a bucket has documents; starts add up within a bucket,
    then over the buckets before, so that no task holds a source.
    """
    s = few(sources.withColumnRenamed("source", "_source"))
    both = rows.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    both = both.withColumn("_bucket", F.pmod(F.xxhash64("h"), F.ceil(F.sqrt("documents")).cast("long")))
    inside = Window.partitionBy("nth", "_bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.groupBy("nth", "_bucket").agg(F.sum("size").alias("_all"))
    before = Window.partitionBy("nth").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_before", F.sum("_all").over(before) - F.col("_all")).drop("_all")
    out = both.withColumn("_run", F.sum("size").over(inside) - F.col("size")).join(sums, ["nth", "_bucket"])
    return out.withColumn("start", F.col("_before") + F.col("_run")).drop("_bucket", "_run", "_before", "h", "documents")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with nth, start, size, source_size and target; the mix), both in the shared folder.

    The mix has a row for every piece of a document: shard, slot (its turn within the shard), nth and start (which tell the
    document), doc_id, first_word, words, epoch, block, place.  ``texts`` gives the words themselves.
    """
    rows = checkpointed(sized(docs))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    sources = checkpointed(with_quotas(with_targets(numbered(sources), weights, most), most, block_words))
    documents = checkpointed(placed(rows, sources))
    blocks = sources.agg(F.sum("quota")).first()[0] or 0
    depth = max(0, (-(-blocks // shard_blocks) - 1).bit_length())
    # ranges of places meet pieces by the bin of the draw in which they lie; a bin is about one range long
    wide = sources.select("nth", F.greatest(F.lit(1), F.ceil(F.col("quota") / 2**depth)).cast("long").alias("wide"))
    ranges = split(sources.select("nth", "quota"), depth, seed).join(few(wide), "nth")
    bins = F.sequence(F.expr("low div wide"), F.expr("(low + n - 1) div wide"))
    ranges = few(ranges.select("nth", F.explode(bins).alias("bin"), "shard", "low", (F.col("low") + F.col("n")).alias("high")))
    carried = ["nth", "start", "doc_id"]
    types = {c: documents.schema[c].dataType.simpleString() for c in carried}
    schema = ", ".join(f"{c} {t}" for c, t in types.items()) + ", epoch int, block long, place long, first_word long, words long"
    drawn = documents.where("size > 0 AND quota > 0").select(*carried, "size", "block", "blocks", "quota").mapInPandas(_drawn(carried, seed), schema)
    drawn = drawn.join(few(wide), "nth").withColumn("bin", F.expr("place div wide")).drop("wide")
    shards = drawn.join(ranges, ["nth", "bin"]).where("place >= low AND place < high").drop("bin", "low", "high")
    turn = Window.partitionBy("shard").orderBy(F.xxhash64("nth", "place", F.lit(seed)), "nth", "place", "start")
    path = fresh_path(docs.sparkSession, "mix")
    shards.withColumn("slot", F.row_number().over(turn).cast("long")).write.parquet(path)
    return documents, docs.sparkSession.read.parquet(path)


def texts(mix: DataFrame, docs: DataFrame) -> DataFrame:
    """shard, slot, doc_id, piece: the words of every piece, joined by one space; ids are unique."""
    words = docs.select("doc_id", F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), 0).alias("_words"))
    piece = F.array_join(F.slice("_words", (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), " ")
    return mix.join(words, "doc_id").select("shard", "slot", "doc_id", piece.alias("piece"))


def op13_mix(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document: the words of its pieces in all shards.

    Null and empty texts have size 0 and nothing taken; a null source is a source of its own, behind the others, and so
    is the empty string, before them.  Repeated rows are documents of their own, of which either may be taken.  A very long text is cut into
    blocks like any other.  Taken words of a source miss its target by less than a block or two, of a thousandth of the source
    at most (of one word, if it has few).  No documents: no rows.  Further columns are not looked at.
    """
    documents, mix = mixed(docs)
    taken = mix.groupBy("nth", "start").agg(F.sum("words").alias("taken"))
    some = documents.where("size > 0").join(taken, ["nth", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = documents.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)
