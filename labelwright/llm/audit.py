"""Interaction audit of document filters: what each filter removes in every order, what only it catches, and its Shapley share.

Every document becomes the set of filters that it fails.  Counts of documents by that set tell, for each of the 2^k
coalitions of filters, how many documents the coalition removes; differences of coalitions are the steps of any order.
Shapley shares come from the same table as a weighted least squares fit of an additive game, with Shapley kernel weights
and the shares bound to add up to what all filters remove, solved in rationals.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import checkpointed

#: A word, in Java's and RE2's patterns.
WORD = r"[^\x20\x09-\x0D]+"
#: Filters at most: coalitions double and orders multiply with each.
MOST = 6


def shapley(removes: list[int]) -> list[Fraction]:
    """Each filter's share of ``removes[-1]``; ``removes[s]`` is what the filters of bit set s remove together.

    Minimises sum over proper coalitions s of weight(s) * (removes[s] - sum of shares in s)^2 under the constraint that all
    shares add up to ``removes[-1]``: normal equations with one multiplier, by elimination without rounding.
    """
    k = len(removes).bit_length() - 1
    if k == 1:
        return [Fraction(removes[1] - removes[0])]
    a = [[Fraction(0)] * (k + 2) for _ in range(k + 1)]
    for s in range(1, 2**k - 1):
        inside = [i for i in range(k) if s >> i & 1]
        weight = Fraction(k - 1, comb(k, len(inside)) * len(inside) * (k - len(inside)))
        for i in inside:
            for j in inside:
                a[i][j] += weight
            a[i][-1] += weight * (removes[s] - removes[0])
    for i in range(k):
        a[i][k] = a[k][i] = Fraction(1)
    a[k][-1] = Fraction(removes[-1] - removes[0])
    for c in range(k + 1):
        pivot = next(r for r in range(c, k + 1) if a[r][c])
        a[c], a[pivot] = a[pivot], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(k + 1):
            if r != c and a[r][c]:
                a[r] = [x - a[r][c] * y for x, y in zip(a[r], a[c])]
    return [a[i][-1] for i in range(k)]


def _removed(cells: dict[int, int], k: int) -> list[int]:
    """For every coalition, the documents that fail any of its filters."""
    total = sum(cells.values())
    # what passes a coalition is what fails only filters outside of it: sums over subsets, one filter after another
    within = [cells.get(m, 0) for m in range(2**k)]
    for i in range(k):
        for m in range(2**k):
            if m >> i & 1:
                within[m] += within[m ^ (1 << i)]
    return [total - within[(2**k - 1) ^ s] for s in range(2**k)]


def _orders(letters: str, columns: list[str]):  # noqa: ANN202
    k = len(letters)
    plans = [("".join(letters[i] for i in p), p) for p in permutations(range(k))]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, cells in zip(batch["part"], batch["cells"]):
                n, good, toxic = (_removed({c["mask"]: int(c[name]) for c in cells}, k) for name in ("n", "good", "toxic"))
                total, everything = sum(int(c["n"]) for c in cells), 2**k - 1
                shares = [x * factorial(k) for x in shapley(n)]
                rows = []
                for name, plan in plans:
                    before = 0
                    for step, i in enumerate(plan, 1):
                        after = before | 1 << i
                        gone = n[after] - n[before]
                        rows.append((part, name, step, letters[i], total - n[after], gone, n[1 << i] - gone, n[everything] - n[everything ^ (1 << i)], good[after] - good[before], toxic[after] - toxic[before], int(shares[i])))
                        before = after
                yield pd.DataFrame(rows, columns=columns)

    return each


def audit(facts: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters, step by step, in every part.

    ``facts``: part (string), mask (bit i: fails filter i of ``letters``), and the counts n, good and toxic of documents.
    Returns part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    A part's rows come down to at most 2^k sums before they meet.
    """
    if not 1 <= len(letters) <= MOST or len(set(letters)) != len(letters):
        raise ValueError(f"1 to {MOST} different letters")
    cells = facts.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    cells = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    schema = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return cells.mapInPandas(_orders(letters, [x.split()[0] for x in schema.split(", ")]), schema)


def failures(docs: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text) and mask of the failed ``filters``, conditions on ``_text`` and its ``_words``.

    Bit i of the mask is that of the i-th filter.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), 0))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    return rows.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def repeats(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` (doc_id, digest, mask, ...) with ``bit`` added to the mask of those whose digest a smaller doc_id has.

    Rows meet the first id of their digest under both keys, so that a group of copies, however large, is dealt by its ids.
    """
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    known = rows.where("doc_id IS NOT NULL").join(first, ["doc_id", "digest"], "left")
    known = known.withColumn("mask", F.col("mask") + F.when(F.col("_first").isNull(), bit).otherwise(0)).drop("_first")
    return known.unionByName(rows.where("doc_id IS NULL"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic, one row a document: labelled with quality 1 or toxic 1 in any row of its id."""
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    known = rows.where("doc_id IS NOT NULL").join(told, "doc_id", "left").select("part", "mask", "_good", "_toxic")
    none = F.lit(None).cast("int")
    known = known.unionByName(rows.where("doc_id IS NULL").select("part", "mask", none.alias("_good"), none.alias("_toxic")))
    return known.select("part", "mask", F.lit(1).cast("long").alias("n"), F.coalesce("_good", F.lit(0)).cast("long").alias("good"), F.coalesce("_toxic", F.lit(0)).cast("long").alias("toxic"))


def text_filters() -> dict[str, Column]:
    """The filters A to D: few words, repeated words, many capitals, markup characters."""
    text, n = F.col("_text"), F.size("_words")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": F.size(F.array_distinct("_words")) * 100 < n * 80, "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * 10, "D": text.rlike(r"[#$%&*|]")}


def op11_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Filters A to E over whole texts, in all 120 orders, a part for each language.

    Null texts are empty texts, null languages the part "".  Rows without an id take part, have no labels, and neither fail E
    nor make others fail it; rows that repeat an id and text do not fail E by each other.  Very long texts are read whole.
    No documents: no rows.  Further columns of either table are not looked at.
    """
    filters = text_filters()
    rows = checkpointed(failures(docs, filters))
    return audit(with_labels(repeats(rows, 1 << len(filters)), labels), "".join(filters) + "E")


ORACLE_SQL = r"""
WITH told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
fails AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
           + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
           + (CASE WHEN texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
    FROM texts LEFT JOIN told ON texts.doc_id = told.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY 1, 2),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(x, b)),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
    FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS bit, list_sum(bits[1:s]) - bits[s] AS before, substr(filter_order, s, 1) AS filter FROM orders, (SELECT unnest(range(1, 6)) AS s) AS u),
counted AS (
    SELECT part, filter_order, step, filter, CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
           CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
           CAST(sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
           CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
           CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
           CAST(sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM cells CROSS JOIN steps GROUP BY 1, 2, 3, 4, bit, before)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counted"""
