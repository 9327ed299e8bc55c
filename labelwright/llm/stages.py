"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> docs.

Every stage works on all rows that it is given and returns the same columns but the last, which adds its own.  Further
columns, whatever their names, pass through.  A null text counts as empty; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm import bpe, decontaminate, secrets, simhash
from labelwright.llm import toxicity as weak
from labelwright.llm.common import checkpointed, few, spare, table
from labelwright.llm.queries import word_vocabulary


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id is in ``ids``; null matches null."""
    name = spare(docs, "_gone")
    gone = few(ids.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs.doc_id.eqNullSafe(gone[name]), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op 6 scores below one half.

    Each row is scored by itself from its whole text, however long; equal texts score alike, so repeated rows stay or go
    together, and there are no ties.  Rows of a null doc_id are scored as any other.
    """
    model = weak.fit(docs, table(spark, sf_dir, "labels"))
    name = spare(docs, "_toxicity")
    scored = weak.score(docs, model, keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (op 4 with wide fingerprints of five-word shingles) one row.

    That of the least doc_id stays, nulls last; of rows with one doc_id that of the least digest of its text; of rows with
    one text too, the least in the order of all columns.  What counts is the row's text, not its id: rows of one doc_id
    with different texts are different documents.  Null and empty texts are copies of each other.
    """
    digest, other = spare(docs, "_digest"), spare(docs, "_other")
    rows = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    groups = checkpointed(simhash.wide_near_duplicates(rows, keep=("doc_id", digest)).select("root", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(digest).alias("digest")).alias("row")))
    lead = few(groups.groupBy("root").agg(F.min("row").alias("lead"), F.count("*").alias("n")).where("n > 1").select("root", "lead"))
    several = groups.join(lead, "root")
    gone = few(several.where("row <> lead").select("row").distinct().select(F.col("row.doc_id").alias(other), F.col("row.digest").alias(other + "d")))
    again = few(several.where("row = lead").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row.doc_id").alias(other), F.col("row.digest").alias(other + "d")))
    same = lambda of: (rows[digest] == of[other + "d"]) & rows.doc_id.eqNullSafe(of[other])
    rest = rows.join(gone, same(gone), "left_anti")
    once = rest.join(again, same(again), "left_anti").select(*docs.columns)
    # rows that are equal in id and text: the least of each
    twice = rest.join(again, same(again), "left_semi").groupBy("doc_id", digest).agg(F.min(F.struct(*(c for c in docs.columns if c != "doc_id"))).alias(other))
    return once.unionByName(twice.select("doc_id", f"{other}.*").select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item (op 7).

    Rows of one doc_id are one document: all of them go if any of their texts holds an item.  A row of a null doc_id goes
    if any such row does.  Nothing depends on order.  A benchmark without words takes nothing away.
    """
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret that the forest of op 3 keeps replaced by ``[secret]``; n_chars follows the text.

    Rows are treated one by one and whole; null texts stay null with their n_chars.  Repeated rows stay repeated.
    """
    scanner = secrets.fit(secrets.rule_labels(checkpointed(secrets.find(docs, path="source"))))
    out = secrets.redacted(docs, scanner, path="source")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens, ids and the digests of ids and decoded text (op 10), which replace columns of these names.

    Rows are treated one by one and whole; null and empty texts have no ids.
    """
    return bpe.encode(docs, word_vocabulary(), keep_ids=True)
