"""The registered queries of this subpackage: name -> function of (spark, sf_dir), and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelwright.llm import audit, bpe, decontaminate, extract, mixing, passages, quality, secrets, simhash, sketch, toxicity, vectors, warc
from labelwright.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.op5_passages(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op6_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op7_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.op8_extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op10_bpe(table(spark, sf_dir, "documents"), word_vocabulary())


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.op1_fingerprints(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op2_warc(table(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op3_secrets(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4_simhash(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.op11_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.op12_vector_codes(table(spark, sf_dir, "embeddings"))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op13_mix(table(spark, sf_dir, "documents"))


_ALL = (
    op1_fingerprints, op2_warc, op3_secrets, op4_simhash, op5_passages, op6_toxicity, op7_decontaminate, op8_extract, op9_quality, op10_bpe,
    op11_audit, op12_vector_codes, op13_mix,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {"op2_warc": warc.ORACLE_SQL, "op11_audit": audit.ORACLE_SQL, "op12_vector_codes": vectors.oracle_sql()}
