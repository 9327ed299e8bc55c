"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelwright.llm import stages
from labelwright.llm.common import fresh_path, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.toxicity),
    ("near-duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("secrets", stages.secret_scan),
    ("encoding", stages.encoding),
]

#: Trained models and fingerprints are beyond SQL; tests/llm holds stages 1, 4 and 5 against versions without Spark, 2 and 3 through their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
