"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine, a new temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    set_to = sc.getConf().get("spark.checkpoint.dir")
    if not set_to:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            set_to = known.get()
        elif sc.master.startswith("local"):
            set_to = f"file://{tempfile.mkdtemp(prefix='spark-')}"
            sc.setCheckpointDir(set_to)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return set_to.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from files in the shared folder; the files of the shuffles that led to it are removed as soon as it is written, not when the driver's garbage is collected."""
    conf, key, path = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", fresh_path(df.sparkSession, name)
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
