"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import checkpointed


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge but the roots: root is the least node that the node reaches.

    ``edges``: (u, v) of one ordered type without nulls; loops and repeats do no harm.  Large-star and small-star steps
    alternate until nothing changes, each pair of them written to the shared folder.  The least neighbour is an aggregate that is
    joined back, so that a node with very many neighbours is combined on the map side and its join can be split.
    """
    now, seen = checkpointed(_ordered(edges)), None
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = _ordered(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = checkpointed(_ordered(small))
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == seen or row[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = row
