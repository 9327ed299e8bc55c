"""Resolution of the contributors and sources that providers name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(refs: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """``refs`` (item_id, pos, stored_id, remote_id, norm) with entity_id and outcome.

    ``known``: entity_id, remote_id, norm.  In order: the stored id exists (stored); a remote id matches (remote); just
    one entity has the name (name) or several do (ambiguous); else it is created, as long as the run has made fewer than
    ``cap`` new ones in order of item and position (create), or not (cap_exceeded).  A new name counts once.
    """
    stored = known.select(F.col("entity_id").alias("_stored")).distinct()
    remote = known.where("remote_id IS NOT NULL").groupBy(F.col("remote_id").alias("_remote")).agg(F.min("entity_id").alias("_by_remote"))
    named = known.groupBy(F.col("norm").alias("_norm")).agg(F.count("*").alias("_n"), F.min("entity_id").alias("_by_name"))
    r = refs.join(stored, F.col("stored_id") == F.col("_stored"), "left").join(remote, F.col("remote_id") == F.col("_remote"), "left").join(named, F.col("norm") == F.col("_norm"), "left")
    outcome = (
        F.when(F.col("_stored").isNotNull(), "stored").when(F.col("_by_remote").isNotNull(), "remote").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("create")
    )
    r = r.withColumn("outcome", outcome)
    entity = F.when(F.col("outcome") == "stored", F.col("stored_id")).when(F.col("outcome") == "remote", F.col("_by_remote")).when(F.col("outcome") == "name", F.col("_by_name"))
    r = r.withColumn("entity_id", entity).drop("_stored", "_remote", "_by_remote", "_norm", "_n", "_by_name")
    # only the first cap new names are wanted: a top-k, not a global order of all
    new = r.where("outcome = 'create'").groupBy(F.col("norm").alias("_new")).agg(F.min(F.struct("item_id", "pos")).alias("first"))
    within = new.orderBy("first", "_new").limit(cap).select("_new", F.lit(True).alias("_ok"))
    out = r.join(within, F.col("norm") == F.col("_new"), "left")
    return out.withColumn("outcome", F.when((F.col("outcome") == "create") & F.col("_ok").isNull(), "cap_exceeded").otherwise(F.col("outcome"))).drop("_new", "_ok")


def creation_need(resolved_refs: dict[str, DataFrame], caps: dict[str, int]) -> DataFrame:
    """kind, needed, cap, fits: how many entities a run would make, before it makes any."""
    out = None
    for kind, df in resolved_refs.items():
        n = df.where("outcome IN ('create', 'cap_exceeded')").agg(F.countDistinct("norm").alias("needed"))
        part = n.select(F.lit(kind).alias("kind"), "needed", F.lit(caps[kind]).cast("long").alias("cap"), (F.col("needed") <= caps[kind]).alias("fits"))
        out = part if out is None else out.unionByName(part)
    return out


def whole_lists(resolved_refs: DataFrame) -> DataFrame:
    """item_id, ids array in position order, of items all of whose contributors are or can be resolved; a list is never applied in part."""
    ok = F.bool_and(F.col("outcome").isin("stored", "remote", "name", "create"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("entity_id", F.concat(F.lit("new:"), "norm")).alias("id")))), lambda x: x.id)
    return resolved_refs.groupBy("item_id").agg(ok.alias("ok"), ids.alias("ids")).where("ok").drop("ok")


def first_created(resolved_refs: DataFrame) -> DataFrame:
    """One row for each name to create, with the reference that stands first."""
    first = F.row_number().over(Window.partitionBy("norm").orderBy("item_id", "pos"))
    return resolved_refs.where("outcome = 'create'").withColumn("n", first).where("n = 1").drop("n")
