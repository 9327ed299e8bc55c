"""Checks of dictionaries, buckets and edits; every check gives rows of (check, location, message)."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwright.functions.text import axis_prefix, dict_key, is_blank, strip

DISPOSITIONS = ("map", "detail", "ignore", "defer")


def issue(df: DataFrame, check: str, location: Column, message: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), location.alias("location"), message.alias("message"))


def bucket_overlaps(buckets: DataFrame) -> DataFrame:
    """Buckets (kind, pos, min, max) whose bounds are crossed or that overlap the one before; gaps are allowed."""
    w = Window.partitionBy("kind").orderBy("min", "max")
    b = buckets.withColumn("before", F.lag("max").over(w))
    where = F.concat_ws("/", "kind", F.col("pos").cast("string"))
    return issue(b.where("min > max"), "bucket_bounds", where, F.lit("min is over max")).unionByName(issue(b.where("before >= min"), "bucket_overlap", where, F.lit("overlaps the bucket before")))


def bucket_gaps(buckets: DataFrame) -> DataFrame:
    """The strict check: in the order listed each bucket begins right after the one before, bounds are not crossed, and labels are not blank."""
    w = Window.partitionBy("kind").orderBy("pos")
    b = buckets.withColumn("before", F.lag("max").over(w))
    where = F.concat_ws("/", "kind", F.col("pos").cast("string"))
    gap = issue(b.where("min <> before + 1"), "bucket_order", where, F.lit("does not begin after the bucket before"))
    crossed = issue(b.where("min > max"), "bucket_bounds", where, F.lit("min is over max"))
    return gap.unionByName(crossed).unionByName(issue(b.where(is_blank(F.col("label"))), "bucket_label", where, F.lit("label is blank")))


def era_overlaps(buckets: DataFrame) -> DataFrame:
    """As ``bucket_overlaps`` with open bounds."""
    return bucket_overlaps(buckets.withColumn("min", F.coalesce("min", F.lit(-(10**9)))).withColumn("max", F.coalesce("max", F.lit(10**9))))


def key_collisions(raw_keys: DataFrame) -> DataFrame:
    """Keys (column raw) that become one when normalised."""
    n = raw_keys.groupBy(dict_key(F.col("raw")).alias("key")).agg(F.countDistinct("raw").alias("n"), F.array_sort(F.collect_set("raw")).alias("raws")).where("n > 1")
    return issue(n, "key_collision", F.col("key"), F.array_join("raws", " | "))


def duplicate_keys(raw_keys: DataFrame) -> DataFrame:
    n = raw_keys.groupBy("raw").agg(F.count("*").alias("n")).where("n > 1")
    return issue(n, "duplicate_key", F.col("raw"), F.col("n").cast("string"))


def unknown_outputs(outputs: DataFrame, rules: DataFrame, canonical: DataFrame, computed_axes: list[str]) -> DataFrame:
    """Outputs of map and defer rules with an axis of their own spelling that names nothing canonical; unprefixed and computed ones pass."""
    o = outputs.join(rules.where("disposition IN ('map', 'defer')").select("key"), "key", "left_semi").withColumn("axis", F.rtrim(F.replace(axis_prefix(F.col("output")), F.lit(":"))))
    o = o.where(F.col("axis").isNotNull() & ~F.col("axis").isin(*computed_axes)).join(canonical.select(F.col("name").alias("output")).distinct(), "output", "left_anti")
    return issue(o, "unknown_output", F.col("key"), F.col("output"))


def wrong_outputs(rules: DataFrame, outputs: DataFrame) -> DataFrame:
    """Rules whose disposition and outputs disagree: mapped ones need an output, ignored and deferred ones have none."""
    n = outputs.groupBy("key").agg(F.count("*").alias("n"))
    r = rules.join(n, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = (F.col("disposition").isin("map", "detail") & (F.col("n") == 0)) | (F.col("disposition").isin("ignore", "defer") & (F.col("n") > 0))
    return issue(r.where(bad), "outputs", F.col("key"), F.concat_ws(" has ", "disposition", F.concat(F.col("n").cast("string"), F.lit(" outputs"))))


def structure(rules: DataFrame, outputs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Required values, allowed dispositions, unique names, names without edge blanks."""
    a = issue(rules.where(is_blank(F.col("key"))), "required", F.lit("rules"), F.lit("key is blank"))
    b = issue(rules.where(F.col("disposition").isNull() | ~F.col("disposition").isin(*DISPOSITIONS)), "enum", F.col("key"), F.coalesce("disposition", F.lit("null")))
    c = issue(outputs.where(is_blank(F.col("output"))), "required", F.col("key"), F.lit("output is blank"))
    d = issue(canonical.groupBy("axis", "name").agg(F.count("*").alias("n")).where("n > 1"), "unique", F.col("axis"), F.col("name"))
    e = issue(canonical.where("name <> trim(name)"), "pattern", F.col("axis"), F.col("name"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def bad_patterns(spark: SparkSession, patterns: dict[str, str]) -> list[tuple[str, str]]:
    """(setting, error) of the settings' patterns that Python or Spark cannot compile; they are a handful."""
    out = []
    for name, p in patterns.items():
        try:
            re.compile(p)
            spark.range(1).select(F.lit("").rlike(p)).first()
        except (re.error, PySparkException) as e:
            out.append((name, str(e).partition("\n")[0]))
    return out


def new_name_issues(names: DataFrame, canonical: DataFrame) -> DataFrame:
    """New canonical names (axis, name) that the axis has already, that come twice, or that have edge blanks or no text."""
    have = names.join(canonical.select("axis", "name").distinct(), ["axis", "name"], "left_semi")
    twice = names.groupBy("axis", "name").agg(F.count("*").alias("n")).where("n > 1")
    odd = names.where(is_blank(F.col("name")) | (F.col("name") != strip(F.col("name"))))
    a = issue(have, "duplicate_name", F.col("axis"), F.col("name")).unionByName(issue(twice, "duplicate_name", F.col("axis"), F.col("name")))
    return a.unionByName(issue(odd, "name_pattern", F.col("axis"), F.col("name"))).distinct()


def edit_issues(edits: DataFrame) -> DataFrame:
    """Edits with a wrong disposition, a NUL byte in key or outputs, blank outputs, or a removal that comes with other changes."""
    key = F.coalesce("key", F.lit(""))
    a = issue(edits.where(is_blank(F.col("key"))), "required", F.lit("edits"), F.lit("key is blank"))
    b = issue(edits.where(F.col("disposition").isNotNull() & ~F.col("disposition").isin(*DISPOSITIONS)), "enum", key, F.col("disposition"))
    c = issue(edits.where(F.contains(key, F.lit("\0")) | F.coalesce(F.exists("outputs", lambda o: F.contains(o, F.lit("\0"))), F.lit(False))), "nul", F.lit("edits"), F.lit("key or output holds a NUL"))
    blank = issue(edits.where(F.coalesce(F.exists("outputs", is_blank), F.lit(False))), "required", key, F.lit("output is blank"))
    d = issue(edits.where(F.col("remove") & (F.col("disposition").isNotNull() | (F.size("outputs") > 0))), "exclusive", key, F.lit("remove comes alone"))
    return a.unionByName(b).unionByName(c).unionByName(blank).unionByName(d)


def all_issues(parts: list[DataFrame]) -> DataFrame:
    """Every defect of every check, without repeats."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def ordered_issues(parts: list[DataFrame]) -> DataFrame:
    """``all_issues`` with n: 1, 2, ... in the order of locations; of one location in the order of the checks that found them."""
    numbered = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    once = out.groupBy("check", "location", "message").agg(F.min("part").alias("part"))
    # the issues of a dictionary that people edit; one task orders them, as a list to be read
    order = Window.orderBy("location", "part", "check", "message")
    return once.withColumn("n", F.row_number().over(order).cast("long")).drop("part")
