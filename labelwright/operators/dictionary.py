"""The dictionary: raw label -> disposition and outputs; loading, lookup, comparison, edits and build."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwright.functions.text import axis_prefix, dict_key, pointer_part

#: Rules of a dictionary that may be broadcast; beyond it Spark chooses the join.
BROADCAST_RULES = 200_000
DISPLAY = {"map": "mapped", "detail": "mapped_detail", "ignore": "ignored", "defer": "deferred"}


@dataclass
class Dictionary:
    """rules (key, disposition, ...), outputs (key, output, pos) and canonical (axis, name, pos)."""

    rules: DataFrame
    outputs: DataFrame
    canonical: DataFrame

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dictionary:
        """From a JSON document {canonical_tags: {axis: [names]}, mappings: {key: {disposition, outputs, notes, provider}}}."""
        rule = "struct<disposition:string,outputs:array<string>,notes:array<string>,provider:array<string>>"
        doc = spark.read.schema(f"canonical_tags map<string,array<string>>, mappings map<string,{rule}>").json(path, multiLine=True)
        rules = doc.select(F.explode("mappings").alias("raw", "r")).select(dict_key(F.col("raw")).alias("key"), "r.*")
        outputs = rules.select("key", F.posexplode("outputs").alias("pos", "output")).select("key", "output", (F.col("pos") + 1).cast("long").alias("pos"))
        canonical = doc.select(F.explode("canonical_tags").alias("axis", "names")).select("axis", F.posexplode("names").alias("pos", "name"))
        return Dictionary(rules.drop("outputs"), outputs, canonical.select("axis", "name", (F.col("pos") + 1).cast("long").alias("pos")))

    def lookup(self) -> DataFrame:
        """key, disposition, outputs array in first-seen order; one row a key."""
        each = self.outputs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "output"))).alias("o"))
        out = self.rules.select("key", "disposition").join(each, "key", "left")
        return out.select("key", "disposition", F.coalesce(F.array_distinct(F.col("o.output")), F.array().cast("array<string>")).alias("outputs"))

    def small_lookup(self) -> DataFrame:
        """``lookup`` with a broadcast hint if there are at most ``BROADCAST_RULES`` rules, which are counted."""
        few = self.rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
        return F.broadcast(self.lookup()) if few else self.lookup()


def small(df: DataFrame, limit: int = BROADCAST_RULES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, which is looked up."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def looked_up(raw: DataFrame, dictionary: Dictionary, column: str = "raw_label", defer_is_unmapped: bool = True) -> DataFrame:
    """``raw`` with key, disposition (null for a miss), outputs and unmapped.  Blank labels are dropped."""
    keyed = raw.withColumn("key", dict_key(F.col(column))).where("key <> ''")
    out = keyed.join(dictionary.small_lookup(), "key", "left")
    miss = F.col("disposition").isNull()
    return out.withColumn("outputs", F.coalesce("outputs", F.array().cast("array<string>"))).withColumn("unmapped", miss | (F.col("disposition") == "defer") if defer_is_unmapped else miss)


def mapped_labels(raw: DataFrame, dictionary: Dictionary) -> DataFrame:
    """item_id, output: the distinct outputs of each item's mapped raw labels, with the place of the first."""
    return outputs_of(looked_up(raw, dictionary))


def outputs_of(looked: DataFrame) -> DataFrame:
    """``mapped_labels`` of rows that are looked up already."""
    hits = looked.where(F.col("disposition").isin("map", "detail"))
    each = hits.select("item_id", "pos", F.posexplode("outputs").alias("nth", "output"))
    return each.groupBy("item_id", "output").agg(F.min(F.struct("pos", "nth")).alias("at"))


def ordered_labels(mapped: DataFrame) -> DataFrame:
    """item_id, names: the outputs of ``mapped_labels`` of each item as one list, in the order in which its raw labels first gave them."""
    each = mapped.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "output"))).alias("_each"))
    return each.select("item_id", F.transform("_each", lambda x: x["output"]).alias("names"))


def axis_of(names: DataFrame, dictionary: Dictionary, prefixes: DataFrame, column: str = "name") -> DataFrame:
    """``names`` with axis: that of the canonical name, else that of its prefix up to the first ": "."""
    known = dictionary.canonical.groupBy(F.col("name").alias("_name")).agg(F.min_by("axis", "pos").alias("_axis"))
    out = names.join(known, F.col(column) == F.col("_name"), "left").withColumn("_prefix", axis_prefix(F.col(column)))
    out = out.join(small(prefixes.select(F.col("axis").alias("_by_prefix"), F.col("prefix").alias("_p"))), F.col("_prefix") == F.col("_p"), "left")
    return out.withColumn("axis", F.coalesce("_axis", "_by_prefix")).drop("_name", "_axis", "_prefix", "_by_prefix", "_p")


def canonical_of(values: DataFrame, aliases: DataFrame, norm: str) -> DataFrame:
    """``values`` with canonical: the first alias row, in document order, whose ``norm`` is theirs."""
    first = aliases.groupBy(F.col("norm").alias("_norm")).agg(F.min_by("canonical", "ord").alias("canonical"))
    return values.join(small(first), F.col(norm) == F.col("_norm"), "left").drop("_norm")


def fingerprint(dictionary: Dictionary) -> DataFrame:
    """One row, sha: blind to the order of keys, sensitive to that of outputs.

    The digests of the rows are added up in four parts of 60 bits, so that no task gathers the rows; the sums are hashed.
    """
    rule = F.concat_ws("\x1f", F.lit("rule"), "key", F.coalesce("disposition", F.lit("")), F.array_join("outputs", "\x1e"))
    name = F.concat_ws("\x1f", F.lit("name"), "axis", "name", F.col("pos").cast("string"))
    rows = dictionary.lookup().select(F.sha2(rule, 256).alias("d")).unionByName(dictionary.canonical.select(F.sha2(name, 256).alias("d")))
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("d", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return rows.agg(F.sha2(F.concat_ws("|", *(part(k).cast("string") for k in range(4))), 256).alias("sha"))


#: Version of the exported form.
EXPORT_VERSION = 1


def export(dictionary: Dictionary, path: str) -> DataFrame:
    """Writes ``path``/rows (JSON lines) and ``path``/manifest: version, meaning's and rows' checksum; returns the manifest.

    The rows are read again for their checksum, so that it tells what is in the files.
    """
    spark = dictionary.rules.sparkSession
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), F.to_json(F.struct(*sorted(df.columns))).alias("row"))
    rows = kind(dictionary.rules, "rule").unionByName(kind(dictionary.outputs, "output")).unionByName(kind(dictionary.canonical, "name"))
    rows.write.json(f"{path}/rows")
    spark.range(1).select(F.lit(EXPORT_VERSION).alias("version")).join(fingerprint(dictionary)).join(_rows_sha(spark, path)).write.json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def _rows_sha(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("kind string, row string").json(f"{path}/rows").select(F.sha2(F.concat_ws("\x1f", "kind", "row"), 256).alias("d"))
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring("d", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return rows.agg(F.sha2(F.concat_ws("|", *(part(k).cast("string") for k in range(4))), 256).alias("rows_sha"))


def read_export(spark: SparkSession, path: str) -> Dictionary:
    """The dictionary of an export; ValueError if its version is unknown or either checksum does not fit."""
    said = spark.read.schema("version int, sha string, rows_sha string").json(f"{path}/manifest").first()
    if said is None or said.version != EXPORT_VERSION:
        raise ValueError("unknown version of a dictionary export")
    if said.rows_sha != _rows_sha(spark, path).first()[0]:
        raise ValueError("the rows of the export are not those that were written")
    rows = spark.read.schema("kind string, row string").json(f"{path}/rows")
    part = lambda name, schema: rows.where(F.col("kind") == name).select(F.from_json("row", schema).alias("r")).select("r.*")
    texts = "array<string>"
    out = Dictionary(part("rule", f"key string, disposition string, notes {texts}, provider {texts}"), part("output", "key string, output string, pos long"), part("name", "axis string, name string, pos long"))
    if said.sha != fingerprint(out).first()[0]:
        raise ValueError("the export means another dictionary than its checksum")
    return out


def audit(dictionary: Dictionary) -> DataFrame:
    """kind, name, n: canonical names per axis, rules per disposition."""
    a = dictionary.canonical.groupBy(F.col("axis").alias("name")).agg(F.count("*").alias("n")).select(F.lit("axis").alias("kind"), "name", "n")
    b = dictionary.rules.groupBy(F.col("disposition").alias("name")).agg(F.count("*").alias("n")).select(F.lit("disposition").alias("kind"), "name", "n")
    return a.unionByName(b)


def unreached(dictionary: Dictionary) -> DataFrame:
    """Canonical names that no rule outputs."""
    return dictionary.canonical.join(dictionary.outputs.select(F.col("output").alias("name")).distinct(), "name", "left_anti").select("axis", "name")


def compared(before: Dictionary, after: Dictionary) -> DataFrame:
    """key, change (added, removed, changed) and either side's disposition and outputs; equal rules have no row."""
    side = lambda d, p: d.lookup().select("key", F.col("disposition").alias(f"{p}_disposition"), F.array_sort("outputs").alias(f"{p}_outputs"))
    both = side(before, "before").join(side(after, "after"), "key", "full_outer")
    change = F.when(F.col("before_disposition").isNull(), "added").when(F.col("after_disposition").isNull(), "removed")
    differs = (F.col("before_disposition") != F.col("after_disposition")) | (F.col("before_outputs") != F.col("after_outputs"))
    return both.withColumn("change", change.when(differs, "changed")).where("change IS NOT NULL")


def compared_axes(before: DataFrame, after: DataFrame) -> DataFrame:
    """axis, added, removed: names of each axis on one side only, sorted."""
    side = lambda d, name: d.groupBy("axis").agg(F.collect_set("name").alias(name))
    both = side(before, "b").join(side(after, "a"), "axis", "full_outer")
    none = F.array().cast("array<string>")
    b, a = F.coalesce("b", none), F.coalesce("a", none)
    return both.select("axis", F.array_sort(F.array_except(a, b)).alias("added"), F.array_sort(F.array_except(b, a)).alias("removed")).where("size(added) + size(removed) > 0")


def compared_settings(before: DataFrame, after: DataFrame) -> DataFrame:
    """pointer, before, after of settings (path array, value) that differ; the pointer escapes each part."""
    pointer = F.concat(F.lit("/"), F.array_join(F.transform("path", pointer_part), "/"))
    side = lambda d, name: d.select(pointer.alias("pointer"), F.col("value").alias(name))
    return side(before, "before").join(side(after, "after"), "pointer", "full_outer").where("NOT before <=> after")


def edited(dictionary: Dictionary, edits: DataFrame, new_names: DataFrame | None = None, expected: str | None = None) -> Dictionary:
    """The dictionary after ``edits`` (key, disposition, outputs array, remove, and any further columns of the rules).

    A removal drops the rule; ignore clears the outputs; what an edit leaves null keeps its old value, notes and provider
    included.  New canonical names (axis, name) are put behind the axis's others; those that it has are refused
    (``quality.new_name_issues``).  ``expected``: the fingerprint of the dictionary that the edits were made for.
    ValueError if it is another one by now, or if a new name is there already.
    """
    if expected is not None and fingerprint(dictionary).first()[0] != expected:
        raise ValueError("the dictionary has changed since the edits were made")
    if new_names is not None and new_names.join(dictionary.canonical, ["axis", "name"], "left_semi").limit(1).count():
        raise ValueError("a new canonical name is there already")
    further = [c for c in dictionary.rules.columns if c not in ("key", "disposition")]
    sent = [F.col(c).alias(f"_new_{c}") for c in further if c in edits.columns]
    e = edits.select(dict_key(F.col("key")).alias("key"), F.col("disposition").alias("d"), F.col("outputs").alias("o"), F.coalesce("remove", F.lit(False)).alias("remove"), F.lit(True).alias("hit"), *sent)
    old = dictionary.lookup().join(dictionary.rules.select("key", *further), "key")
    new = old.join(e, "key", "full_outer").where("hit IS NULL OR NOT remove")
    new = new.withColumn("disposition", F.coalesce("d", "disposition"))
    kept = F.when(F.col("disposition") == "ignore", F.array().cast("array<string>")).otherwise(F.coalesce("o", "outputs", F.array().cast("array<string>")))
    rest = [F.coalesce(f"_new_{c}", c).alias(c) if c in edits.columns else F.col(c) for c in further]
    new = new.select("key", "disposition", kept.alias("outputs"), *rest)
    outputs = new.select("key", F.posexplode("outputs").alias("p", "output")).select("key", "output", (F.col("p") + 1).cast("long").alias("pos"))
    canonical = dictionary.canonical
    if new_names is not None:
        fresh = new_names.select("axis", "name").distinct().join(canonical, ["axis", "name"], "left_anti")
        last = canonical.groupBy("axis").agg(F.max("pos").alias("last"))
        nth = F.row_number().over(Window.partitionBy("axis").orderBy("name")) + F.coalesce("last", F.lit(0))
        canonical = canonical.unionByName(fresh.join(last, "axis", "left").select("axis", "name", nth.cast("long").alias("pos")))
    return Dictionary(new.select("key", "disposition", *further), outputs, canonical)


def edit_audit(before: Dictionary, after: Dictionary, edit_id: str, at: Column) -> DataFrame:
    """One row for a saved edit: both fingerprints, the number of rules that differ, and the canonical names that came (JSON, sorted)."""
    came = after.canonical.select("axis", "name").join(before.canonical, ["axis", "name"], "left_anti")
    names = came.agg(F.to_json(F.array_sort(F.collect_list(F.struct("axis", "name")))).alias("canonical_additions"))
    changes = compared(before, after).agg(F.count("*").alias("change_count"))
    out = fingerprint(before).withColumnRenamed("sha", "expected_sha").join(fingerprint(after).withColumnRenamed("sha", "new_sha")).join(changes).join(names)
    return out.select(F.lit(edit_id).alias("edit_run_id"), "*", at.alias("edited_at"))


def edit_batch(decisions: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, new names) of staged decisions (raw_label, choice, outputs, axis): a kept label outputs itself, and unknown outputs with an axis become canonical."""
    keep = F.col("choice") == "keep"
    d = decisions.withColumn("outputs", F.when(keep, F.array("raw_label")).when(F.col("choice") == "ignore", F.array().cast("array<string>")).otherwise(F.col("outputs")))
    edits = d.select(dict_key(F.col("raw_label")).alias("key"), F.when(keep, "map").otherwise(F.col("choice")).alias("disposition"), "outputs", F.lit(False).alias("remove"))
    names = d.where("axis IS NOT NULL").select("axis", F.explode("outputs").alias("name")).distinct().join(canonical.select("name"), "name", "left_anti")
    return edits, names.select("axis", "name")


def built(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """key, disposition, outputs from sources (key, disposition, outputs) of falling precedence; one row a key."""
    ranked = None
    for rank, (name, df) in enumerate(sources):
        part = df.select(dict_key(F.col("key")).alias("key"), "disposition", "outputs", F.lit(rank).alias("rank"), F.lit(name).alias("origin"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = F.row_number().over(Window.partitionBy("key").orderBy("rank", "disposition"))
    return ranked.withColumn("n", best).where("n = 1").drop("n", "rank")


def collisions(axis_keys: DataFrame, blocked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keys that are both mapped and blocked without being among the allowed."""
    return axis_keys.select("key").distinct().join(blocked.select("key").distinct(), "key").join(allowed.select("key"), "key", "left_anti")
