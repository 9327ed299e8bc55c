"""Label sets: what an item should carry, why, and who owns it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.functions.text import fold_case, id_set
from labelwright.operators.dictionary import small

#: Order of the parts of a desired set.
KEPT, MAPPED, DERIVED, MARKER, PROTECTED = range(5)


def is_protected(name: Column, exact: list[str], prefixes: list[str]) -> Column:
    """Protected by its whole name or its beginning, whatever the case."""
    low, out = fold_case(name), F.lit(False)
    for x in exact:
        out = out | (low == fold_case(F.lit(x)))
    for p in prefixes:
        out = out | F.startswith(low, fold_case(F.lit(p)))
    return out


def resolved(names: DataFrame, labels: DataFrame, item_labels: DataFrame) -> DataFrame:
    """``names`` (item_id, name) with label_id: of the label of that name, else of the item's own of that name, whatever the case."""
    everywhere = labels.groupBy(fold_case(F.col("name")).alias("_n")).agg(F.min("label_id").alias("_id"))
    own = item_labels.groupBy("item_id", fold_case(F.col("label_name")).alias("_n")).agg(F.min("label_id").alias("_own"))
    keyed = names.withColumn("_n", fold_case(F.col("name")))
    out = keyed.join(small(everywhere), "_n", "left").join(own, ["item_id", "_n"], "left")
    return out.withColumn("label_id", F.coalesce("_id", "_own")).drop("_n", "_id", "_own")


def unresolved_items(resolved_names: DataFrame) -> DataFrame:
    """item_id, missing: items with names that stand for no label, and those names, sorted."""
    return resolved_names.where("label_id IS NULL").groupBy("item_id").agg(F.array_sort(F.collect_set("name")).alias("missing"))


def desired(current: DataFrame, mapped: DataFrame, derived: DataFrame, markers: DataFrame, authority: DataFrame) -> DataFrame:
    """item_id, name, part: the labels that every item should have.

    ``current``: item_id, name, managed, protected.  ``mapped``, ``derived``, ``markers``: item_id, name.  ``authority``:
    item_id, authoritative, additive.  An authoritative item loses managed labels that are not derived anew, unless
    protected; an additive one only gains; any other keeps its labels and gains markers.  Of names that differ in case
    only the first part's stays.
    """
    # all that is known of an item meets in one shuffle; what decides over it comes along as a row without a name
    flags = ("managed", "protected", "authoritative", "additive")
    none = {f: F.lit(None).cast("boolean").alias(f) for f in flags}
    add = lambda df, part, *given: df.select("item_id", "name", F.lit(part).alias("part"), *(F.col(f) if f in given else none[f] for f in flags))
    rows = add(current, KEPT, "managed", "protected").unionByName(add(mapped, MAPPED)).unionByName(add(derived, DERIVED)).unionByName(add(markers, MARKER)).where("name IS NOT NULL")
    rows = rows.unionByName(add(authority.withColumn("name", F.lit(None).cast("string")), None, "authoritative", "additive").withColumn("part", F.col("part").cast("int")))
    # nameless rows sort first, so that they are seen by every row behind them
    by_item = Window.partitionBy("item_id").orderBy("_n", "part", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_n", fold_case(F.col("name")))
    rows = rows.withColumns({f: F.first(f, ignorenulls=True).over(by_item) for f in ("authoritative", "additive")})
    counts = F.when(F.col("part") == KEPT, ~F.col("authoritative") | ~F.col("managed") | F.col("protected")).when(F.col("part") == MARKER, ~F.col("additive"))
    rows = rows.where(F.col("name").isNotNull() & counts.otherwise(F.col("authoritative") | F.col("additive")))
    held = F.when((F.col("part") == KEPT) & F.col("authoritative") & F.col("managed"), PROTECTED).otherwise(F.col("part"))
    rows = rows.select("item_id", "_n", "name", held.alias("part"))
    first = F.row_number().over(Window.partitionBy("item_id", "_n").orderBy("part", "name"))
    return rows.withColumn("n", first).where("n = 1").select("item_id", "name", "part")


def explained(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """item_id, name, part, reason: every label that an item has or should have; part is null for those that it should not.

    reason: added, removed_managed, preserved_external or preserved_protected; null for a managed label that stays and for
    an unmanaged one that would go.  Both sides meet in one aggregation, so that each is worked out once.
    """
    cur = current.select("item_id", F.col("name").alias("cur"), "managed", "protected", F.lit(None).cast("string").alias("want"), F.lit(None).cast("int").alias("part"))
    new = wanted.select("item_id", F.lit(None).cast("string").alias("cur"), F.lit(None).cast("boolean").alias("managed"), F.lit(None).cast("boolean").alias("protected"), F.col("name").alias("want"), "part")
    rows = cur.unionByName(new).withColumn("_n", fold_case(F.coalesce("cur", "want")))
    both = rows.groupBy("item_id", "_n").agg(F.min("cur").alias("cur"), F.min("want").alias("want"), F.min("part").alias("part"), F.bool_or("managed").alias("managed"), F.bool_or("protected").alias("protected"))
    reason = (
        F.when(F.col("cur").isNull(), "added")
        .when(F.col("want").isNull() & F.col("managed") & ~F.col("protected"), "removed_managed")
        .when(F.col("want").isNotNull() & F.col("protected"), "preserved_protected")
        .when(F.col("want").isNotNull() & ~F.col("managed"), "preserved_external")
    )
    return both.select("item_id", F.coalesce("cur", "want").alias("name"), F.col("want"), "part", reason.alias("reason"))


def reasons(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """item_id, name, reason of ``explained`` where there is one."""
    return explained(current, wanted).where("reason IS NOT NULL").select("item_id", "name", "reason")


def ledger_after(mode: Column, managed: Column, current: Column, wanted: Column) -> Column:
    """Ids that the engine owns afterwards: replace keeps owned ones that stay and takes the new; acquire keeps all owned ones and takes the new."""
    new = F.array_except(wanted, current)
    return id_set(F.when(mode == "replace", F.array_union(F.array_intersect(managed, wanted), new)).otherwise(F.array_union(managed, new)))


def noop_ledger(mode: Column, managed: Column, current: Column, wanted: Column) -> Column:
    """Owned ids after a run that had nothing to write: only replace lets go of those that are not there any more."""
    return id_set(F.when(mode == "replace", F.array_union(F.array_intersect(managed, wanted), F.array_except(wanted, current))).otherwise(managed))


def without_owned(mapped: DataFrame, people: DataFrame, owned: DataFrame) -> DataFrame:
    """Mapped labels without those that a derivation owns, for items where any contributor has a text for it."""
    said = people.where("trim(coalesce(group_text, '')) <> ''").select("item_id").distinct()
    hit = mapped.join(said, "item_id", "left_semi").join(owned.select("name").distinct(), "name", "left_semi").select("item_id", "name")
    return mapped.join(hit, ["item_id", "name"], "left_anti")


def changed_names(before: Column, after: Column) -> Column:
    """(added, removed), each in first-seen order."""
    return F.struct(F.array_except(after, before).alias("added"), F.array_except(before, after).alias("removed"))


def set_fingerprint(ids: Column) -> Column:
    return F.to_json(id_set(ids))
