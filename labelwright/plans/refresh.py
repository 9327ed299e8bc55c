"""All snapshots in one call: several reports out of one pass over the raw labels, and one commit for all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwright.functions.redact import redacted
from labelwright.functions.text import dict_key
from labelwright.operators.dictionary import Dictionary, audit
from labelwright.plans import reports
from labelwright.sources.relations import spread
from labelwright.sources.tables import Store

#: Rows of the reports that are pages of a longer list.
PAGES = {"run_history": 50, "unmapped_labels": 100, "dictionary": 5000, "proposal_detail": 500}


def label_counts(raw_current: DataFrame, dictionary: Dictionary) -> DataFrame:
    """miss, disposition, key, raw_label, n_items, n_labels, level: different items by spelling (level 0), by key (1) and of all labels without a rule (2).

    The rows meet once, by item, each spelling of an item once; those that are an item's first of a key, or of the labels without a
    rule, are counted with the spelling and added up from there.  Blank labels are left out.
    """
    by = ("miss", "disposition", "key", "raw_label")
    each = spread(raw_current.select("item_id", "raw_label"), raw_current.count(), "item_id").distinct()
    each = each.withColumn("key", dict_key(F.col("raw_label"))).where("key <> ''")
    each = each.join(dictionary.small_lookup().select("key", "disposition"), "key", "left").withColumn("miss", F.col("disposition").isNull())
    nth = lambda *cols: F.row_number().over(Window.partitionBy("item_id", *cols).orderBy("raw_label"))
    each = each.withColumns({"_key": nth(*by[:3]), "_miss": nth("miss")})
    first = lambda c: F.count(F.when(F.col(c) == 1, F.col("item_id"))).alias(c)
    spelled = each.groupBy(*by).agg(F.count("item_id").alias("_all"), first("_key"), first("_miss"))
    level = (F.grouping("raw_label") + F.grouping("key")).cast("int").alias("level")
    sums = [F.sum(c).alias(c) for c in ("_all", "_key", "_miss")]
    out = spelled.groupingSets([list(by), list(by[:3]), ["miss"]], *by).agg(*sums, F.count("raw_label").alias("n_labels"), level)
    return out.select(*by, F.when(F.col("level") == 0, F.col("_all")).when(F.col("level") == 1, F.col("_key")).otherwise(F.col("_miss")).alias("n_items"), "n_labels", "level")


def dictionary_entries(counts: DataFrame, dictionary: Dictionary) -> DataFrame:
    """``reports.dictionary_report`` out of ``label_counts``."""
    both = counts.where("level = 1").select("key", F.col("n_items").alias("n")).join(dictionary.lookup(), "key", "full_outer")
    return both.select("key", F.coalesce("n", F.lit(0)).alias("n_items"), reports.display_status(F.col("disposition")).alias("status"), F.coalesce(F.array_join("outputs", "; "), F.lit("")).alias("outputs"))


def dashboard(counts: DataFrame, items: DataFrame, state: DataFrame, rules_sha: str, provider_fp: str) -> DataFrame:
    """``reports.dashboard`` with unmapped_labels and unmapped_items."""
    most = lambda c: F.coalesce(F.max(c), F.lit(0))
    missed = counts.where("level = 2 AND miss").agg(most("n_labels").alias("unmapped_labels"), most("n_items").alias("unmapped_items"))
    return reports.dashboard(items, state, rules_sha, provider_fp).join(missed)


def snapshots(counts: DataFrame, store: Store, dictionary: Dictionary, items: DataFrame, phases: DataFrame, rules_sha: str, provider_fp: str) -> dict[str, Callable[[], DataFrame]]:
    """Every report, to be made one by one; ``counts``: of ``label_counts``, ``phases``: proposed_run_id, phase_pos."""
    unmapped = lambda: counts.where("level = 0 AND miss").select("raw_label", "n_items").orderBy(F.col("n_items").desc(), "raw_label")
    return {
        "dashboard": lambda: dashboard(counts, items, store.read("item_state"), rules_sha, provider_fp),
        "run_history": lambda: reports.run_history(store.read("runs"), store.read("attempts"), PAGES["run_history"]),
        "unmapped_labels": lambda: unmapped().limit(PAGES["unmapped_labels"]),
        "dictionary": lambda: reports.report_page(dictionary_entries(counts, dictionary), PAGES["dictionary"]),
        "rules_audit": lambda: audit(dictionary),
        "proposal_detail": lambda: reports.proposal_page(store.read("proposals"), phases, PAGES["proposal_detail"]),
    }


def refresh(store: Store, dictionary: Dictionary, items: DataFrame, phases: DataFrame, rules_sha: str, provider_fp: str) -> dict[str, bool]:
    """Every snapshot anew, redacted, from the store's tables; which of them could be made.

    One that fails does not hold up the others.  Those that were made become visible together as snapshot_<name>.
    """
    counts = store.scratch("label_counts", label_counts(store.read("raw_current"), dictionary))
    made, said = {}, {}
    for name, report in snapshots(counts, store, dictionary, items, phases, rules_sha, provider_fp).items():
        try:
            made[f"snapshot_{name}"] = store.scratch(name, redacted(report()))
        except PySparkException:
            pass
        said[name] = f"snapshot_{name}" in made
    store.commit(made)
    store.drop_scratch()
    return said
