"""Reports over the state tables: each is a function of DataFrames."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.functions.text import dict_key
from labelwright.operators.dictionary import DISPLAY, Dictionary, looked_up, small

STATUSES = ("mapped", "mapped_detail", "ignored", "deferred", "needs_decision")
#: States of a run that ended well.
SUCCESS = ("completed", "success", "succeeded", "finished", "done")
#: Similarity that a suggestion needs.
CUT_OFF = 0.75


def items_per_label(raw_current: DataFrame) -> DataFrame:
    """raw_label, n_items by exact spelling."""
    return raw_current.groupBy("raw_label").agg(F.countDistinct("item_id").alias("n_items"))


def items_per_key(raw_current: DataFrame, keys: DataFrame) -> DataFrame:
    """key, n_items for the given keys (null keys in neither)."""
    k = small(keys.select("key").distinct())
    return raw_current.select(dict_key(F.col("raw_label")).alias("key"), "item_id").join(k, "key", "left_semi").groupBy("key").agg(F.countDistinct("item_id").alias("n_items"))


def dashboard(items: DataFrame, state: DataFrame, rules_sha: str, provider_fp: str) -> DataFrame:
    """One row of totals."""
    ran = F.col("last_successful_run_id").isNotNull()
    stale = ran & ~((F.coalesce("rules_sha", F.lit("")) == rules_sha) & (F.coalesce("provider_fp", F.lit("")) == provider_fp))
    s = state.agg(F.count_if(ran & (F.col("last_successful_run_id") != "")).alias("processed"), F.count_if(stale).alias("stale"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("inspected"))
    return items.agg(F.count("*").alias("total")).join(s).withColumn("never_processed", F.greatest(F.lit(0), F.col("total") - F.col("processed")))


def total_items(live: DataFrame, state: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row, total: live items, else state rows, else items of the newest proposal set."""
    n = lambda df, name: df.agg(F.nullif(F.count("*"), F.lit(0)).alias(name))
    newest = latest_set(proposals)
    last = proposals.join(newest, "proposed_run_id", "left_semi")
    return n(live, "a").join(n(state, "b")).join(n(last, "c")).select(F.coalesce("a", "b", "c", F.lit(0)).alias("total"))


def unmapped(raw_current: DataFrame, dictionary: Dictionary, defer_is_unmapped: bool = False) -> DataFrame:
    """raw_label, n_items of labels that the dictionary does not map, by exact spelling."""
    miss = looked_up(raw_current, dictionary, defer_is_unmapped=defer_is_unmapped).where("unmapped")
    return items_per_label(miss)


def unmapped_totals(raw_current: DataFrame, dictionary: Dictionary) -> DataFrame:
    miss = looked_up(raw_current, dictionary, defer_is_unmapped=False).where("unmapped")
    return miss.agg(F.countDistinct("raw_label").alias("labels"), F.countDistinct("item_id").alias("items"))


def top_unmapped(raw_current: DataFrame, dictionary: Dictionary, limit: int = 100) -> DataFrame:
    return unmapped(raw_current, dictionary).orderBy(F.col("n_items").desc(), "raw_label").limit(limit)


def catalogue(raw_history: DataFrame, samples: int = 3) -> DataFrame:
    """key, display, n_items, first_seen, last_seen, by_provider (provider=items), providers, samples of every raw label ever seen."""
    each = raw_history.select(dict_key(F.col("raw_label")).alias("key"), "raw_label", "item_id", "provider", "observed_at").where("key <> ''")
    one = each.groupBy("key", "provider").agg(F.countDistinct("item_id").alias("n"))
    split = one.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "provider", F.col("n").cast("string")))), ",").alias("by_provider"))
    facts = each.groupBy("key").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.min("raw_label").alias("display"), F.countDistinct("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))
    # the first few items of a key are kept by rank after a partial distinct, not by collecting the key's items
    nth = F.row_number().over(Window.partitionBy("key").orderBy("item_id"))
    some = each.select("key", "item_id").distinct().withColumn("n", nth).where(F.col("n") <= samples)
    return facts.join(split, "key").join(some.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("samples")), "key")


def display_status(disposition: Column) -> Column:
    out = F.lit("needs_decision")
    for k, v in DISPLAY.items():
        out = F.when(disposition == k, v).otherwise(out)
    return out


def dictionary_report(raw_current: DataFrame, dictionary: Dictionary) -> DataFrame:
    """key, n_items, status, outputs (joined) of every key that is observed or has a rule."""
    seen = raw_current.select(dict_key(F.col("raw_label")).alias("key"), "item_id").where("key <> ''").groupBy("key").agg(F.countDistinct("item_id").alias("n"))
    both = seen.join(dictionary.lookup(), "key", "full_outer")
    return both.select("key", F.coalesce("n", F.lit(0)).alias("n_items"), display_status(F.col("disposition")).alias("status"), F.coalesce(F.array_join("outputs", "; "), F.lit("")).alias("outputs"))


def report_page(report: DataFrame, limit: int = 5000) -> DataFrame:
    """The entries of most items first, ties by key."""
    return report.orderBy(F.col("n_items").desc(), "key").limit(limit)


def most_wanted(report: DataFrame, limit: int = 500) -> DataFrame:
    """The undecided entries of most items, ties by key: those that get suggestions."""
    return report_page(report.where("status = 'needs_decision'"), limit)


def status_counts(report: DataFrame) -> DataFrame:
    """status, n with every status present."""
    every = report.sparkSession.range(1).select(F.explode(F.lit(list(STATUSES))).alias("status"))
    return F.broadcast(every).join(report.groupBy("status").agg(F.count("*").alias("c")), "status", "left").select("status", F.coalesce("c", F.lit(0)).alias("n"))


def browse(report: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """Entries of a status with the text in key or outputs, whatever the case."""
    out = report.where(F.col("status") == status) if status else report
    return out.where(F.contains(F.lower("key"), F.lit(text.lower())) | F.contains(F.lower("outputs"), F.lit(text.lower()))) if text else out


def typeahead(canonical: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Canonical names with the text in them: equal ones first, then in document order."""
    hit = canonical.where(F.contains(F.lower("name"), F.lit(text.lower())))
    return hit.orderBy((F.lower("name") == text.lower()).desc(), "axis", "pos").limit(limit)


def latest_set(proposals: DataFrame) -> DataFrame:
    return proposals.agg(F.max_by("proposed_run_id", F.struct("created_at", "proposed_run_id")).alias("proposed_run_id"))


def last_successful_run(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin(*SUCCESS)).agg(F.max_by(F.struct("run_id", "started_at", "ended_at"), F.struct("ended_at", "run_id")).alias("r")).where("r IS NOT NULL").select("r.*")


def recent_errors(attempts: DataFrame, limit: int = 20) -> DataFrame:
    """Failed attempts of the run that the newest attempt belongs to."""
    run = attempts.agg(F.max_by("run_id", F.struct("attempted_at", "attempt_id")).alias("run_id"))
    return attempts.where("status = 'failed'").join(F.broadcast(run), "run_id", "left_semi").orderBy(F.col("attempted_at").desc(), F.col("attempt_id").desc()).limit(limit)


def error_groups(errors: DataFrame) -> DataFrame:
    return errors.groupBy("message").agg(F.count("*").alias("n"))


def run_history(runs: DataFrame, attempts: DataFrame, limit: int = 50) -> DataFrame:
    """The newest parent runs with the totals of their and their children's attempts."""
    parents = runs.where("parent_run_id IS NULL")
    root = runs.select("run_id", F.coalesce("parent_run_id", "run_id").alias("root"))
    n = attempts.join(small(root), "run_id").groupBy("root").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")))
    out = parents.join(n, parents.run_id == n.root, "left").drop("root")
    return out.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def set_totals(proposals: DataFrame, expected: DataFrame) -> DataFrame:
    """proposed_run_id, total, changed, without_reasons of every expected set, zero where it has no proposal; and of all under null.

    ``proposals``: proposed_run_id, has_change, has_reasons.
    """
    n = proposals.groupBy("proposed_run_id").agg(F.count("*").alias("total"), F.count_if("has_change").alias("changed"), F.count_if(~F.coalesce("has_reasons", F.lit(False))).alias("without_reasons"))
    sums = ("total", "changed", "without_reasons")
    sets = expected.select("proposed_run_id").distinct().join(n, "proposed_run_id", "left").select("proposed_run_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums))
    return sets.unionByName(sets.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums)).withColumn("proposed_run_id", F.lit(None).cast("string")))


#: What a run's reports are counted under, and the counters of a child report that each sums.
RUN_TOTALS = {
    "changed": ("mutations_applied",), "already_correct": ("idempotent_noop",), "skipped": ("other_skips", "item_missing"),
    "failed": ("mutation_failure", "transient", "cleanup_failed"), "unmapped": ("unmapped_labels",), "deleted": ("destroyed",), "proposed": ("proposals_written",),
}


def run_totals(children: DataFrame) -> DataFrame:
    """run_id and the seven totals, from the counters (run_id, report, counter, n) of every report nested in a run.

    A counter is one of ``RUN_TOTALS``; unknown ones count as skipped, as further reasons of skipping do.
    """
    named = F.lit("skipped")
    for total, counters in RUN_TOTALS.items():
        named = F.when(F.col("counter").isin(*counters), total).otherwise(named)
    each = children.select("run_id", named.alias("total"), F.coalesce("n", F.lit(0)).alias("n"))
    return each.groupBy("run_id").agg(*(F.coalesce(F.sum(F.when(F.col("total") == t, F.col("n"))), F.lit(0)).cast("long").alias(t) for t in RUN_TOTALS))


def unmapped_of_runs(raw: DataFrame, dictionary: Dictionary) -> DataFrame:
    """run_id, raw_label: the distinct labels of each run that the dictionary does not map; ``raw`` has run_id."""
    return looked_up(raw, dictionary, defer_is_unmapped=False).where("unmapped").select("run_id", "raw_label").distinct()


def proposal_page(proposals: DataFrame, phases: DataFrame, limit: int = 500) -> DataFrame:
    """Proposals with their phase's place: changed ones first, then by phase and item; with each set's size and whether the page cuts it."""
    size = proposals.groupBy("proposed_run_id").agg(F.count("*").alias("set_total"))
    page = proposals.join(small(phases), "proposed_run_id").orderBy(F.col("has_change").desc(), "phase_pos", "item_id").limit(limit)
    shown = page.groupBy("proposed_run_id").agg(F.count("*").alias("shown"))
    return page.join(shown, "proposed_run_id").join(size, "proposed_run_id").withColumn("truncated", F.col("shown") < F.col("set_total")).drop("shown")


def run_changes(mutations: DataFrame, reasons: DataFrame, run_id: str, limit: int = 500) -> DataFrame:
    """A run's changed items with added and removed names and their reasons, by item; total counts all of them."""
    m = mutations.where(F.col("run_id") == run_id)
    page = m.orderBy("item_id").limit(limit).join(m.agg(F.count("*").alias("total")))
    # only the page's reasons are put together
    shown = reasons.join(F.broadcast(page.select("item_id")), "item_id", "left_semi")
    r = shown.groupBy("item_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "reason", "name"))).alias("reasons"))
    out = page.join(r, "item_id", "left")
    return out.withColumn("added", F.array_except("after_names", "before_names")).withColumn("removed", F.array_except("before_names", "after_names")).withColumn("truncated", F.col("total") > limit)


def uncovered(expected: DataFrame, covered: DataFrame) -> DataFrame:
    """Phase sets that a preview should hold and does not."""
    return expected.join(covered.select("proposed_run_id").distinct(), "proposed_run_id", "left_anti")


def newest_phases(runs: DataFrame, phase_sets: DataFrame) -> DataFrame:
    """Phase sets (run_id, phase, proposed_run_id) of the newest run that has any."""
    newest = runs.join(phase_sets.select("run_id").distinct(), "run_id", "left_semi").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return phase_sets.join(F.broadcast(newest), "run_id", "left_semi")


def suggestions(undecided: DataFrame, candidates: DataFrame, kind: str, limit: int = 3, cut_off: float = CUT_OFF, equal: bool = False) -> DataFrame:
    """key, kind, candidate, score: at most ``limit`` candidates (column text) that are most like each undecided key; the key itself only if ``equal``.

    A ratio of 2 M / (a + b) of at least the cut-off needs lengths within cut / (2 - cut) of each other: keys and
    candidates meet on the length, and on a letter that both have much of, before the ratio is worked out.
    """
    least = cut_off / (2 - cut_off)
    n = F.length("key")
    by_length = undecided.select("key", F.explode(F.sequence(F.ceil(n * least).cast("int"), F.floor(n / least).cast("int"))).alias("n"))
    met = by_length.join(candidates.select(F.col("text").alias("candidate"), F.length("text").alias("n")).distinct(), "n").where(F.lit(equal) | (F.col("key") != F.col("candidate")))
    # a letter can match no more often than it occurs in either text
    letters = F.lit(list("abcdefghijklmnopqrstuvwxyz "))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(F.transform(letters, lambda c: F.least(count(F.lower("key"), c), count(F.lower("candidate"), c))), F.lit(0), lambda a, x: a + x)
    others = F.length(F.regexp_replace(F.lower("key"), "[a-z ]", ""))
    met = met.where(2 * (common + others) >= cut_off * (F.length("key") + F.length("candidate")))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)])

    best = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("candidate").desc()))
    scored = met.withColumn("score", ratio("key", "candidate")).where(F.col("score") >= cut_off).withColumn("nth", best)
    return scored.where(F.col("nth") <= limit).select("key", F.lit(kind).alias("kind"), "candidate", "score")


def all_suggestions(undecided: DataFrame, keys: DataFrame, names: DataFrame, limit: int = 4) -> DataFrame:
    """``suggestions`` of dictionary keys, then of canonical names that are none of those keys in lower case; ``limit`` a key."""
    found = suggestions(undecided, keys, "key").unionByName(suggestions(undecided, names, "name", equal=True))
    found = found.withColumn("said", F.when(F.col("kind") == "name", F.lower("candidate")).otherwise(F.col("candidate")))
    order = (F.col("kind"), F.col("score").desc(), F.col("candidate").desc())
    once = found.withColumn("nth", F.row_number().over(Window.partitionBy("key", "said").orderBy(*order))).where("nth = 1")
    best = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return once.withColumn("nth", best).where(F.col("nth") <= limit).select("key", "kind", "candidate", "score")


def provider_fingerprint(providers: DataFrame) -> DataFrame:
    return providers.agg(F.array_join(F.array_sort(F.collect_set("url")), ",").alias("fingerprint"))


def save_result(raw_current: DataFrame, keys: DataFrame) -> DataFrame:
    """One row, items: how many items a set of edited keys touches, each counted once."""
    k = small(keys.select("key").distinct())
    return raw_current.select(dict_key(F.col("raw_label")).alias("key"), "item_id").join(k, "key", "left_semi").agg(F.countDistinct("item_id").alias("items"))
