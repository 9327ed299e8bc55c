"""Runs: scopes, proposals, revalidation, reconciliation and the rows that writes leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.functions.text import not_expired
from labelwright.operators.dictionary import small

#: Phases of a library run, in order.
PHASES = ("never_processed", "stale_rules", "failed", "affected_by_mapping", "enrich_only")


def in_scope(items: DataFrame, state: DataFrame, scope: str, rules_sha: str = "", provider_fp: str = "", raw_current: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The items that a scope takes."""
    ran = (F.coalesce("last_successful_run_id", F.lit("")) != "") & F.col("last_successful_run_id").isNotNull()
    if scope in ("all", "enrich_only", "local_audit"):
        return items
    if scope == "never_processed":
        return items.join(state.where(ran).select("item_id"), "item_id", "left_anti")
    if scope == "stale_rules":
        same = (F.coalesce("rules_sha", F.lit("")) == rules_sha) & (F.coalesce("provider_fp", F.lit("")) == provider_fp)
        return items.join(state.where(F.col("last_successful_run_id").isNotNull() & ~same).select("item_id"), "item_id", "left_semi")
    if scope == "failed":
        return items.join(state.where("status = 'failed'").select("item_id"), "item_id", "left_semi")
    if scope == "affected_by_mapping":
        return items.join(affected_items(raw_current, keys), "item_id", "left_semi")
    raise ValueError(f"unknown scope {scope!r}")


def affected_items(raw_current: DataFrame, keys: DataFrame) -> DataFrame:
    """item_id of items with a raw label under one of the edited keys (both have column key)."""
    return raw_current.join(small(keys.select("key").distinct()), "key", "left_semi").select("item_id").distinct()


def proposed(explained: DataFrame, item_ids: DataFrame, run_id: str, set_id: str, created_at: Column, hours: int = 24, beside: tuple[str, ...] = ()) -> DataFrame:
    """A proposal for each item: names in order of part and name, reasons by kind, whether anything changes, and when it expires.

    ``explained``: ``labels.explained`` of the items' labels.  ``beside``: further columns of ``item_ids`` that come along.
    """
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", F.col("want").alias("name"))))), lambda x: x["name"])
    kinds = ("added", "removed_managed", "preserved_external", "preserved_protected")
    by_kind = [F.array_sort(F.collect_list(F.when(F.col("reason") == k, F.col("name")))).alias(k) for k in kinds]
    out = item_ids.select("item_id", *beside).join(explained.groupBy("item_id").agg(names.alias("names"), *by_kind), "item_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("names", *kinds)})
    change = (F.size("added") + F.size("removed_managed")) > 0
    return out.select(F.lit(run_id).alias("run_id"), F.lit(set_id).alias("proposed_run_id"), "*", change.alias("has_change"), created_at.alias("created_at"), (created_at + F.make_dt_interval(hours=F.lit(hours))).alias("expires_at"))


def revalidated(proposals: DataFrame, present: DataFrame | None, unresolved: DataFrame, now: Column) -> DataFrame:
    """``proposals`` with outcome: the first failing check decides, else noop or apply.

    ``present``: item_id, labels_fp, ledger_fp of what is there now; None if it is known to be what the proposals saw.
    ``unresolved``: item_id of proposals with a name that stands for no label.
    """
    p = proposals.join(present, "item_id", "left") if present is not None else proposals.withColumns({"labels_fp": F.col("seen_labels_fp"), "ledger_fp": F.col("seen_ledger_fp")})
    p = p.join(unresolved.select("item_id", F.lit(True).alias("_bad")), "item_id", "left")
    contract = F.col("mode").isin("replace", "acquire") & (F.coalesce("seen_ledger_fp", F.lit("")) != "")
    outcome = (
        F.when(F.col("labels_fp").isNull(), "missing")
        .when(F.col("status") == "deferred", "deferred")
        .when(~not_expired(F.col("expires_at"), now), "expired")
        .when(~F.coalesce(contract, F.lit(False)), "no_contract")
        .when(F.col("seen_labels_fp") != F.col("labels_fp"), "labels_changed")
        .when(F.col("seen_ledger_fp") != F.col("ledger_fp"), "ledger_changed")
        .when(F.col("_bad"), "missing_labels")
        .when(~F.col("has_change"), "noop")
        .otherwise("apply")
    )
    return p.withColumn("outcome", outcome).drop("_bad")


def made_under(rules_sha: str, provider_fp: str) -> Column:
    """Aggregate over a set's proposals: whether all were made under this dictionary and these providers (those without any pass)."""
    providers = (F.coalesce("provider_fp", F.lit("")) == "") | (F.col("provider_fp") == provider_fp) | (F.lit(provider_fp) == "")
    return F.coalesce(F.bool_and(F.coalesce(F.col("rules_sha") == rules_sha, F.lit(False)) & providers), F.lit(True))


def same_inputs(proposals: DataFrame, rules_sha: str, provider_fp: str) -> DataFrame:
    """proposed_run_id, ok: a set is dropped whole when it was made under another dictionary or other providers."""
    return proposals.groupBy("proposed_run_id").agg(made_under(rules_sha, provider_fp).alias("ok"))


def reconciled(pending: DataFrame, present: DataFrame) -> DataFrame:
    """``pending`` with outcome for each open intent of an interrupted run.

    ``pending``: event_id (unique), item_id, run_id, created_at, after_fp, baseline_fp, and has_metadata if known; event_id decides ties of date and run.  ``present``: item_id, labels_fp, ledger_fp.  Of an
    item's intents whose result is there now, the newest is adopted if the ledger is as it was recorded (else refused as
    stale, or as unknown without a record) and the others are superseded; without any such intent all are reverted, and
    so are those of items that are gone.  That the labels are there does not tell of metadata that the same intent carried:
    such an adoption is named adopted_with_metadata.
    """
    p = pending.join(present, "item_id", "left")
    match = F.coalesce(F.col("after_fp") == F.col("labels_fp"), F.lit(False))
    newest = F.row_number().over(Window.partitionBy("item_id", "_match").orderBy(F.col("created_at").desc(), F.col("run_id").desc(), F.col("event_id").desc()))
    p = p.withColumn("_match", match).withColumn("_nth", newest)
    has = p.where("_match").groupBy("item_id").agg(F.lit(True).alias("_any"))
    p = p.join(has, "item_id", "left")
    outcome = (
        F.when(F.col("labels_fp").isNull(), "gone")
        .when(F.col("_any").isNull(), "reverted")
        .when(~F.col("_match") | (F.col("_nth") > 1), "superseded")
        .when(F.col("baseline_fp").isNull(), "refused_unknown")
        .when(F.col("baseline_fp") != F.col("ledger_fp"), "refused_stale")
        .otherwise(F.when(F.coalesce("has_metadata", F.lit(False)), "adopted_with_metadata").otherwise("adopted") if "has_metadata" in pending.columns else "adopted")
    )
    return p.withColumn("outcome", outcome).drop("_match", "_nth", "_any")


def write_outcomes(intents: DataFrame, results: DataFrame) -> DataFrame:
    """``intents`` with journal and state: applied and success, rejected (an authentication refusal closes the journal) or pending, both failed."""
    r = intents.join(results, "item_id", "left")
    journal = F.when(F.col("ok"), "applied").when(F.col("error_kind") == "auth", "rejected").otherwise("pending")
    return r.withColumn("journal", journal).withColumn("state", F.when(F.col("ok"), "success").otherwise("failed"))


def state_rows(outcomes: DataFrame, run_id: str, rules_sha: str, provider_fp: str) -> DataFrame:
    """New item_state rows; a failed item loses its last successful run, so that it counts as never processed."""
    ok = F.col("state") == "success"
    return outcomes.select("item_id", F.col("state").alias("status"), F.when(ok, F.lit(run_id)).alias("last_successful_run_id"), F.when(ok, F.lit(rules_sha)).alias("rules_sha"), F.when(ok, F.lit(provider_fp)).alias("provider_fp"))


def attempt_rows(outcomes: DataFrame, run_id: str, rules_sha: str, provider_fp: str, at: Column) -> DataFrame:
    """A row for each item that a run looked at, whatever came of it: ``outcomes`` has item_id, state, status (of the match), message."""
    fixed = {"run_id": run_id, "rules_sha": rules_sha, "provider_fp": provider_fp}
    return outcomes.select("item_id", F.col("state").alias("status"), F.col("status").alias("match_status"), "message", *(F.lit(v).alias(k) for k, v in fixed.items()), at.alias("attempted_at"))


def marked(checked: DataFrame, run_id: str) -> DataFrame:
    """Revalidated proposals with the status that the run leaves them with, why if they were passed over, and the run."""
    done = F.col("outcome").isin("apply", "noop")
    status = F.when(done, "executed").when(F.col("outcome") == "deferred", "deferred").otherwise("skipped")
    return checked.withColumn("status", status).withColumn("skip_reason", F.when(~done, F.col("outcome"))).withColumn("applied_run_id", F.when(done, F.lit(run_id)))


def without_vanished(df: DataFrame, present: DataFrame) -> DataFrame:
    """Current-state rows of items that still exist."""
    return df.join(present.select("item_id").distinct(), "item_id", "left_semi")


def vanished(targets: DataFrame, items: DataFrame) -> DataFrame:
    return targets.join(items.select("item_id"), "item_id", "left_anti")


def fetched(ids: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the items of an explicit list of ids, the ids of the list that are there no more); an id that is listed twice counts once."""
    wanted = ids.select("item_id").distinct()
    return items.join(small(wanted), "item_id", "left_semi"), vanished(wanted, items)


def settled(proposals: DataFrame, present: DataFrame) -> DataFrame:
    """``proposals`` with open ones of vanished items skipped."""
    here = present.select("item_id").distinct().withColumn("_here", F.lit(True))
    out = proposals.join(here, "item_id", "left")
    gone = F.col("_here").isNull() & (F.col("status") == "proposed")
    return out.withColumn("status", F.when(gone, "skipped").otherwise(F.col("status"))).drop("_here")
