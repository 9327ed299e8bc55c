"""Provider answers: candidates, outcomes, merging by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.text import blank_to_null, strip
from labelwright.operators.dictionary import small

#: Outcomes that a later run may change.
TRANSIENT = ("RATE_LIMITED", "UNAVAILABLE")
SCALARS = ("title", "date", "code", "details", "director")


def enabled(providers: DataFrame, tokens: list[str]) -> DataFrame:
    """Providers whose name or url contains an enabled token, whatever its case; no token or "all" enables every one."""
    wanted = [t.strip().lower() for t in tokens if t.strip()]
    if not wanted or "all" in wanted:
        return providers
    said = F.lower(F.concat_ws(" ", "name", "url"))
    hit = F.lit(False)
    for t in wanted:
        hit = hit | F.contains(said, F.lit(t))
    return providers.where(hit)


def ranked(providers: DataFrame, tokens: list[str]) -> DataFrame:
    """``providers`` (name, url, found) with rank: that of the first token that matches, the rest behind, each in the order found."""
    said = F.lower(F.concat_ws(" ", "name", "url"))
    first = F.lit(len(tokens))
    for i in range(len(tokens) - 1, -1, -1):
        first = F.when(F.contains(said, F.lit(tokens[i].strip().lower())), i).otherwise(first)
    return providers.withColumn("rank", first * 1_000_000 + F.col("found"))


def has_fingerprint(files: Column) -> Column:
    return F.coalesce(F.exists(files, lambda f: F.exists(f.fingerprints, lambda p: F.coalesce(strip(p.value), F.lit("")) != "")), F.lit(False))


def classified(candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """item_id, provider, status: a failed call's own status, else by the number of candidates (a missing answer has none)."""
    n = candidates.groupBy("item_id", "provider").agg(F.count("*").alias("n"))
    each = outcomes.join(n, ["item_id", "provider"], "left")
    n = F.coalesce("n", F.lit(0))
    by_count = F.when(n == 0, "NO_MATCH").when(n == 1, "UNIQUE").otherwise("AMBIGUOUS")
    return each.select("item_id", "provider", F.coalesce("failure", by_count).alias("status"))


def merged_status(statuses: DataFrame, accept_partial: bool = False) -> DataFrame:
    """item_id, status: ambiguity wins; a unique match counts unless another provider may still answer, if partial ones are not accepted."""
    has = lambda s: F.bool_or(F.col("status") == s)
    a = statuses.groupBy("item_id").agg(*(has(s).alias(s.lower()) for s in ("AMBIGUOUS", "UNIQUE", *TRANSIENT, "NO_MATCH")))
    waiting = F.when(F.col("rate_limited"), "RATE_LIMITED").when(F.col("unavailable"), "UNAVAILABLE")
    unique = F.lit("UNIQUE") if accept_partial else F.coalesce(waiting, F.lit("UNIQUE"))
    out = F.when(F.col("ambiguous"), "AMBIGUOUS").when(F.col("unique"), unique).when(waiting.isNotNull(), waiting)
    return a.select("item_id", out.when(F.col("no_match"), "NO_MATCH").otherwise("NO_IDENTIFIERS").alias("status"))


def unique_labels(raw: DataFrame, statuses: DataFrame) -> DataFrame:
    """Raw labels of providers that matched their item uniquely."""
    return raw.join(statuses.where("status = 'UNIQUE'").select("item_id", "provider"), ["item_id", "provider"], "left_semi")


def candidate_labels(candidates: DataFrame) -> DataFrame:
    """item_id, provider, provider_item_id, raw_label, pos of a candidate's labels (array of (stored_id, name)); blank names are dropped."""
    each = candidates.select("item_id", "provider", F.coalesce("candidate.remote_id", F.lit("")).alias("provider_item_id"), F.posexplode("candidate.labels").alias("pos", "l"))
    return each.select("item_id", "provider", "provider_item_id", strip(F.col("l.name")).alias("raw_label"), (F.col("pos") + 1).cast("long").alias("pos")).where("raw_label <> ''")


def candidate_metadata(candidates: DataFrame) -> DataFrame:
    """Trimmed scalars, cleaned URLs, the source and the contributors that have a name; empty values and empty ids become null."""
    c = F.col("candidate")
    urls = F.filter(F.transform(c.urls, strip), lambda u: u != "")
    entity = lambda p: F.struct(F.nullif(p["stored_id"], F.lit("")).alias("stored_id"), strip(p["name"]).alias("name"), F.nullif(p["remote_id"], F.lit("")).alias("remote_id"))
    named = lambda p: F.coalesce(strip(p["name"]), F.lit("")) != ""
    people = F.transform(F.filter(c.contributors, named), entity)
    source = F.when(named(c.source), entity(c.source))
    none_if_empty = lambda a: F.when(F.size(a) > 0, a)
    return candidates.select("item_id", "provider", *(blank_to_null(c[f]).alias(f) for f in SCALARS), none_if_empty(urls).alias("urls"), none_if_empty(people).alias("contributors"), source.alias("source"))


def of_unique(candidates: DataFrame, statuses: DataFrame) -> DataFrame:
    """The candidates of providers that matched their item uniquely: one each."""
    return candidates.join(statuses.where("status = 'UNIQUE'").select("item_id", "provider"), ["item_id", "provider"], "left_semi")


def merged_metadata(metadata: DataFrame, ranks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """item_id and, for each field, the first provider's value that is not null, as (value, provider); lists and structs stay whole."""
    m = metadata.join(small(ranks.select("provider", "rank")), "provider")
    first = [F.min_by(F.struct(F.col(f).alias("value"), "provider"), F.when(F.col(f).isNotNull(), F.struct("rank", "provider"))).alias(f) for f in fields]
    return m.groupBy("item_id").agg(*first)


def own_labels(item_labels: DataFrame) -> DataFrame:
    """Local audit: an item's own labels as raw input of the provider ``local``; blank names are dropped."""
    return item_labels.select("item_id", F.lit("local").alias("provider"), strip(F.col("label_name")).alias("raw_label")).where("raw_label <> ''")


def without_call(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enrichment alone: (statuses, raw labels) as if every item had matched uniquely, with nothing to map."""
    statuses = items.select("item_id", F.lit("enrichment").alias("provider"), F.lit("UNIQUE").alias("status"))
    raw = statuses.select("item_id", "provider", F.lit("").alias("raw_label"), F.lit(0).cast("long").alias("pos")).where("false")
    return statuses, raw


def settled_and_waiting(statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statuses that lead to a proposal, those that a later run may change and that are only counted)."""
    waiting = F.col("status").isin(*TRANSIENT)
    return statuses.where(~waiting), statuses.where(waiting)


def status_markers(status: Column, has_unmapped: Column, prefix: str = "Curation: ") -> Column:
    """Marker labels of a status."""
    word = F.when(status == "AMBIGUOUS", "Ambiguous").when(status == "NO_MATCH", "No Match").when(status == "NO_IDENTIFIERS", "No Identifiers")
    named = F.when(word.isNotNull(), F.array(F.concat(F.lit(prefix), word))).otherwise(F.array().cast("array<string>"))
    return F.when((status == "UNIQUE") & has_unmapped, F.array(F.lit(prefix + "Unmapped"))).otherwise(named)
