"""Registered queries over the store, library runs and landed JSON, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.operators import cleanup, derive, dictionary, execute, metadata, providers
from labelwright.plans import curate, refresh
from labelwright.plans.queries import ERAS, KEYED, LOOKED, MISS, ORACLE_SQL, QUERIES, REPORT, Relations, in_size, query
from labelwright.sources import landing
from labelwright.sources.relations import spread
from labelwright.sources.shared import fresh_path
from labelwright.sources.tables import Patch, Store, ledger_rows

KEY = "CAST(item_id AS BIGINT)"


def _key(c: str = "item_id") -> Column:
    return F.col(c).cast("long")


def _at(day: str) -> Column:
    return F.to_timestamp(F.lit(day))


def twin_of(name: str):  # noqa: ANN201
    """Registers a query whose rows are those of a query that has a twin already."""

    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f = in_size(f)
        ORACLE_SQL[f.__name__] = ORACLE_SQL[name]
        return f

    return register


# --- keyed tables in layers --------------------------------------------------------------------------------------------


@twin_of("k3_upsert_state")
def k3_layered_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, k = Relations(spark, sf_dir), _key()
    store = Store(spark, fresh_path(spark, "k3"), buckets=4)
    store.commit({"item_state": Patch(r.item_state, ("item_id",))})
    results = r.items.where(k % 11 != 1).select("item_id", (k % 11 > 2).alias("ok"), F.when(k % 11 == 0, "auth").when(k % 11 == 2, "network").alias("error_kind"))
    new = execute.state_rows(execute.write_outcomes(r.items.select("item_id"), results), "runX", "cur", "fp")
    for part in (k % 3 == 0, k % 3 != 0):
        store.commit({"item_state": Patch(new.where(part), ("item_id",))})
    return store.read("item_state")


@twin_of("k4_replace_current")
def k4_layered_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    raw = spread(r.raw_labels.select("item_id", "provider", "raw_label"), r.lines(), "item_id").distinct()
    store = Store(spark, fresh_path(spark, "k4"), buckets=4)
    store.commit({"raw_current": Patch(raw, ("item_id", "provider"), about=r.lines())})
    store.commit({"raw_current": Patch(raw.where(_key() % 4 == 0).withColumn("raw_label", F.upper("raw_label")).distinct(), ("item_id", "provider"), about=r.lines() // 4)})
    return store.read("raw_current")


@twin_of("k6_ledger")
def k6_layered_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    il, n = r.item_labels, F.substring("label_id", 2, 20).cast("long")
    store = Store(spark, fresh_path(spark, "k6"), buckets=4)
    store.commit({"ownership": Patch(il.where("managed").select("item_id", "label_id", _at("2020-01-01").alias("acquired_at"), F.lit("run0").alias("acquired_run_id")), ("item_id",), about=r.lines())})
    items = r.items.where(_key() % 3 != 1).select("item_id")
    mine = store.read("ownership").join(items, "item_id", "left_semi")
    want, cur = il.where((_key() % 3 == 0) & (n % 4 != 1)).select("item_id", "label_id"), il.where(n % 2 == 0).select("item_id", "label_id")
    store.commit({"ownership": Patch(ledger_rows(mine, "replace", items, want, cur, "run1", _at("2024-01-01")), ("item_id",), items, r.lines())})
    return store.read("ownership").select("item_id", "label_id", "acquired_run_id")


@query(
    f"""SELECT 'item_state' AS what, item_id, status AS value FROM item_state WHERE {KEY} % 7 <> 0
    UNION ALL SELECT 'ownership', item_id, label_id FROM item_labels WHERE managed AND {KEY} % 7 <> 0
    UNION ALL SELECT DISTINCT 'raw_current', item_id, provider || ' ' || raw_label FROM raw_labels WHERE {KEY} % 7 <> 0
    UNION ALL SELECT 'proposals', item_id, CASE WHEN status = 'proposed' AND {KEY} % 7 = 0 THEN 'skipped missing' ELSE status END FROM proposals WHERE proposed_run_id IN ('set1', 'set2')"""
)
def k14_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, ownership, raw labels and two waiting sets after a seventh of the items has vanished."""
    r = Relations(spark, sf_dir)
    store = Store(spark, fresh_path(spark, "k14"), buckets=4)
    sets = r.proposals.select("item_id", "proposed_run_id", "status", F.lit(None).cast("string").alias("skip_reason"))
    store.commit({
        "item_state": Patch(r.item_state, ("item_id",), about=r.lines() // 4), "ownership": Patch(r.item_labels.where("managed").select("item_id", "label_id"), ("item_id",), about=r.lines()),
        "raw_current": Patch(spread(r.raw_labels.select("item_id", "provider", "raw_label"), r.lines(), "item_id").distinct(), ("item_id", "provider"), about=r.lines()),
        **{f"proposals@{s}": sets.where(F.col("proposed_run_id") == s) for s in ("set1", "set2")},
    })
    curate.purge(store, r.items.where(_key() % 7 != 0).select("item_id"))
    each = lambda what, value: store.read(what).select(F.lit(what).alias("what"), "item_id", value.alias("value"))
    return each("item_state", F.col("status")).unionByName(each("ownership", F.col("label_id"))).unionByName(each("raw_current", F.concat_ws(" ", "provider", "raw_label"))).unionByName(each("proposals", F.concat_ws(" ", "status", "skip_reason")))


# --- recovery, guards, edits ---------------------------------------------------------------------------------------------

ORACLE_SQL["x3_reconcile_metadata"] = ORACLE_SQL["x3_reconcile"].replace("ELSE 'adopted' END", "WHEN has_metadata THEN 'adopted_with_metadata' ELSE 'adopted' END")


@query()
def x3_reconcile_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    here = r.items.select("item_id", F.concat(F.lit("set"), (_key() % 4).cast("string")).alias("labels_fp"), F.lit("base").alias("ledger_fp"))
    return execute.reconciled(r.pending, here).select("item_id", "event_id", "outcome")


@query(f"SELECT proposed_run_id, bool_and(NOT (proposed_run_id = 'set3' AND {KEY} % 5 = 0) AND NOT (proposed_run_id = 'set4' AND {KEY} % 5 = 1)) AS ok FROM proposals GROUP BY 1")
def x1_same_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = Relations(spark, sf_dir).proposals, _key()
    at = F.col("proposed_run_id")
    made = p.withColumn("rules_sha", F.when((at == "set3") & (k % 5 == 0), "old").otherwise("cur")).withColumn("provider_fp", F.when((at == "set4") & (k % 5 == 1), "old").when(at == "set5", "").otherwise("fp"))
    return execute.same_inputs(made, "cur", "fp")


@query(
    """SELECT i.item_id, '{"title":"' || trim(coalesce(title, '')) || '","code":"' || trim(coalesce(code, '')) || '","urls":[' || CASE WHEN url IS NULL THEN '' ELSE '"' || url || '"' END || '],"contributor_ids":['
    || coalesce((SELECT string_agg('"' || contributor_id || '"', ',' ORDER BY contributor_id) FROM item_contributors c WHERE c.item_id = i.item_id), '') || ']}' AS fp FROM items i"""
)
def a20_metadata_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    people = r.item_contributors.groupBy("item_id").agg(F.collect_list("contributor_id").alias("contributor_ids"))
    items = r.items.join(people, "item_id", "left").withColumn("urls", F.when(F.col("url").isNotNull(), F.array("url")))
    return items.select("item_id", metadata.metadata_fingerprint(["title", "code"], ["urls", "contributor_ids"]).alias("fp"))


@query(
    """+d AS (SELECT DISTINCT p_name AS raw_label, CASE length(p_name) % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'ignore' ELSE 'map' END AS choice FROM part)
    SELECT 'edit' AS what, lower(raw_label) AS key, CASE choice WHEN 'keep' THEN 'map' ELSE choice END AS said, CASE choice WHEN 'keep' THEN raw_label WHEN 'ignore' THEN '' ELSE 'theme: ' || lower(raw_label) || '|theme: unused' END AS outputs FROM d
    UNION ALL SELECT DISTINCT 'name', n, 'theme', '' FROM (SELECT CASE choice WHEN 'keep' THEN raw_label ELSE 'theme: ' || lower(raw_label) END AS n FROM d WHERE choice <> 'ignore') AS u WHERE n NOT IN (SELECT name FROM dict_canonical)"""
)
def x7_edit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged decisions over every raw name as edits and new canonical names."""
    r, n = Relations(spark, sf_dir), F.length("p_name") % 3
    outputs = F.array(F.concat(F.lit("theme: "), F.lower("p_name")), F.lit("theme: unused"))
    decisions = r.part.select(F.col("p_name").alias("raw_label")).distinct().withColumn("p_name", F.col("raw_label"))
    decisions = decisions.select("raw_label", F.when(n == 0, "keep").when(n == 1, "ignore").otherwise("map").alias("choice"), F.when(n == 2, outputs).alias("outputs"), F.lit("theme").alias("axis"))
    edits, names = dictionary.edit_batch(decisions, r.dict_canonical)
    return edits.select(F.lit("edit").alias("what"), "key", F.col("disposition").alias("said"), F.array_join("outputs", "|").alias("outputs")).unionByName(names.select(F.lit("name").alias("what"), F.col("name").alias("key"), F.col("axis").alias("said"), F.lit("").alias("outputs")))


@query(
    f"""+listed AS (SELECT DISTINCT item_id FROM item_labels UNION SELECT CAST({KEY} + 100000000 AS STRING) FROM items WHERE {KEY} % 9 = 0)
    SELECT 'found' AS what, item_id, title FROM items WHERE item_id IN (SELECT item_id FROM listed) UNION ALL SELECT 'missing', item_id, NULL FROM listed WHERE item_id NOT IN (SELECT item_id FROM items)"""
)
def s4_fetch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    odd = r.items.where(_key() % 9 == 0).select((_key() + 100000000).cast("string").alias("item_id"))
    found, missing = execute.fetched(r.item_labels.select("item_id").unionByName(odd), r.items)
    return found.select(F.lit("found").alias("what"), "item_id", "title").unionByName(missing.select(F.lit("missing").alias("what"), "item_id", F.lit(None).cast("string").alias("title")))


@query(
    f"""+{LOOKED}, each AS (SELECT l.item_id, o.output, l.pos, row_number() OVER (PARTITION BY l.item_id, o.output ORDER BY l.pos, o.pos) AS n, o.pos AS nth FROM looked l JOIN dict_outputs o USING (key) WHERE l.disposition IN ('map', 'detail'))
    SELECT item_id, string_agg(output, '; ' ORDER BY pos, nth, output) AS names FROM each WHERE n = 1 GROUP BY 1"""
)
def o8_ordered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    out = dictionary.ordered_labels(dictionary.mapped_labels(r.raw_labels, r.dictionary()))
    return out.select("item_id", F.array_join("names", "; ").alias("names"))


# --- landed JSON -----------------------------------------------------------------------------------------------------------

BROKEN, NAMELESS = 7, 8  # of the keys modulo 50: lines cut short, lines without an id


def _landed(spark: SparkSession, name: str, rows: DataFrame, key: Column, schema: str, keys: tuple[str, ...]) -> landing.Landed:
    """``rows`` as JSON lines in a folder, some of them broken, and read again."""
    path = fresh_path(spark, name)
    line = F.to_json(F.struct(*rows.columns))
    nameless = F.to_json(F.struct(*(c for c in rows.columns if c not in keys)))
    rows.select(F.when(key % 50 == BROKEN, F.substring(line, F.lit(1), F.length(line) - 6)).when(key % 50 == NAMELESS, nameless).otherwise(line).alias("value")).write.text(path, compression="snappy")  # the lines repeat; as plain text they would be most of what is written
    return landing.read(spark, path, schema, keys)


@query(
    f"""+good AS (SELECT *, {KEY} % 50 AS m FROM items)
    SELECT 'items' AS what, item_id, CAST(0 AS BIGINT) AS pos, coalesce(title, '-') || '|' || coalesce(CAST(item_date AS STRING), '-') || '|' || coalesce(source_name, '-') AS value FROM good WHERE m NOT IN (7, 8)
    UNION ALL SELECT 'urls', item_id, 1, url FROM good WHERE url IS NOT NULL AND m NOT IN (7, 8)
    UNION ALL SELECT 'files', item_id, 1, path FROM good WHERE path IS NOT NULL AND m NOT IN (7, 8)
    UNION ALL SELECT 'fingerprints', item_id, 1, '1|' || fingerprint FROM good WHERE path IS NOT NULL AND fingerprint IS NOT NULL AND m NOT IN (7, 8)
    UNION ALL SELECT 'labels', item_id, row_number() OVER (PARTITION BY item_id ORDER BY label_id), label_id || '|' || label_name FROM item_labels WHERE {KEY} % 50 NOT IN (7, 8)
    UNION ALL SELECT 'contributors', item_id, pos, contributor_id || '|' || c.name FROM item_contributors JOIN contributors c USING (contributor_id) WHERE {KEY} % 50 NOT IN (7, 8)
    UNION ALL SELECT 'quarantine', CASE m WHEN 7 THEN 'malformed' ELSE 'no id' END, count(*), '' FROM good WHERE m IN (7, 8) GROUP BY m"""
)
def s1_item_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested items landed as JSON lines, read under their schema, laid out in tables; broken lines apart."""
    r = Relations(spark, sf_dir)
    ordered = lambda df, order, *cols: df.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *(c for c in cols if c != order)))), lambda x: F.struct(*(x[c].alias(a) for c, a in cols_of[cols].items()))).alias("_list"))
    label, person = ("label_id", "label_name"), ("contributor_id", "name")
    cols_of = {label: {"label_id": "id", "label_name": "name"}, person: {"contributor_id": "id", "name": "name"}}
    labels_ = ordered(r.item_labels.select("item_id", *label), "label_id", *label).withColumnRenamed("_list", "labels")
    people = ordered(r.item_contributors.join(r.contributors, "contributor_id").select("item_id", "pos", *person), "pos", *person).withColumnRenamed("_list", "contributors")
    files = F.when(F.col("path").isNotNull(), F.array(F.struct("path", F.when(F.col("fingerprint").isNotNull(), F.array(F.struct(F.lit("hash").alias("type"), F.col("fingerprint").alias("value")))).alias("fingerprints"))))
    rows = r.items.join(labels_, "item_id", "left").join(people, "item_id", "left")
    rows = rows.select(F.col("item_id").alias("id"), "title", F.col("item_date").cast("string").alias("date"), "code", "details", F.when(F.col("url").isNotNull(), F.array("url")).alias("urls"), files.alias("files"), "labels", "contributors", F.when(F.col("source_id").isNotNull(), F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name"))).alias("source"))
    landed = _landed(spark, "items", rows, _key("id"), landing.ITEM, ("id",))
    t = landing.item_tables(landed.rows)
    dash = lambda *cols: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols))
    each = lambda what, pos, value: t[what].select(F.lit(what).alias("what"), "item_id", pos.cast("long").alias("pos"), value.alias("value"))
    out = each("items", F.lit(0), dash("title", "item_date", "source_name"))
    for what, cols in {"urls": ["url"], "files": ["path"], "fingerprints": ["file_pos", "value"], "labels": ["label_id", "label_name"], "contributors": ["contributor_id", "name"]}.items():
        out = out.unionByName(each(what, F.col("pos"), dash(*cols)))
    return out.unionByName(landed.quarantine.groupBy(F.col("reason").alias("item_id")).agg(F.count("*").alias("pos")).select(F.lit("quarantine").alias("what"), "item_id", "pos", F.lit("").alias("value")))


@query(
    """SELECT contributor_id, name, category, CAST(birth_date AS STRING) AS birth_date, country, CAST(metric AS INT) AS metric_a FROM contributors WHERE CAST(contributor_id AS BIGINT) % 50 NOT IN (7, 8)
    UNION ALL SELECT CASE m WHEN 7 THEN 'malformed' ELSE 'no id' END, NULL, NULL, NULL, NULL, CAST(count(*) AS INT) FROM (SELECT CAST(contributor_id AS BIGINT) % 50 AS m FROM contributors) AS u WHERE m IN (7, 8) GROUP BY m"""
)
def s2_contributor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Relations(spark, sf_dir)
    rows = r.contributors.select(F.col("contributor_id").alias("id"), "name", "category", F.col("birth_date").cast("string").alias("birth_date"), "group_text", "country", F.col("metric").cast("int").alias("metric_a"), F.col("marks").alias("text_a"))
    landed = _landed(spark, "contributors", rows, _key("id"), landing.CONTRIBUTOR, ("id",))
    out = landing.contributor_tables(landed.rows)["contributors"].select("contributor_id", "name", "category", "birth_date", "country", "metric_a")
    none = F.lit(None).cast("string")
    lost = landed.quarantine.groupBy("reason").agg(F.count("*").cast("int").alias("metric_a"))
    return out.unionByName(lost.select(F.col("reason").alias("contributor_id"), *(none.alias(c) for c in ("name", "category", "birth_date", "country")), "metric_a"))


FAILED = "status IN ('RATE_LIMITED', 'UNAVAILABLE', 'NO_IDENTIFIERS')"


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """provider_outcomes as landed answers with as many candidates as they tell of, and the raw labels of the item."""
    r, k = Relations(spark, sf_dir), _key()
    labels_ = r.raw_labels.groupBy("item_id", "provider").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw_label"))), lambda x: F.struct(F.lit("").alias("stored_id"), x["raw_label"].alias("name"))).alias("l"))
    blank = F.struct(F.lit("").alias("stored_id"), F.lit("  ").alias("name"))
    entity = lambda i, name, remote: F.struct(i.alias("stored_id"), name.alias("name"), remote.alias("remote_id"))

    def candidate(i: Column) -> Column:
        odd = (k + i) % 4
        return F.struct(
            F.when(odd == 0, F.lit(None)).when(odd == 1, "  ").otherwise(F.concat(F.lit(" T "), i.cast("string"), F.lit(" "))).alias("title"), F.when(odd == 2, "AB-1").alias("code"),
            F.array(F.lit(" http://x.example/1 "), F.lit(" "), F.lit("http://x.example/2")).alias("urls"), F.concat(F.lit("r"), i.cast("string")).alias("remote_id"),
            F.concat(F.array(blank), F.coalesce("l", F.array().cast("array<struct<stored_id:string,name:string>>"))).alias("labels"),
            F.array(entity(F.lit(""), F.lit(" Ann "), F.lit("x1")), entity(F.lit("7"), F.lit(" "), F.lit("x2")), entity(F.lit("9"), F.lit("Bo"), F.lit(""))).alias("contributors"),
            F.when(odd == 3, entity(F.lit("s1"), F.lit(" Src "), F.lit(""))).otherwise(entity(F.lit("s2"), F.lit(""), F.lit("y"))).alias("source"),
        )

    n = F.col("n_candidates").cast("int")
    found = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), candidate))
    rows = r.provider_outcomes.join(labels_, ["item_id", "provider"], "left").select("item_id", "provider", F.when(F.expr(FAILED), F.col("status")).alias("failure"), found.alias("candidates"))
    return landing.answers(_landed(spark, "answers", rows, F.lit(0), landing.ANSWER, ("item_id", "provider")).rows)


@twin_of("a1_classify")
def a1_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, candidates = _answers(spark, sf_dir)
    return providers.classified(candidates, outcomes)


@query(
    f"""+c AS (SELECT item_id, provider, i, ({KEY} + i) % 4 AS odd FROM provider_outcomes, (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) AS v WHERE i <= n_candidates AND NOT {FAILED})
    SELECT item_id, provider, CASE WHEN odd IN (2, 3) THEN 'T ' || CAST(i AS STRING) END AS title, CASE WHEN odd = 2 THEN 'AB-1' END AS code, 'http://x.example/1 http://x.example/2' AS urls, '- Ann x1|9 Bo -' AS contributors, CASE WHEN odd = 3 THEN 's1 Src -' END AS source FROM c"""
)
def p9_candidate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = providers.candidate_metadata(_answers(spark, sf_dir)[1])
    said = lambda p: F.concat_ws(" ", *(F.coalesce(p[c], F.lit("-")) for c in ("stored_id", "name", "remote_id")))
    return out.select("item_id", "provider", "title", "code", F.array_join("urls", " ").alias("urls"), F.array_join(F.transform("contributors", said), "|").alias("contributors"), F.when(F.col("source").isNotNull(), said(F.col("source"))).alias("source"))


@query(
    f"""+n AS (SELECT item_id, provider, trim(raw_label) AS raw_label, 1 + row_number() OVER (PARTITION BY item_id, provider ORDER BY pos, raw_label) AS pos FROM raw_labels)
    SELECT item_id, provider, 'r' || CAST(i AS STRING) AS provider_item_id, raw_label, CAST(pos AS BIGINT) AS pos FROM n JOIN provider_outcomes o USING (item_id, provider), (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) AS v WHERE i <= n_candidates AND NOT {FAILED}"""
)
def p10_candidate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.candidate_labels(_answers(spark, sf_dir)[1])


@query(
    f"""+u AS (SELECT item_id, provider, CASE provider WHEN 'p2' THEN 0 WHEN 'p0' THEN 1 ELSE 2 END AS rank, ({KEY} + 1) % 4 AS odd FROM provider_outcomes WHERE n_candidates = 1 AND NOT {FAILED})
    SELECT item_id, CASE WHEN odd IN (2, 3) THEN 'T 1' END AS title, CASE WHEN odd IN (2, 3) THEN provider END AS title_from, provider AS urls_from FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM u) AS z WHERE n = 1"""
)
def a4_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the unique candidates, merged by the providers' ranks."""
    outcomes, candidates = _answers(spark, sf_dir)
    unique = providers.of_unique(candidates, providers.classified(candidates, outcomes))
    found = spark.createDataFrame([("p0", "http://zero.example", 0), ("p1", "http://one.example", 1), ("p2", "http://two.example", 2)], "name string, url string, found int")
    ranks = providers.ranked(found, ["TWO", "zero"]).withColumnRenamed("name", "provider")
    out = providers.merged_metadata(providers.candidate_metadata(unique), ranks, ("title", "urls"))
    return out.select("item_id", "title.value", "title.provider", "urls.provider").toDF("item_id", "title", "title_from", "urls_from")


# --- a whole library run -----------------------------------------------------------------------------------------------------

RUN_PHASES = ("never_processed", "stale_rules", "failed", "affected_by_mapping", "enrich_only")
SCOPES = {
    "never_processed": "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM {state} WHERE last IS NOT NULL AND last <> '')",
    "stale_rules": "SELECT item_id FROM {state} WHERE last IS NOT NULL AND NOT (coalesce(sha, '') = 'cur' AND coalesce(fp, '') = 'fp')",
    "failed": "SELECT item_id FROM {state} WHERE status = 'failed'",
    "affected_by_mapping": "SELECT DISTINCT item_id FROM {raw} WHERE regexp_replace(lower(trim(raw_label)), ',+$', '') IN (SELECT key FROM dict_rules WHERE disposition = 'defer')",
    "enrich_only": "SELECT item_id FROM items",
}


def _phase_sql(n: int, scope: str) -> str:
    """The CTEs of one phase over those of the phase before: labels, owned, state, raw, open and the rows that it adds."""
    b, p, additive = f"p{n - 1}_", f"p{n}_", scope == "enrich_only"
    todo = SCOPES[scope].format(state=f"{b}state", raw=f"{b}raw")
    status = f"SELECT item_id, 'UNIQUE' AS status FROM {p}todo" if additive else f"SELECT item_id, status FROM merged_all WHERE item_id IN (SELECT item_id FROM {p}todo)"
    said = "false" if additive else "true"
    flag = "true" if additive else "false"
    part = f"run1-{scope}"
    return f"""
    {p}todo AS MATERIALIZED ({todo}),
    {p}all AS MATERIALIZED ({status}),
    {p}auth AS MATERIALIZED (SELECT item_id, status, status = 'UNIQUE' AND {said} AS authoritative, {flag} AS additive FROM {p}all WHERE status NOT IN ('RATE_LIMITED', 'UNAVAILABLE')),
    {p}ans AS MATERIALIZED (SELECT l.* FROM looked l JOIN provider_outcomes o USING (item_id, provider) WHERE o.status = 'UNIQUE' AND {said} AND item_id IN (SELECT item_id FROM {p}auth)),
    {p}un AS (SELECT item_id, bool_or(unmapped) AS un FROM {p}ans GROUP BY 1),
    {p}cur AS MATERIALIZED (SELECT h.item_id, h.label_id, h.name, o.label_id IS NOT NULL AS managed, lower(h.name) LIKE 'keep: %' AS protected FROM {b}have h JOIN {p}auth USING (item_id) LEFT JOIN {b}owned o ON o.item_id = h.item_id AND o.label_id = h.label_id),
    {p}rows AS (SELECT c.item_id, name, 0 AS part FROM {p}cur c JOIN {p}auth a USING (item_id) WHERE NOT authoritative OR NOT managed
        UNION ALL SELECT c.item_id, name, 4 FROM {p}cur c JOIN {p}auth a USING (item_id) WHERE authoritative AND managed AND protected
        UNION ALL SELECT m.item_id, o.output, 1 FROM {p}ans m JOIN dict_outputs o USING (key) JOIN {p}auth a USING (item_id) WHERE m.disposition IN ('map', 'detail') AND (authoritative OR additive)
            AND NOT (o.output = 'theme: ' || key AND length(key) % 5 = 0 AND m.item_id IN (SELECT item_id FROM said_people))
        UNION ALL SELECT d.item_id, name, 2 FROM derived_all d JOIN {p}auth a USING (item_id) WHERE authoritative OR additive
        UNION ALL SELECT a.item_id, CASE status WHEN 'AMBIGUOUS' THEN 'Curation: Ambiguous' WHEN 'NO_MATCH' THEN 'Curation: No Match' WHEN 'NO_IDENTIFIERS' THEN 'Curation: No Identifiers' WHEN 'UNIQUE' THEN CASE WHEN coalesce(un, false) THEN 'Curation: Unmapped' END END, 3
            FROM {p}auth a LEFT JOIN {p}un USING (item_id) WHERE NOT additive),
    {p}want AS MATERIALIZED (SELECT item_id, name FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(name) ORDER BY part, name) AS n FROM {p}rows WHERE name IS NOT NULL) AS z WHERE n = 1),
    {p}named AS MATERIALIZED (SELECT w.item_id, w.name, coalesce(l.label_id, o.label_id) AS label_id FROM {p}want w LEFT JOIN by_name l ON lower(w.name) = l.n
        LEFT JOIN (SELECT item_id, lower(name) AS n, min(label_id) AS label_id FROM {b}have GROUP BY 1, 2) o ON o.item_id = w.item_id AND o.n = lower(w.name)),
    {p}change AS (SELECT DISTINCT item_id FROM (SELECT coalesce(c.item_id, w.item_id) AS item_id, c.name AS had, w.name AS want, managed, protected FROM {p}cur c FULL JOIN {p}want w ON c.item_id = w.item_id AND lower(c.name) = lower(w.name)) AS z
        WHERE had IS NULL OR (want IS NULL AND managed AND NOT protected)),
    {p}out AS MATERIALIZED (SELECT a.item_id, a.status, a.authoritative, CASE WHEN a.item_id IN (SELECT item_id FROM {b}open) THEN 'deferred' WHEN a.item_id IN (SELECT item_id FROM {p}named WHERE label_id IS NULL) THEN 'missing_labels'
        WHEN a.item_id IN (SELECT item_id FROM {p}change) THEN 'apply' ELSE 'noop' END AS outcome, CAST(a.item_id AS BIGINT) % 23 AS k FROM {p}auth a),
    {p}done AS MATERIALIZED (SELECT * FROM {p}out WHERE outcome = 'noop' OR (outcome = 'apply' AND k > 1)),
    {p}new AS MATERIALIZED (SELECT DISTINCT n.item_id, n.label_id, n.name FROM {p}named n JOIN {p}done USING (item_id)),
    {p}have AS MATERIALIZED (SELECT item_id, label_id, name FROM {p}new WHERE item_id IN (SELECT item_id FROM {p}done WHERE outcome = 'apply') UNION ALL SELECT * FROM {b}have WHERE item_id NOT IN (SELECT item_id FROM {p}done WHERE outcome = 'apply')),
    {p}owned AS MATERIALIZED (SELECT o.* FROM {b}owned o LEFT JOIN {p}done d USING (item_id) WHERE d.item_id IS NULL OR NOT d.authoritative OR EXISTS (SELECT 1 FROM {p}new n WHERE n.item_id = o.item_id AND n.label_id = o.label_id)
        UNION SELECT n.item_id, n.label_id FROM {p}new n WHERE NOT EXISTS (SELECT 1 FROM {b}have h WHERE h.item_id = n.item_id AND h.label_id = n.label_id)),
    {p}state AS MATERIALIZED (SELECT item_id, 'success' AS status, '{part}' AS last, 'cur' AS sha, 'fp' AS fp FROM {p}done UNION ALL SELECT item_id, 'failed', NULL, NULL, NULL FROM {p}out WHERE outcome = 'apply' AND k <= 1
        UNION ALL SELECT * FROM {b}state WHERE item_id NOT IN (SELECT item_id FROM {p}out WHERE outcome IN ('apply', 'noop'))),
    {p}raw AS MATERIALIZED (SELECT DISTINCT a.item_id, a.provider, a.raw_label FROM {p}ans a JOIN {p}done USING (item_id) UNION ALL SELECT * FROM {b}raw r WHERE NOT EXISTS (SELECT 1 FROM {p}ans a JOIN {p}done d USING (item_id) WHERE a.item_id = r.item_id AND a.provider = r.provider)),
    {p}open AS MATERIALIZED (SELECT item_id FROM {b}open UNION SELECT item_id FROM {p}out WHERE outcome = 'apply' AND k = 1),
    {p}log AS MATERIALIZED (SELECT 'journal' AS what, '{part} ' || item_id AS id, CASE k WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' ELSE 'applied' END AS value FROM {p}out WHERE outcome = 'apply'
        UNION ALL SELECT 'attempts', '{part} ' || item_id, CASE WHEN outcome = 'apply' AND k <= 1 THEN 'failed' ELSE 'success' END FROM {p}out WHERE outcome IN ('apply', 'noop')
        UNION ALL SELECT 'attempts', '{part} ' || item_id, 'transient' FROM {p}all WHERE status IN ('RATE_LIMITED', 'UNAVAILABLE')
        UNION ALL SELECT 'proposals', '{part} ' || item_id, CASE WHEN outcome = 'apply' AND k <= 1 THEN 'skipped write_failed' WHEN outcome IN ('apply', 'noop') THEN 'executed' WHEN outcome = 'deferred' THEN 'deferred deferred' ELSE 'skipped ' || outcome END FROM {p}out)"""


LIBRARY_RUN = (
    f"+{LOOKED}, merged_all AS MATERIALIZED (SELECT item_id, CASE WHEN bool_or(status = 'AMBIGUOUS') THEN 'AMBIGUOUS' WHEN bool_or(status = 'UNIQUE') THEN CASE WHEN bool_or(status = 'RATE_LIMITED') THEN 'RATE_LIMITED' WHEN bool_or(status = 'UNAVAILABLE') THEN 'UNAVAILABLE' ELSE 'UNIQUE' END "
    "WHEN bool_or(status = 'RATE_LIMITED') THEN 'RATE_LIMITED' WHEN bool_or(status = 'UNAVAILABLE') THEN 'UNAVAILABLE' WHEN bool_or(status = 'NO_MATCH') THEN 'NO_MATCH' ELSE 'NO_IDENTIFIERS' END AS status FROM provider_outcomes GROUP BY 1), "
    "derived_all AS MATERIALIZED (SELECT DISTINCT ic.item_id, 'Has Marks' AS name FROM item_contributors ic JOIN contributors c USING (contributor_id) WHERE lower(trim(marks)) NOT IN ('none', 'no', 'n/a', 'unknown', '') "
    "UNION ALL SELECT item_id, CASE WHEN year(item_date) <= 1993 THEN 'Era: Early' WHEN year(item_date) <= 1996 THEN 'Era: Middle' ELSE 'Era: Late' END FROM items WHERE item_date IS NOT NULL), "
    "said_people AS MATERIALIZED (SELECT DISTINCT item_id FROM item_contributors JOIN contributors USING (contributor_id) WHERE trim(coalesce(group_text, '')) <> ''), "
    "known AS (SELECT label_id, name FROM labels UNION ALL SELECT 'N' || name, name FROM (SELECT DISTINCT name FROM derived_all UNION SELECT unnest(['Curation: Ambiguous', 'Curation: No Match', 'Curation: No Identifiers', 'Curation: Unmapped'])) AS u), "
    "by_name AS MATERIALIZED (SELECT lower(name) AS n, min(label_id) AS label_id FROM known GROUP BY 1), "
    "p0_have AS MATERIALIZED (SELECT item_id, label_id, label_name AS name FROM item_labels), p0_owned AS (SELECT item_id, label_id FROM item_labels WHERE managed), "
    "p0_state AS (SELECT item_id, status, last_successful_run_id AS last, rules_sha AS sha, provider_fp AS fp FROM item_state), p0_raw AS (SELECT item_id, provider, raw_label FROM raw_labels WHERE false), p0_open AS (SELECT item_id FROM items WHERE false)"
    + "".join("," + _phase_sql(n, s) for n, s in enumerate(RUN_PHASES, 1))
    + """, uses AS (SELECT label_id FROM p5_have UNION SELECT label_id FROM assignments WHERE kind <> 'item'),
    gone AS (SELECT label_id, name FROM known k WHERE label_id NOT IN (SELECT label_id FROM uses) AND name NOT IN (SELECT name FROM dict_canonical) AND name NOT IN (SELECT output FROM dict_outputs) AND name NOT IN (SELECT name FROM derived_all)
        AND name NOT IN ('Curation: Ambiguous', 'Curation: No Match', 'Curation: No Identifiers', 'Curation: Unmapped') AND (name LIKE 'Curation: %' OR (name LIKE '%: %' AND split_part(name, ': ', 1) IN ('theme', 'group'))))
    SELECT 'item_labels' AS what, item_id AS id, label_id AS value FROM p5_have UNION ALL SELECT 'ownership', item_id, label_id FROM p5_owned UNION ALL SELECT 'item_state', item_id, status || ' ' || coalesce(last, '-') || ' ' || coalesce(sha, '-') || ' ' || coalesce(fp, '-') FROM p5_state
    UNION ALL SELECT 'raw_current', item_id || ' ' || provider, raw_label FROM p5_raw UNION ALL SELECT 'label_deletions', label_id, name FROM gone
    """ + "".join(f" UNION ALL SELECT * FROM p{n}_log" for n in range(1, len(RUN_PHASES) + 1))
    + " UNION ALL SELECT 'runs', 'run1', 'completed'" + "".join(f" UNION ALL SELECT 'runs', 'run1-{s}', 'completed'" for s in RUN_PHASES)
)


@query(LIBRARY_RUN)
def x5_library_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table after a run of all five phases and orphan removal, in which one write in 23 is refused and one has no known outcome."""
    r, k = Relations(spark, sf_dir), _key()
    store = Store(spark, fresh_path(spark, "library"), buckets=4)
    derived = derive.presence(r.people(), {"marks": "Has Marks"}).unionByName(derive.eras(r.items, ERAS))
    made = derived.select("name").distinct().unionByName(spark.range(1).select(F.explode(F.lit([curate.MARKER_PREFIX + m for m in curate.MARKERS])).alias("name")))
    known = r.labels.unionByName(made.select(F.concat(F.lit("N"), "name").alias("label_id"), "name"))
    have = store.scratch("have", r.item_labels)  # two tables are made of it
    store.commit({
        "item_labels": Patch(have.select("item_id", "label_id", F.col("label_name").alias("name")), ("item_id",)),
        "ownership": Patch(have.where("managed").select("item_id", "label_id", _at("2020-01-01").alias("acquired_at"), F.lit("run0").alias("acquired_run_id")), ("item_id",)),
        "item_state": Patch(r.item_state, ("item_id",)), "raw_current": Patch(r.raw_labels.limit(0).select("item_id", "provider", "raw_label"), ("item_id", "provider")),
        "labels": Patch(known, ("label_id",)), "assignments": r.assignments.where("kind <> 'item'"), "derived": derived,
    })
    said = lambda intents: intents.where(k % 23 != 1).select("item_id", (k % 23 > 1).alias("ok"), F.when(k % 23 == 0, "auth").alias("error_kind"))
    computed = r.dict_outputs.where("output = concat('theme: ', key) AND length(key) % 5 = 0").select(F.col("output").alias("name"))
    people = r.item_contributors.join(r.contributors, "contributor_id").select("item_id", "group_text")
    inputs = curate.Inputs(r.items.select("item_id"), r.raw_labels, r.provider_outcomes.select("item_id", "provider", "status"), store.read("labels"), store.read("derived"), r.dictionary(), people=people, computed=computed, results=said)
    keys = r.dict_rules.where("disposition = 'defer'").select("key")
    curate.curate(store, inputs, "run1", "cur", "fp", ["keep: "], keys=keys, phases=RUN_PHASES)
    dash = lambda *cols: F.concat_ws(" ", *(F.coalesce(c, F.lit("-")) for c in cols))
    each = lambda what, id_, value: store.read(what).select(F.lit(what).alias("what"), id_.alias("id"), value.alias("value"))
    item = F.col("item_id")
    out = [
        each("item_labels", item, F.col("label_id")), each("ownership", item, F.col("label_id")), each("item_state", item, dash("status", "last_successful_run_id", "rules_sha", "provider_fp")),
        each("raw_current", F.concat_ws(" ", "item_id", "provider"), F.col("raw_label")), each("label_deletions", F.col("label_id"), F.col("name")), each("journal", F.concat_ws(" ", "run_id", "item_id"), F.col("status")),
        each("attempts", F.concat_ws(" ", "run_id", "item_id"), F.col("status")), each("proposals", F.concat_ws(" ", "proposed_run_id", "item_id"), F.concat_ws(" ", "status", "skip_reason")), each("runs", F.col("run_id"), F.col("status")),
    ]
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows


# --- all reports at once -------------------------------------------------------------------------------------------------------


@query(
    f"""+{LOOKED}, {REPORT.removeprefix(KEYED + ", ")}, {MISS.removeprefix(LOOKED + ", ")}, t AS (SELECT run_id, count(*) FILTER (status = 'success') AS s FROM attempts GROUP BY 1),
    history AS (SELECT run_id, (SELECT coalesce(CAST(sum(s) AS BIGINT), 0) FROM t JOIN runs c USING (run_id) WHERE coalesce(c.parent_run_id, c.run_id) = r.run_id) AS n FROM runs r WHERE parent_run_id IS NULL)
    SELECT 'dashboard' AS what, 'total' AS name, count(*) AS n FROM items UNION ALL SELECT 'dashboard', 'processed', count(*) FILTER (last_successful_run_id IS NOT NULL AND last_successful_run_id <> '') FROM item_state UNION ALL SELECT 'dashboard', 'failed', count(*) FILTER (status = 'failed') FROM item_state
    UNION ALL SELECT 'dashboard', 'unmapped_labels', count(DISTINCT raw_label) FROM miss UNION ALL SELECT 'dashboard', 'unmapped_items', count(DISTINCT item_id) FROM miss
    UNION ALL SELECT 'unmapped_labels', raw_label, n FROM (SELECT raw_label, count(DISTINCT item_id) AS n FROM miss GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100) AS m
    UNION ALL SELECT 'dictionary', key || ' ' || status, n_items FROM (SELECT * FROM report ORDER BY n_items DESC, key LIMIT 5000) AS d
    UNION ALL SELECT 'rules_audit', disposition, count(*) FROM dict_rules GROUP BY 2 UNION ALL SELECT 'rules_audit', axis, count(*) FROM dict_canonical GROUP BY 2
    UNION ALL SELECT 'run_history', run_id, n FROM history
    UNION ALL SELECT 'proposal_detail', item_id, set_total FROM (SELECT item_id, count(*) OVER (PARTITION BY proposed_run_id) AS set_total, has_change, proposed_run_id FROM proposals ORDER BY has_change DESC, proposed_run_id, item_id LIMIT 500) AS p"""
)
def x10_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot of one refresh over a store."""
    r = Relations(spark, sf_dir)
    store = Store(spark, fresh_path(spark, "reports"), buckets=4)
    store.commit({"item_state": Patch(r.item_state, ("item_id",), about=r.lines() // 4), "raw_current": Patch(r.raw_labels.select("item_id", "provider", "raw_label"), ("item_id", "provider"), about=r.lines()), "runs": Patch(r.runs, ("run_id",)), "attempts@all": r.attempts, "proposals@all": r.proposals})
    phases = r.proposals.select("proposed_run_id", F.substring("proposed_run_id", 4, 9).cast("long").alias("phase_pos")).distinct()
    refresh.refresh(store, r.dictionary(), r.items.select("item_id"), phases, "cur", "fp")
    each = lambda what, name, n: store.read(f"snapshot_{what}").select(F.lit(what).alias("what"), name.alias("name"), n.cast("long").alias("n"))
    totals = F.create_map(*(x for c in ("total", "processed", "failed", "unmapped_labels", "unmapped_items") for x in (F.lit(c), F.col(c))))
    board = store.read("snapshot_dashboard").select(F.lit("dashboard").alias("what"), F.explode(totals).alias("name", "n"))
    out = board.unionByName(each("unmapped_labels", F.col("raw_label"), F.col("n_items"))).unionByName(each("dictionary", F.concat_ws(" ", "key", "status"), F.col("n_items")))
    out = out.unionByName(each("rules_audit", F.col("name"), F.col("n"))).unionByName(each("run_history", F.col("run_id"), F.coalesce("success", F.lit(0))))
    return out.unionByName(each("proposal_detail", F.col("item_id"), F.col("set_total")))
