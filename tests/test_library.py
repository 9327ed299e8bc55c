"""The library's own operators: twins on the smallest tables, and table-driven cases."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from labelwright.functions import text as tx
from labelwright.functions.redact import redacted
from labelwright.operators import cleanup, derive, dictionary, execute, labels, metadata, providers, quality
from labelwright.operators.derive import Bucket
from labelwright.plans import queries, reports
from labelwright.sources.tables import Store
from tests.oracle import differences

#: A query of each group; all of them are compared by tests/oracle.py.
SOME = ("t2_reasons", "t3_ledger", "k2_journal", "k8_deletions", "k11_edit_audit", "x5_curate", "a18_fingerprint", "f_text", "a2_merge_status", "a4_merge_metadata", "d1_ages", "d3_groups", "x2_fill_empty", "j7_resolve_entities", "p1_scope_stale_rules", "x1_revalidate", "x3_reconcile", "k6_ledger", "p7b_own_orphans", "t7_vocabulary", "x6_edit_dictionary", "x9_compare", "j12_dictionary_report", "o6_proposal_page", "q2_bucket_gaps", "f_scalars")


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, tiny, name):
    assert differences(spark, tiny, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_dictionary_key(spark):
    cases = [("\xa0Foo, ", "foo"), ("Foo,\t", "foo"), ("\x1cFoo\x1f", "foo"), ("tag ,", "tag "), ("A,,,", "a"), (" in  ner ", "in  ner"), (",", ""), ("", "")]
    got = values(spark, [(a,) for a, _ in cases], "x string", tx.dict_key(F.col("x")))
    assert [g for (g,) in got] == [b for _, b in cases]


def test_folding(spark):
    df = spark.createDataFrame([("Stra\u00dfe",), ("STRASSE",), ("plain one",), ("\uff21b\u2014-c.",), (None,), ("plain one",)], "x string")
    got = sorted((r.x or "", r.f or "") for r in tx.with_folded(df, "x", "f", tx.fold_label).collect())
    assert got == sorted([("Stra\u00dfe", "strasse"), ("STRASSE", "strasse"), ("plain one", "plain one"), ("plain one", "plain one"), ("\uff21b\u2014-c.", "ab-c"), ("", "")])
    assert tx.fold_label(tx.fold_label("\u201cX\u201d  y.,")) == tx.fold_label("\u201cX\u201d  y.,")
    assert [tx.fold_label(x) for x in ('"Foo"', "\u2018Bar\u2019s\u2019,", "a\u00adb", "x\u201ay", "'z'.")] == ["foo", "bar's", "a-b", "x,y", "z"]


def test_scalars(spark):
    row = values(spark, [(' ["a", " ", "b"]', "x, ,y", "a~/b", "C:\\d\\e.mp4", "2024-01-02T10:00:00Z", "ab/ /c ")], "a string, b string, c string, d string, e string, f string",
                 tx.text_list(F.col("a")), tx.text_list(F.col("b")), tx.pointer_part(F.col("c")), tx.basename(F.col("d")), tx.lenient_date(F.col("e")), tx.slash_parts(F.col("f")))
    assert row == [(["a", "b"], ["x", "y"], "a~0~1b", "e.mp4", datetime.date(2024, 1, 2), ["ab", "c"])]


def test_redaction_reaches_nested_fields(spark):
    df = spark.createDataFrame([("ok", ("keep", "gone"), ["Bearer abc", "fine"])], "a string, s struct<x:string,api_key:string>, l array<string>")
    odd = spark.createDataFrame([("under /home/me/x", "Session_Cookie=1", {"provider_api_key": "a", "ok": "/mnt/a"}, "fine")], "a string, b string, m map<string,string>, client_secret string")
    assert redacted(odd).first().asDict() == {"a": "[REDACTED]", "b": "[REDACTED]", "m": {"ok": "[REDACTED]"}}
    r = redacted(df).first()
    assert r.s.asDict() == {"x": "keep"} and r.l == ["[REDACTED]", "fine"]


def test_age_is_calendar_age(spark):
    rows = [(datetime.date(2000, 2, 29), datetime.date(2018, 2, 28)), (datetime.date(2000, 5, 2), datetime.date(2018, 5, 1)), (datetime.date(2000, 5, 2), datetime.date(2018, 5, 2))]
    assert values(spark, rows, "b date, d date", derive.age(F.col("b"), F.col("d"))) == [(18,), (17,), (18,)]


def test_every_pair_of_statuses(spark):
    every = ("AMBIGUOUS", "UNIQUE", "RATE_LIMITED", "UNAVAILABLE", "NO_MATCH", "NO_IDENTIFIERS")

    def expected(a, b, partial):
        have = {a, b}
        if "AMBIGUOUS" in have:
            return "AMBIGUOUS"
        waiting = next((s for s in ("RATE_LIMITED", "UNAVAILABLE") if s in have), None)
        if "UNIQUE" in have:
            return "UNIQUE" if partial or not waiting else waiting
        return waiting or ("NO_MATCH" if "NO_MATCH" in have else "NO_IDENTIFIERS")

    rows = [(f"{a}|{b}", p, s) for a in every for b in every for p, s in (("1", a), ("2", b))]
    for partial in (False, True):
        got = providers.merged_status(spark.createDataFrame(rows, "item_id string, provider string, status string"), partial).collect()
        assert {r.item_id: r.status for r in got} == {f"{a}|{b}": expected(a, b, partial) for a in every for b in every}


def test_desired_keeps_what_people_attached(spark):
    current = spark.createDataFrame([("1", "Mine", False, False), ("1", "old", True, False), ("1", "Keep: x", True, True), ("2", "Mine", False, False), ("3", "a", True, False)], "item_id string, name string, managed boolean, protected boolean")
    mapped = spark.createDataFrame([("1", "MINE"), ("1", "new"), ("2", "new"), ("3", "new")], "item_id string, name string")
    marks = spark.createDataFrame([("2", "Curation: No Match")], "item_id string, name string")
    authority = spark.createDataFrame([("1", True, False), ("2", False, False), ("3", False, True)], "item_id string, authoritative boolean, additive boolean")
    got = labels.desired(current, mapped, mapped.limit(0), marks, authority)
    assert sorted((r.item_id, r.name) for r in got.collect()) == [("1", "Keep: x"), ("1", "Mine"), ("1", "new"), ("2", "Curation: No Match"), ("2", "Mine"), ("3", "a"), ("3", "new")]
    why = {(r.item_id, r.name): r.reason for r in labels.reasons(current, got).collect()}
    assert why["1", "old"] == "removed_managed" and why["1", "Mine"] == "preserved_external" and why["1", "Keep: x"] == "preserved_protected" and why["1", "new"] == "added" and ("3", "a") not in why


def test_names_fold_as_unicode_says(spark):
    names = ["Stra\u00dfe", "STRASSE", "stra\u1e9ee", "\ufb01n", "FIN", "\u03a3\u0391\u03a3", "\u03c3\u03b1\u03c2", "\u0131x", "Ix", "plain"]
    got = dict(values(spark, [(n,) for n in names], "x string", F.col("x"), tx.fold_case(F.col("x"))))
    assert all((got[a] == got[b]) == (a.casefold() == b.casefold()) for a in names for b in names)
    cur = spark.createDataFrame([("1", "Stra\u00dfe", False, False)], "item_id string, name string, managed boolean, protected boolean")
    mapped = spark.createDataFrame([("1", "STRASSE")], "item_id string, name string")
    authority = spark.createDataFrame([("1", True, False)], "item_id string, authoritative boolean, additive boolean")
    assert [r.name for r in labels.desired(cur, mapped, mapped.limit(0), mapped.limit(0), authority).collect()] == ["Stra\u00dfe"]


def test_first_failing_check_decides(spark):
    p = spark.createDataFrame([("1", "replace", "x", "2999-01-01T00:00:00Z", "deferred", "a", True), ("2", "other", "", "1990-01-01T00:00:00Z", "proposed", "a", True), ("3", "replace", "[]", "2999-01-01T00:00:00Z", "proposed", "b", False), ("9", "replace", "[]", "2999-01-01T00:00:00Z", "proposed", "b", False)], "item_id string, mode string, seen_ledger_fp string, expires_at string, status string, seen_labels_fp string, has_change boolean")
    present = spark.createDataFrame([("1", "z", "z"), ("2", "z", "z"), ("3", "b", "[]")], "item_id string, labels_fp string, ledger_fp string")
    got = execute.revalidated(p, present, p.limit(0).select("item_id"), F.to_timestamp(F.lit("2024-01-01T00:00:00Z"))).collect()
    assert {r.item_id: r.outcome for r in got} == {"1": "deferred", "2": "expired", "3": "noop", "9": "missing"}


def test_suggestions_equal_difflib_over_all_pairs(spark):
    r = random.Random(1)
    keys = ["".join(r.choice("abcde ") for _ in range(r.randint(3, 12))).strip() for _ in range(60)]
    names = ["".join(r.choice("abcde ") for _ in range(r.randint(3, 12))).strip() for _ in range(80)] + [k[:-1] + "z" for k in keys[:20]]
    got = reports.suggestions(spark.createDataFrame([(k,) for k in set(keys)], "key string"), spark.createDataFrame([(n,) for n in names], "text string"), "name").collect()
    want = {(k, n) for k in set(keys) for n in difflib.get_close_matches(k, [n for n in sorted(set(names)) if n != k], n=3, cutoff=0.75)}
    assert {(g.key, g.candidate) for g in got} == want


def test_suggestions_of_keys_and_names(spark):
    texts = lambda *x: spark.createDataFrame([(v,) for v in x], "text string")
    keys, names = texts("red house", "red horse", "red hose"), texts("Red house", "red house", "red houses", "blue")
    got = reports.all_suggestions(spark.createDataFrame([("red houses",)], "key string"), keys, names).collect()
    assert sorted((r.kind, r.candidate) for r in got) == [("key", "red horse"), ("key", "red hose"), ("key", "red house"), ("name", "red houses")]


def test_metadata_fills_only_what_is_empty(spark):
    schema = "item_id string, title string, urls array<string>"
    items = spark.createDataFrame([("1", " ", []), ("2", "T", ["u"]), ("3", None, None)], schema)
    found = spark.createDataFrame([("1", "N", ["v"]), ("2", "N", ["v"]), ("3", " ", ["v"])], schema)
    diff = metadata.fill_empty(items, found, ("title", "urls"))
    assert sorted((r.item_id, r.field) for r in diff.collect()) == [("1", "title"), ("1", "urls"), ("3", "urls")]
    assert {r.item_id: r.title for r in metadata.applied(items, diff.where("field = 'title'"), ("title",)).collect()} == {"1": "N", "2": "T", "3": None}


def test_vocabulary_is_never_an_orphan(spark, tiny):
    r = queries.Relations(spark, tiny)
    own = queries._own_orphans(r).select("name")
    assert own.join(queries._vocabulary(r), "name", "left_semi").count() == 0
    assert len(spark.range(1).select(cleanup.notations(("M", "F"), 4, 3)).first()[0]) == 7


def test_compare_with_itself_is_empty(spark, tiny):
    d = queries.Relations(spark, tiny).dictionary()
    assert dictionary.compared(d, d).count() == 0 and dictionary.compared_axes(d.canonical, d.canonical).count() == 0
    again = dictionary.Dictionary(d.rules.orderBy(F.rand()), d.outputs.orderBy(F.rand()), d.canonical)
    assert dictionary.fingerprint(d).first() == dictionary.fingerprint(again).first()


def test_load_dictionary(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"canonical_tags": {"theme": ["theme: a"]}, "mappings": {"Foo, ": {"disposition": "map", "outputs": ["theme: a", "b"]}, "bar": {"disposition": "ignore"}}}')
    d = dictionary.Dictionary.load(spark, f"file://{tmp_path}/d.json")
    assert {r.key: (r.disposition, r.outputs) for r in d.lookup().collect()} == {"foo": ("map", ["theme: a", "b"]), "bar": ("ignore", [])}
    assert quality.wrong_outputs(d.rules, d.outputs).count() == 0


def test_rerun_changes_nothing(spark, tiny):
    r = queries.Relations(spark, tiny)
    wanted, authority = queries._wanted(r), r.authority()
    mapped = dictionary.mapped_labels(r.raw_labels, r.dictionary()).select("item_id", F.col("output").alias("name"))
    mine = mapped.join(authority.where("authoritative"), "item_id", "left_semi").select("item_id", F.lower("name").alias("_n")).distinct().withColumn("_m", F.lit(True))
    after = wanted.withColumn("_n", F.lower("name")).join(mine, ["item_id", "_n"], "left").select("item_id", "name", F.coalesce("_m", F.lit(False)).alias("managed"), labels.is_protected(F.col("name"), [], ["keep: "]).alias("protected"))
    again = labels.desired(after, mapped, mapped.limit(0), mapped.limit(0), authority)
    assert labels.reasons(after, again).where("reason IN ('added', 'removed_managed')").count() == 0


def test_buckets(spark):
    b = [Bucket(None, 9, "low"), Bucket(10, 19, "mid"), Bucket(20, None, "high")]
    assert [x for (x,) in values(spark, [(-5,), (9,), (10,), (99,), (None,)], "v int", derive.bucket_of(F.col("v"), b))] == ["low", "low", "mid", "high", None]


def library(spark, path):
    from labelwright.plans.curate import Inputs

    s, make = Store(spark, f"file://{path}", buckets=2), spark.createDataFrame
    s.commit({
        "item_labels": make([("1", "L9", "Mine"), ("2", "L9", "Mine"), ("1", "L5", "theme: gone")], "item_id string, label_id string, name string"),
        "ownership": make([("1", "L5", None, "run0")], "item_id string, label_id string, acquired_at timestamp, acquired_run_id string"),
        "item_state": make([], "item_id string, status string, last_successful_run_id string, rules_sha string, provider_fp string"),
        "raw_current": make([], "item_id string, provider string, raw_label string"),
        "item_metadata": make([("1", " ", None), ("2", "T", ["u"]), ("3", None, [])], "item_id string, title string, urls array<string>"),
        "labels": make([("L1", "theme: foo"), ("L2", "Curation: No Match"), ("L5", "theme: gone"), ("L9", "Mine")], "label_id string, name string"),
    })
    d = dictionary.Dictionary(make([("foo", "map"), ("bar", "ignore")], "key string, disposition string"), make([("foo", "theme: foo", 1)], "key string, output string, pos long"), make([("theme", "theme: foo", 1)], "axis string, name string, pos long"))
    inputs = Inputs(
        make([("1",), ("2",), ("3",), ("4",)], "item_id string"), make([("1", "p", "Foo,", 1), ("1", "p", "bar", 2), ("2", "p", "foo", 1), ("3", "p", "foo", 1)], "item_id string, provider string, raw_label string, pos long"),
        make([("1", "p", "UNIQUE"), ("2", "p", "NO_MATCH"), ("3", "p", "UNIQUE"), ("4", "p", "UNAVAILABLE")], "item_id string, provider string, status string"),
        s.read("labels"), make([], "item_id string, name string"), d, make([("1", "New", ["v"]), ("3", "New", ["w"])], "item_id string, title string, urls array<string>"), ("title", "urls"),
    )
    return s, inputs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_library_run_is_idempotent(spark, tmp_path):
    from labelwright.plans.curate import curate

    s, inputs = library(spark, tmp_path)
    first = {p.item_id: p for p in curate(s, inputs, "run1", "sha", "fp", [], preview=True, phases=("never_processed",))["never_processed"].collect()}
    assert first["1"].added == ["theme: foo"] and first["1"].removed_managed == ["theme: gone"] and s.read("item_labels").count() == 3 and "4" not in first
    curate(s, inputs, "run1", "sha", "fp", [], phases=("never_processed",))
    assert rows(s.read("item_labels"), "item_id", "name") == [("1", "Mine"), ("1", "theme: foo"), ("2", "Curation: No Match"), ("2", "Mine"), ("3", "theme: foo")]
    assert rows(s.read("ownership"), "item_id", "label_id") == [("1", "L1"), ("2", "L2"), ("3", "L1")]
    assert dict(rows(s.read("item_state"), "item_id", "status")) == {"1": "success", "2": "success", "3": "success"}
    assert rows(s.read("attempts"), "item_id", "status", "match_status") == [("1", "success", "UNIQUE"), ("2", "success", "NO_MATCH"), ("3", "success", "UNIQUE"), ("4", "transient", "UNAVAILABLE")]
    assert rows(s.read("runs"), "run_id", "parent_run_id", "status", "totals") == [("run1", None, "completed", None), ("run1-never_processed", "run1", "completed", '{"apply":3,"transient":1}')]
    assert {r.item_id: (r.before_metadata, r.after_metadata) for r in s.read("journal").collect()} == {"1": ({"title": " ", "urls": None}, {"title": "New", "urls": '["v"]'}), "2": (None, None), "3": ({"title": None, "urls": "[]"}, {"title": "New", "urls": '["w"]'})}
    assert rows(s.read("journal"), "item_id", "status") == [("1", "applied"), ("2", "applied"), ("3", "applied")]
    assert rows(s.read("item_metadata"), "item_id", "title", "urls") == [("1", "New", ["v"]), ("2", "T", ["u"]), ("3", "New", ["w"])]
    # the label that the library made and nothing uses any more is gone, with an audit row
    assert rows(s.read("labels"), "name") == [("Curation: No Match",), ("Mine",), ("theme: foo",)] and rows(s.read("label_deletions"), "name", "axis") == [("theme: gone", "theme")]
    again = curate(s, inputs, "run2", "sha2", "fp", [], phases=("never_processed", "stale_rules"))
    assert again["never_processed"].count() == 0 and again["stale_rules"].count() == 3
    assert all(p.where("has_change").count() == 0 for p in again.values()) and s.read("journal").count() == 3


def test_a_label_that_people_attach_again_stays(spark, tmp_path):
    from labelwright.plans.curate import curate

    s, inputs = library(spark, tmp_path)
    s.replace("ownership", spark.createDataFrame([("4", "L5", None, "run0")], s.read("ownership").schema))
    s.replace("item_labels", spark.createDataFrame([("4", "L5", "theme: gone")], s.read("item_labels").schema))
    nothing = inputs.statuses.where("item_id <> '4'").unionByName(spark.createDataFrame([("4", "p", "UNIQUE")], inputs.statuses.schema))
    inputs.statuses, inputs.labels = nothing, s.read("labels")
    curate(s, inputs, "run1", "sha", "fp", [], phases=("never_processed",))
    assert s.read("item_labels").where("item_id = '4'").count() == 0 and s.read("ownership").where("item_id = '4'").count() == 0
    s.replace("item_labels", s.read("item_labels").unionByName(spark.createDataFrame([("4", "L5", "theme: gone")], s.read("item_labels").schema)))
    curate(s, inputs, "run2", "sha2", "fp", [], phases=("stale_rules",))
    assert rows(s.read("item_labels").where("item_id = '4'"), "label_id") == [("L5",)] and s.read("ownership").where("item_id = '4'").count() == 0


def test_an_interrupted_run_is_settled(spark, tmp_path):
    from labelwright.plans.curate import recover
    from labelwright.sources import journal

    s, inputs = library(spark, tmp_path)
    fp = lambda *ids: labels.set_fingerprint(F.lit(list(ids)))
    made = spark.createDataFrame([("1",), ("2",)], "item_id string").select(
        "item_id", F.lit("replace").alias("mode"), *(F.lit(["L5"]).alias(c) for c in ("before_ids", "before_names", "after_ids", "after_names", "owned_after")),
        F.when(F.col("item_id") == "1", fp("L5", "L9")).otherwise(fp("L7")).alias("after_fp"), F.when(F.col("item_id") == "1", fp("L5")).alias("baseline_fp"),
    )
    s.commit({"journal@r": journal.intents(made, "r", F.current_timestamp())})
    out = recover(s, inputs.items, F.current_timestamp())
    assert rows(out, "item_id", "outcome") == [("1", "adopted"), ("2", "reverted")] and rows(s.read("journal"), "item_id", "status") == [("1", "applied"), ("2", "reverted")]
    assert recover(s, inputs.items, F.current_timestamp()) is None


def test_edits_keep_notes_and_are_refused_when_stale(spark, tmp_path):
    make = spark.createDataFrame
    d = dictionary.Dictionary(make([("a", "map", ["n"], ["p"]), ("b", "map", None, None)], "key string, disposition string, notes array<string>, provider array<string>"), make([("a", "theme: x", 1)], "key string, output string, pos long"), make([("theme", "theme: x", 1)], "axis string, name string, pos long"))
    edits = make([("B", "ignore", None, False)], "key string, disposition string, outputs array<string>, remove boolean")
    after = dictionary.edited(d, edits, expected=dictionary.fingerprint(d).first()[0])
    assert rows(after.rules, "key", "disposition", "notes", "provider") == [("a", "map", ["n"], ["p"]), ("b", "ignore", None, None)]
    with pytest.raises(ValueError):
        dictionary.edited(d, edits, expected="another")
    names = make([("theme", "theme: x")], "axis string, name string")
    with pytest.raises(ValueError):
        dictionary.edited(d, edits, names)
    assert quality.new_name_issues(names, d.canonical).count() == 1
    dictionary.export(d, f"file://{tmp_path}/e")
    back = dictionary.read_export(spark, f"file://{tmp_path}/e")
    assert rows(back.rules, "key", "notes") == rows(d.rules, "key", "notes")
    spark.createDataFrame([("rule", '{"key":"z","disposition":"map"}')], "kind string, row string").write.mode("append").json(f"file://{tmp_path}/e/rows")
    with pytest.raises(ValueError):
        dictionary.read_export(spark, f"file://{tmp_path}/e")


def test_total_falls_back(spark):
    make = spark.createDataFrame
    p = make([("s1", 1, "a"), ("s2", 2, "b"), ("s2", 2, "c")], "proposed_run_id string, created_at int, item_id string")
    none = p.where("false")
    assert [reports.total_items(a, b, p).first()[0] for a, b in ((p.limit(1), none), (none, p.limit(1)), (none, none))] == [1, 1, 2]
    assert reports.total_items(none, none, none).first()[0] == 0


def test_patterns_that_do_not_compile(spark):
    assert [n for n, _ in quality.bad_patterns(spark, {"ok": "a+", "bad": "(", "python alone": "(?P<x>a)"})] == ["bad", "python alone"]


def test_open_bounds_and_absent_columns(spark):
    b = spark.createDataFrame([("era", 1, None, 1990, "a"), ("era", 2, 1990, None, "b")], "kind string, pos int, min int, max int, label string")
    assert rows(quality.era_overlaps(b), "check", "location") == [("bucket_overlap", "era/2")]
    out, issues = derive.derived(spark, {"bad": lambda: b.select("nothing"), "good": lambda: b.select(F.col("label").alias("item_id"), F.lit("n").alias("name"))})
    assert rows(out, "item_id", "name") == [("a", "n"), ("b", "n")] and rows(issues, "derivation") == [("bad",)]


def test_queries_run_in_a_session_cut_to_the_folder(spark, tiny, monkeypatch):
    from labelwright.sources import relations

    before = dict(spark.conf.getAll)
    monkeypatch.setattr(relations, "TASK_ROWS", 100)
    out = queries.QUERIES["d3_groups"](spark, tiny)
    conf = out.sparkSession.conf
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet").count()
    assert int(conf.get("spark.sql.shuffle.partitions")) == -(-lines // 100)
    assert conf.get("spark.sql.session.timeZone") == "UTC"
    assert "BroadcastHashJoin" not in out.select("item_id")._jdf.queryExecution().sparkPlan().toString().replace("BroadcastHashJoin [contributor_id", "").replace("BroadcastHashJoin [norm", "")
    assert dict(spark.conf.getAll) == before


def test_desired_needs_one_shuffle_by_item(spark):
    from labelwright.operators import labels

    current = spark.createDataFrame([("1", "Old", True, False), ("1", "KEEP", True, True), ("1", "own", False, False), ("2", "Old", True, False), ("3", "x", True, False), ("9", "no authority", True, False)], "item_id string, name string, managed boolean, protected boolean")
    names = lambda *rows: spark.createDataFrame(list(rows), "item_id string, name string")
    authority = spark.createDataFrame([("1", True, False), ("2", False, False), ("3", False, True), ("4", True, False)], "item_id string, authoritative boolean, additive boolean")
    out = labels.desired(current, names(("1", "OWN"), ("1", "new"), ("2", "new"), ("3", "X"), ("8", "new")), names(("4", "derived")), names(("2", "mark"), ("3", "mark")), authority)
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("1", "KEEP", 4), ("1", "new", 1), ("1", "own", 0), ("2", "Old", 0), ("2", "mark", 3), ("3", "x", 0), ("4", "derived", 2)]
    plan = out._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert plan.count("Exchange hashpartitioning(") == 1


def test_reasons_of_a_page_are_not_put_together_for_all(spark):
    from labelwright.plans import reports

    m = spark.range(50).selectExpr("lpad(id, 2, '0') AS item_id", "'r' AS run_id", "array('a') AS after_names", "array('b') AS before_names")
    why = spark.range(50).selectExpr("lpad(id, 2, '0') AS item_id", "'added' AS reason", "'a' AS name")
    out = reports.run_changes(m, why, "r", 3)
    assert [(r.item_id, r.total, list(r.reasons), r.truncated) for r in out.orderBy("item_id").collect()] == [(f"0{i}", 50, ["added: a"], True) for i in range(3)]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
