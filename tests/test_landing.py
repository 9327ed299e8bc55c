"""Landed JSON and the refresh of all reports."""

import json

import pytest
from pyspark.sql import functions as F

from labelwright.operators import dictionary, providers
from labelwright.plans import refresh, reports, run_queries
from labelwright.plans.queries import ORACLE_SQL, QUERIES
from labelwright.sources import landing
from labelwright.sources.tables import Patch, Store
from tests.oracle import differences

#: A query of each group; all of them are compared by tests/oracle.py.
SOME = ("s1_item_scan", "p9_candidate_metadata", "a4_landed", "k6_layered_ledger", "k14_purge", "x1_same_inputs", "x3_reconcile_metadata", "x7_edit_batch", "x10_refresh", "o8_ordered_labels")


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, tiny, name):
    assert differences(spark, tiny, QUERIES[name], ORACLE_SQL[name]) == ""


def land(spark, path, lines):
    (path / "a.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return f"file://{path}"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_items_and_quarantine(spark, tmp_path):
    whole = {
        "id": "1", "title": "T", "date": "2020-01-02", "urls": ["u", None, "v"], "files": [{"path": "p", "fingerprints": [{"type": "md5", "value": "x"}, {"type": "oshash", "value": ""}]}, {"path": "q", "fingerprints": None}],
        "labels": [{"id": "L2", "name": "b"}, {"id": "L1", "name": "a"}], "contributors": [{"id": "c1", "name": "Ann", "metric_a": 3, "labels": [{"id": "L9", "name": "z"}]}, {"id": "c2", "labels": []}],
        "source": {"id": "s", "name": "Src"}, "external_ids": [{"endpoint": "e", "ext_id": "7"}], "unknown": {"x": 1},
    }
    lines = [whole, {"id": "2"}, {"id": "2", "labels": []}, '{"id": "3", "title": "cut', "[]", '{"id": "4", "contributors": [{"metric_a": "no number"}]}', {"title": "nobody"}, {"id": "  "}, "", "7"]
    got = landing.read(spark, land(spark, tmp_path, lines), landing.ITEM)
    assert rows(got.rows, "id") == [("1",), ("2",), ("2",)]
    lost = got.quarantine.collect()
    assert sorted(r.reason for r in lost) == ["malformed"] * (len(lost) - 2) + ["no id"] * 2 and all(r.file.endswith("a.json") for r in lost)
    assert any("cut" in r.line for r in lost) and any("no number" in r.line for r in lost) and any("nobody" in r.line for r in lost)
    t = landing.item_tables(got.rows)
    assert rows(t["items"], "item_id", "title", "source_name") == [("1", "T", "Src"), ("2", None, None), ("2", None, None)]
    assert rows(t["urls"], "pos", "url") == [(1, "u"), (3, "v")]
    assert rows(t["files"], "pos", "path") == [(1, "p"), (2, "q")] and rows(t["fingerprints"], "file_pos", "pos", "value") == [(1, 1, "x"), (1, 2, "")]
    assert rows(t["labels"], "item_id", "pos", "label_id") == [("1", 1, "L2"), ("1", 2, "L1")]
    assert rows(t["contributors"], "pos", "contributor_id", "metric_a") == [(1, "c1", 3), (2, "c2", None)] and rows(t["contributor_labels"], "contributor_pos", "pos", "label_id") == [(1, 1, "L9")]
    assert rows(t["external_ids"], "endpoint", "ext_id") == [("e", "7")]
    people = landing.read(spark, land(spark, tmp_path, [whole["contributors"][0]]), landing.CONTRIBUTOR)
    c = landing.contributor_tables(people.rows)
    assert rows(c["contributors"], "contributor_id", "metric_a") == [("c1", 3)] and rows(c["labels"], "label_id") == [("L9",)]


def test_answers(spark, tmp_path):
    one = {"title": " A ", "code": "", "urls": [" u ", "", None], "remote_id": "r1", "labels": [{"name": " x "}, {"name": " "}, {"name": None}], "contributors": [{"stored_id": "", "name": "P"}, {"name": ""}], "source": {"name": " "}}
    lines = [
        {"item_id": "1", "provider": "p", "candidates": [one]}, {"item_id": "1", "provider": "q", "candidates": [one, one]}, {"item_id": "2", "provider": "p", "candidates": []}, {"item_id": "2", "provider": "q"},
        {"item_id": "3", "provider": "p", "failure": "RATE_LIMITED", "candidates": [one]}, {"item_id": "3"},
    ]
    got = landing.read(spark, land(spark, tmp_path, lines), landing.ANSWER, ("item_id", "provider"))
    assert got.quarantine.count() == 1
    outcomes, candidates = landing.answers(got.rows)
    statuses = providers.classified(candidates, outcomes)
    assert rows(statuses, "item_id", "provider", "status") == [("1", "p", "UNIQUE"), ("1", "q", "AMBIGUOUS"), ("2", "p", "NO_MATCH"), ("2", "q", "NO_MATCH"), ("3", "p", "RATE_LIMITED")]
    unique = providers.of_unique(candidates, statuses)
    assert rows(providers.candidate_labels(unique), "provider_item_id", "raw_label", "pos") == [("r1", "x", 1)]
    (m,) = providers.candidate_metadata(unique).collect()
    assert (m.title, m.code, m.urls, [tuple(p) for p in m.contributors], m.source) == ("A", None, ["u"], [(None, "P", None)], None)


def test_refresh_makes_what_the_single_reports_make(spark, tiny):
    r = run_queries.Relations(spark, tiny)
    counts = refresh.label_counts(r.raw_labels, r.dictionary())
    d = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert d(refresh.dictionary_entries(counts, r.dictionary())) == d(reports.dictionary_report(r.raw_labels, r.dictionary()))
    board = refresh.dashboard(counts, r.items, r.item_state, "cur", "fp")
    assert tuple(board.select("unmapped_labels", "unmapped_items").first()) == tuple(reports.unmapped_totals(r.raw_labels, r.dictionary()).first())
    assert d(counts.where("level = 0 AND miss").select("raw_label", "n_items")) == d(reports.unmapped(r.raw_labels, r.dictionary()))
    # one pass over the raw labels serves three reports
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")
    three = [reports.dictionary_report(r.raw_labels, r.dictionary()), reports.unmapped(r.raw_labels, r.dictionary()), reports.unmapped_totals(r.raw_labels, r.dictionary())]
    assert scans(counts) == 1 and sum(map(scans, three)) == 3


def test_a_report_that_fails_does_not_hold_up_the_others(spark, tmp_path):
    s, make = Store(spark, f"file://{tmp_path}", buckets=2), spark.createDataFrame
    d = dictionary.Dictionary(make([("a", "map")], "key string, disposition string"), make([("a", "theme: x", 1)], "key string, output string, pos long"), make([("theme", "theme: x", 1)], "axis string, name string, pos long"))
    s.commit({
        "raw_current": Patch(make([("1", "p", "A"), ("1", "p", "my password"), ("2", "p", "zz")], "item_id string, provider string, raw_label string"), ("item_id", "provider")), "item_state": make([], "item_id string, status string, last_successful_run_id string, rules_sha string, provider_fp string"),
        "runs": make([("r",)], "run_id string"), "attempts": make([], "run_id string"), "proposals": make([("1", "s", True)], "item_id string, proposed_run_id string, has_change boolean"),
    })
    base = s.version()
    phases = make([("s", 1)], "proposed_run_id string, phase_pos int")
    with pytest.raises(Exception):
        reports.run_history(s.read("runs"), s.read("attempts")).count()
    said = refresh.refresh(s, d, make([("1",), ("2",)], "item_id string"), phases, "sha", "fp")
    assert said == {"dashboard": True, "run_history": False, "unmapped_labels": True, "dictionary": True, "rules_audit": True, "proposal_detail": True} and s.version() == base + 1
    assert rows(s.read("snapshot_unmapped_labels"), "raw_label", "n_items") == [("[REDACTED]", 1), ("zz", 1)]


def test_items_are_not_multiplied_before_they_are_counted(spark, tiny):
    r = run_queries.Relations(spark, tiny)
    plan = refresh.label_counts(r.raw_labels, r.dictionary())._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Expand" in x and "item_id" in x]


def test_landed_lines_are_written_compressed(spark, tiny, tmp_path, monkeypatch):
    from labelwright.plans import run_queries

    monkeypatch.setattr(run_queries, "fresh_path", lambda spark, name: f"file://{tmp_path}/{name}")
    run_queries._answers(spark, tiny)
    files = [p.name for p in (tmp_path / "answers").iterdir() if p.name.startswith("part-")]
    assert files and all(n.endswith(".snappy") for n in files)
