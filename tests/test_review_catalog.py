from __future__ import annotations

import datetime as dt

import pytest

from clauseloom.operators import catalog as Q
from clauseloom.operators import evaluation as M
from clauseloom.operators import review as R
from clauseloom.schemas import DEFINITIONS, seed_patches

FIELDS = "contract_id STRING, field_key STRING, value STRING, review_status STRING, reviewed_value STRING, reviewer_id STRING, reviewed_at TIMESTAMP"
EVENTS = "event_id INT, contract_id STRING, field_key STRING, action STRING, new_value STRING, reviewer_id STRING, created_at TIMESTAMP"


def at(n):
    return dt.datetime(2024, 1, 1, 0, n)


@pytest.fixture
def fields(make):
    return make(FIELDS, *[("c", k, f"v-{k}", "extracted", None, None, None) for k in "abcd"])


@pytest.fixture
def events(make):
    return make(
        EVENTS, (1, "c", "a", "modify", "n1", "u", at(1)), (2, "c", "a", "approve", None, "w", at(2)), (3, "c", "b", "modify", "", "u", at(1)),
        (4, "c", "c", "modify", None, "u", at(1)), (5, "c", "zz", "reject", None, "u", at(1)), (6, "c", "a", "modify", "n0", "u", at(0)),
    )


def state(df):
    return {r.field_key: (r.value, r.review_status, r.reviewed_value, r.reviewer_id) for r in df.collect()}


def test_field_and_batch_reviews(fields, events):
    assert state(R.apply_field_reviews(fields, events)) == {
        "a": ("v-a", "approved", "n1", "w"), "b": ("v-b", "corrected", "", "u"), "c": ("v-c", "modify", None, "u"), "d": ("v-d", "extracted", None, None),
    }
    assert state(R.apply_batch_reviews(fields, events))["b"] == ("v-b", "modify", None, "u")
    audit = R.field_audit(fields, events)
    assert sorted((r.event_id, r.old_value) for r in audit.collect()) == [(1, "v-a"), (2, "v-a"), (3, "v-b"), (4, "v-c"), (6, "v-a")]
    assert R.batch_audit(events).count() == 6


def test_corrections(fields, make):
    requests = make(
        "event_id INT, contract_id STRING, action STRING, comment STRING, reviewer_id STRING, created_at TIMESTAMP, "
        "corrections ARRAY<STRUCT<field_key: STRING, corrected_value: STRING, comment: STRING>>",
        (1, "c", "corrected", None, "u", at(1), [("a", "x", None), ("b", "y", "why")]),
        (2, "c", "corrected", None, "u", at(2), [("a", "late", None), ("nope", "y", None)]),
        (3, "c", "approved", None, "u", at(3), []), (4, "c", "rejected", None, "u", at(4), []), (5, "c", "rejected", "note", "u", at(5), None),
    )
    out, audit, refused = R.apply_corrections(fields, requests)
    assert state(out)["a"] == ("v-a", "corrected", "x", "u") and state(out)["b"][2] == "y"
    assert sorted((r.event_id, r.target_type, r.action) for r in audit.collect()) == [
        (1, "field", "modify"), (1, "field", "modify"), (3, "contract", "approved"), (5, "contract", "rejected"),
    ]
    assert [r.event_id for r in refused.collect()] == [2]


def test_clause_reviews(make):
    clauses = make("contract_id STRING, sort_order INT, review_status STRING", *[("c", i, "pending") for i in range(4)])
    events = make(
        "event_id INT, contract_id STRING, sort_order INT, action STRING, created_at TIMESTAMP",
        (1, "c", 0, "approve", at(1)), (2, "c", 1, "approved", at(1)), (3, "c", 2, "approved", at(1)), (4, "c", 2, "rejected", at(2)),
    )
    got = {r.sort_order: r.review_status for r in R.apply_clause_reviews(clauses, events).collect()}
    assert got == {0: "reviewed", 1: "approved", 2: "rejected", 3: "pending"}


def test_contract_decisions(make):
    contracts = make("contract_id STRING, status STRING", ("a", "reviewing"), ("b", "reviewing"))
    fields = make("contract_id STRING, field_key STRING, review_status STRING", ("a", "x", "pending"), ("a", "y", "extracted"), ("b", "x", "pending"))
    chosen = make("event_id INT, contract_id STRING, reviewer_id STRING, created_at TIMESTAMP", (1, "a", "u", at(1)))
    done, out = R.approve_contracts(contracts, fields, chosen)
    assert {tuple(r) for r in done.collect()} == {("a", "approved"), ("b", "reviewing")}
    assert {(r.contract_id, r.field_key): r.review_status for r in out.collect()} == {("a", "x"): "approved", ("a", "y"): "extracted", ("b", "x"): "pending"}
    assert {tuple(r) for r in R.reject_contracts(contracts, chosen).collect()} == {("a", "rejected"), ("b", "reviewing")}


def test_history_pages(fields, events):
    audit = R.field_audit(fields, events)
    got = R.review_history(audit, "c", "field", page=2, page_size=2).collect()
    assert [(r.event_id, r.total) for r in got] == [(3, 5), (1, 5)]
    with pytest.raises(ValueError):
        R.review_history(audit, "c", page_size=201)


def test_accuracy(make):
    golden = make("contract_id STRING, field_key STRING, expected STRING", ("c", "a", "1"), ("c", "b", "2"), ("c", "c", "3"), ("c", "d", " "), ("c", "e", None))
    found = make("contract_id STRING, field_key STRING, value STRING", ("c", "a", " 1 "), ("c", "b", "x"), ("c", "d", "q"))
    verdicts = M.field_verdicts(found, golden)
    assert {r.field_key: r.verdict for r in verdicts.collect()} == {"a": "tp", "b": "fp", "c": "fn"}
    assert tuple(M.accuracy(verdicts).first()) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(M.accuracy(verdicts.filter("verdict = 'fn'")).first()) == (0, 0, 1, 0.0, 0.0, 0.0)
    assert tuple(M.accuracy(verdicts.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def definitions(make, *rows):
    return make(DEFINITIONS, *rows)


def test_seed_sync_and_reset(make, spark):
    seeds = spark.createDataFrame(seed_patches(), DEFINITIONS)
    defs = definitions(
        make, ("party-a-name", "改名", "", "text", False, 99, True, "lease"), ("sign-date", "旧", "", "date", True, 98, False, "sale"),
        ("mine", "自有", "", "string", False, 1, True, None),
    )
    synced = {r.field_key: r for r in Q.sync_definitions(defs, seeds).collect()}
    assert len(synced) == 24 and synced["party-a-name"].field_name == "改名" and synced["mine"].is_active
    revived = synced["sign-date"]
    assert (revived.field_name, revived.value_type, revived.required, revived.is_active, revived.contract_type) == ("签署日期", "string", True, True, "sale")
    assert (synced["party-b-bank"].value_type, synced["party-b-bank"].required) == ("string", False)
    reset = {r.field_key: r for r in Q.reset_definitions(defs, seeds).collect()}
    assert not reset["mine"].is_active and (reset["party-a-name"].field_name, reset["party-a-name"].value_type) == ("甲方名称", "text")


def test_definition_upkeep(make):
    defs = definitions(make, ("a", "Alpha", "first", "string", True, 2, True, None), ("b", "beta", None, "string", False, 1, True, None), ("z", "zeta alpha", "", "string", False, 3, False, None))
    kept, refused = Q.add_definitions(defs, definitions(make, ("z", "n", "", "string", False, 1, True, None), ("n", "n", "", "string", False, 1, True, None)))
    assert sorted(r.field_key for r in kept.collect()) == ["a", "b", "n", "z"] and refused.first().field_key == "z"
    patch = make("field_key STRING, field_name STRING, description STRING, set_cols ARRAY<STRING>", ("a", "new", None, ["description"]))
    got = {r.field_key: (r.field_name, r.description) for r in Q.update_definitions(defs, patch).collect()}
    assert got["a"] == ("Alpha", None) and got["b"] == ("beta", None)
    assert [r.field_key for r in Q.active_definitions(defs).collect()] == ["b", "a"]
    assert [(r.field_key, r.total, r.required_total) for r in Q.search_definitions(defs, " ALPHA ").collect()] == [("a", 1, 1)]
    off = Q.deactivate_definitions(defs, defs.filter("field_key = 'a'"))
    assert {r.field_key: r.is_active for r in off.collect()} == {"a": False, "b": True, "z": False}


def test_tasks(make):
    ddl = "id INT, contract_id STRING, status STRING, attempts INT, max_attempts INT, priority INT, queued_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, lease_expires_at TIMESTAMP_NTZ, next_run_at TIMESTAMP_NTZ"
    tasks = make(
        ddl, (1, "c", "running", 2, 3, 0, at(0), at(0), at(1), None), (2, "c", "running", 3, 3, 0, at(0), at(0), at(1), None),
        (3, "c", "running", 0, 3, 0, at(0), at(0), at(30), None), (4, "c", "pending", 0, 3, 5, at(3), at(0), None, None),
        (5, "c", "retrying", 0, 3, 5, at(2), at(0), None, at(9)), (6, "c", "pending", 0, 3, 9, at(2), at(0), None, at(50)), (7, "c", "running", 9, 20, 0, at(0), at(0), at(1), None),
    )
    got = {r.id: (r.new_status, r.new_stage, r.next_run_at) for r in Q.expired_tasks(tasks, "2024-01-01 00:10:00").collect()}
    assert got == {
        1: ("retrying", "queued", dt.datetime(2024, 1, 1, 0, 10, 4)), 2: ("timed_out", "timed_out", None),
        7: ("retrying", "queued", dt.datetime(2024, 1, 1, 0, 11, 0)),
    }
    assert [r.id for r in Q.due_tasks(tasks, "2024-01-01 00:10:00", 5).collect()] == [5, 4]


def test_task_events(make):
    events = make(
        "event_id INT, task_id INT, event STRING, created_at TIMESTAMP",
        (1, 1, "ocr", at(1)), (2, 1, "ocr_failed", at(2)), (3, 2, "extracting", at(1)), (4, 2, "completed", at(4)), (5, 3, "weird-failed", at(1)),
    )
    got = {r.task_id: (r.status, r.stage, r.started_at, r.completed_at) for r in Q.fold_task_events(events).collect()}
    assert got == {1: ("failed", "ocr", at(1), at(2)), 2: ("completed", "completed", at(1), at(4)), 3: ("running", "weird-failed", at(1), None)}
