"""Refusals, repeated keys, NULL keys and text keys."""

from __future__ import annotations

import pytest

from clauseloom.operators import catalog as C
from clauseloom.operators.ordered import number_rows
from clauseloom.schemas import DEFINITIONS, seed_rows
from clauseloom.sources import exports as X
from clauseloom.sources.files import validate_batch
from clauseloom.streaming.jobs import newest_responses


@pytest.mark.parametrize("page, size", [(1, 101), (1, 0), (0, 20)])
def test_pages_out_of_range_are_refused(spark, page, size):
    defs = spark.createDataFrame(seed_rows(), DEFINITIONS)
    with pytest.raises(ValueError):
        C.search_definitions(defs, "金额", page, size)
    with pytest.raises(ValueError):
        C.list_contracts(defs, defs, page=page, page_size=size)


def test_key_repeated_in_new_rows_is_refused(spark):
    old = spark.createDataFrame(seed_rows()[:1], DEFINITIONS)
    row = lambda key, name, at: (key, name, "", "string", False, at, True, None)
    new = spark.createDataFrame([row("n", "second", 2), row("n", "first", 1), row(seed_rows()[0][0], "taken", 3)], DEFINITIONS)
    added, refused = C.add_definitions(old, new)
    assert [r.field_name for r in added.filter("field_key = 'n'").collect()] == ["first"]
    assert sorted(r.field_name for r in refused.collect()) == ["second", "taken"] and added.count() == 2


def test_two_patches_of_a_key_make_one_row(spark, make):
    defs = spark.createDataFrame(seed_rows()[:2], DEFINITIONS)
    key = seed_rows()[0][0]
    patches = make(
        "field_key STRING, set_cols ARRAY<STRING>, field_name STRING, description STRING, patched_at INT",
        (key, ["field_name"], "one", None, 1), (key, ["field_name", "description"], "two", None, 2), (key, ["description"], None, "late", 3),
    )
    rows = C.update_definitions(defs, patches).filter(f"field_key = '{key}'").collect()
    assert [(r.field_name, r.description) for r in rows] == [("two", "late")]


def test_files_without_a_batch_stay(make):
    files = make("batch_id INT, file_name STRING, file_size LONG", (1, "a.pdf", 5), (None, "b.pdf", 5), (None, "c.txt", 5))
    got = {r.file_name: (r.n_files, r.reason) for r in validate_batch(files).collect()}
    assert got == {"a.pdf": (1, None), "b.pdf": (2, None), "c.txt": (2, "unsupported_type")}


def test_null_keys_are_numbered(make):
    rows = make("k STRING, v INT", (None, 3), (None, 700), ("a", 1), (None, None))
    got = {(r.k, r.v): r.n for r in number_rows(rows, ["k"], "floor(v / 256)", "v", "n").collect()}
    assert got == {(None, None): 1, (None, 3): 2, (None, 700): 3, ("a", 1): 1}


def test_exports_take_text_keys_and_repeated_fields(make):
    fields = make(
        "contract_id STRING, field_key STRING, value STRING, reviewed_value STRING, confidence DOUBLE, page_no INT, review_status STRING, pos INT",
        ("x-1", "k", "zz", None, 0.5, 1, "extracted", 1), ("x-1", "k", "aa", None, 0.6, 2, "extracted", 2),
    )
    batch = make("contract_id STRING, file_name STRING, status STRING, error STRING", ("x-2", "b", "completed", None), ("x-1", "a", "completed", None))
    wide = X.wide_results(fields, batch, ["k"]).orderBy("序号").collect()
    assert [(r["序号"], r["文件名"], r["k"]) for r in wide] == [(1, "a", "aa"), (2, "b", "")]
    nested = X.json_rows(fields, batch, ["k", "k"]).orderBy("index").collect()
    assert nested[0].fields["k"].value == "aa" and nested[1].fields == {"k": None}


def test_newest_response_of_a_page_counts(make):
    rows = make("contract_id STRING, page_no INT, provider STRING, body STRING, file_modification_time INT",
                ("a", None, "p", "old", 1), ("a", None, "p", "new", 2), ("a", 1, "p", "other page", 1))
    assert sorted(r.body for r in newest_responses(rows).collect()) == ["new", "other page"]
