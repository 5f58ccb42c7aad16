"""Change feeds, deep pages, trigram search and rules of touched fields against the plain way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import catalog as Q
from clauseloom.operators import feed, grams, pages
from clauseloom.operators import rules as V
from clauseloom.plans import catalog_queries as CQ
from clauseloom.plans import extraction_queries as XQ
from clauseloom.plans import rule_queries as RQ

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_feed_of_any_change(make):
    ddl = "k STRING, n INT, v STRING"
    old = make(ddl, ("a", 1, "x"), ("b", 2, None), (None, 3, "y"), ("d", 4, "z"), ("e", None, None))
    new = make(ddl, ("a", 1, "x"), ("b", 2, "now"), (None, 5, "y"), ("f", None, None), ("e", None, None))
    made = feed.changes(old, new, ["k"])
    assert {(r.op, r.k, r.n, r.v) for r in made.collect()} == {
        ("update", "b", 2, "now"), ("update", None, 5, "y"), ("delete", "d", None, None), ("insert", "f", None, None)}
    once = feed.apply_changes(old, made, ["k"])
    assert rows(once) == rows(new) == rows(feed.apply_changes(once, made, ["k"]))
    assert feed.changes(new, new, ["k"]).count() == 0
    with pytest.raises(ValueError):
        feed.changes(old, new.drop("v"), ["k"])


@pytest.mark.parametrize("which", ["refresh", "upsert", "update", "sync"])
def test_feed_gives_the_new_state(spark, which):
    if which == "refresh":
        old, new, keys = RQ._stored(spark, SF).select(*RQ._OUT, "rule_order", "status"), RQ.refresh_violations(spark, SF), RQ._FINDING
    elif which == "upsert":
        old, new, keys = XQ._approved(spark, SF), XQ.upsert_fields(spark, SF), ["contract_id", "field_key"]
    else:
        new = (CQ.update_definitions if which == "update" else CQ.seed_sync)(spark, SF)
        old, keys = CQ._stored_definitions(spark, SF).select(*new.columns), ["field_key"]
    old, new = old.persist(), new.persist()
    made = feed.changes(old, new, keys).persist()
    assert 0 < made.count() < old.count() + new.count()
    once = feed.apply_changes(old, made, keys)
    assert rows(once) == rows(new.select(*once.columns)) == rows(feed.apply_changes(once, made, keys))


def test_pages_read_the_runs_they_lie_in(spark, tmp_path):
    df = spark.range(2503).selectExpr("id", "id % 7 AS g", "concat('t', id) AS t").repartition(5)
    order = [F.desc("g"), F.asc("id")]
    index = pages.paged(df, order, str(tmp_path), run=100)
    assert index.total() == 2503
    for page, size in [(1, 20), (3, 50), (63, 40), (1, 2503), (126, 20), (127, 20), (2, 2502)]:
        want = df.orderBy(*order).offset((page - 1) * size).limit(size).collect()
        got = index.page(page, size)
        assert [(r.id, r.g, r.t) for r in got.orderBy(*order).collect()] == [(r.id, r.g, r.t) for r in want]
        assert {r.total for r in got.collect()} <= {2503}
        if size <= 50:
            assert index.files(page, size).count() <= 2
    assert pages.paged(df.limit(0), order, str(tmp_path / "none")).page(1, 10).count() == 0
    with pytest.raises(ValueError):
        index.page(0, 10)


def test_trigram_search_equals_the_scan(spark, make, tmp_path):
    stored = CQ._stored_definitions(spark, SF)
    odd = stored.limit(1).selectExpr("'odd' AS field_key", "'İx 合同 a_%' AS field_name", "CAST(NULL AS STRING) AS description", *stored.columns[3:6], "true AS is_active", "contract_type")
    stored = stored.unionByName(odd).persist()
    lists = grams.gram_lists(stored, str(tmp_path))
    for query in ["economy", "  ECONOMY ", "e", "Ti", "", "合", "合同", "合同 a", "a_%", "%", "nothing like it", "l", "x 合", "İ"]:
        want = Q.search_definitions(stored, query, page=1, page_size=100)
        assert rows(lists.search(query, page=1, page_size=100)) == rows(want), query
    assert lists.candidates("economy").count() < stored.count() / 2


def test_touched_rules_alone_are_evaluated(make):
    fields = [("a", "party-a-name", 0, "甲", None, 0.9, None), ("a", "end-date", 1, "2024-01-01", None, 0.9, None), ("a", "sign-date", 2, "2025-01-01", None, 0.2, None),
              ("b", "contract-amount", 0, "-5", None, 0.9, None)]
    ddl = "contract_id STRING, field_key STRING, pos INT, value STRING, source_text STRING, confidence DOUBLE, reviewed_value STRING"
    contracts = make("contract_id STRING", ("a",), ("b",), ("c",))
    seen = []

    def watched(fields, contracts):
        seen.append(1)
        return fields.selectExpr("contract_id", "'seen' AS message", "field_key", "pos AS item_order")

    rules = [*V.BUILTIN, V.Rule("own", "warning", check=watched, inputs="field_key = 'memo'")]
    before = V.recompute(make(ddl, *fields), contracts, rules).persist()
    after = make(ddl, fields[0], fields[1], (*fields[2][:-1], "2023-01-01"), (*fields[3][:-1], "7"))
    edits = make("contract_id STRING, field_key STRING", ("a", "sign-date"), ("b", "contract-amount"))
    assert {(r.contract_id, r.rule_key) for r in V.touched_rules(edits, rules).collect()} == {
        ("a", "date_consistency"), ("a", "low_confidence"), ("b", "amount_consistency"), ("b", "financial_consistency"), ("b", "low_confidence")}
    made = V.recompute_touched(before, after, contracts, edits, rules)
    assert rows(made) == rows(V.recompute(after, contracts, rules))
