"""Plans of the extraction queries: what is shuffled and how often an answer is parsed."""

from __future__ import annotations

import json
import re

from clauseloom.operators import extraction as E
from clauseloom.plans import adapters as A
from clauseloom.plans import registry

SF = "/root/testdata/sf0.001"
RAW = "contract_id STRING, chunk_no INT, raw STRING, error STRING"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_definitions_are_not_joined_by_shuffle(spark):
    """Few definitions: by their key or scope all rows would meet in a handful of tasks."""
    assert A.definitions(spark).where("field_key = 'old-field'").collect()[0][1:] == ("旧字段", "停用", "string", False, 32, False, None)
    assert "scope" not in shuffles(registry.queries()["field_sets"](spark, SF))
    assert "scope" not in shuffles(registry.queries()["field_set_overrides"](spark, SF))
    for name in ("type_fields", "reconcile", "reconcile_failed"):
        assert "field_key" not in shuffles(registry.queries()[name](spark, SF))


def test_types_of_answers_are_parsed_once(spark, make):
    df = E.response_types(make(RAW, ("c", 0, '{"contract_type": "lease"}', None), ("c", 1, "none", None)))
    assert len(re.findall("ParseJson|parseJson", plan(df))) == 3
    assert [tuple(r) for r in df.collect()] == [("c", 0, "lease", 0.0)]


def test_fences(make):
    raws = {
        "```json\n{\"a\": 1}": '{"a": 1}', "```[1]": None, "``````{}": "{}", "x ```json [1] ``` y": "[1]",
        "```\njson```{\"b\":2}": '{"b":2}', "````{\"a\":1}```": '{"a":1}', "{x ```{\"a\":1}```": '{"a":1}',
    }
    got = E.recover_json(make(RAW, *[("c", i, r, None) for i, r in enumerate(raws)])).orderBy("chunk_no").collect()
    assert [r.json for r in got] == list(raws.values())


def test_lists_that_hold_other_than_objects(make):
    rows = [
        '{"fields":[5,{"field_key":"a"}]}', '{"fields":[{"field_key":"a"},null]}', '{"fields":["",{"field_key":"a"}],"x":{"value":1}}',
        '{"fields":[[]],"x":{"value":1}}', '{"fields":"none","x":{"value":1}}', '{"fields":[],"x":{"value":[1, {"b":2}]}}',
        '{"fields":{"field_key":"a"},"y":{"value":1.50},"x":{"field_key":null,"value":2},"contract_type":null}', '{"fields":[{"field_key":"a","source_bbox":null,"source_page":null}]}',
        '{"fields":[{"field_key":"a","source_bbox":{"x":1}}]}', '{"fields":[{"field_key":"a","source_bbox":[1,"2",true]}]}', '{"fields":null,"x":{"value":1}}',
        '{"fields":[{"field_key":"a","value":1},{"field_key":"b","field_value":null,"value":3}],"contract_type":7}',
    ]
    got = E.explode_fields(make(RAW, *[("c", i, r, None) for i, r in enumerate(rows)])).orderBy("chunk_no", "pos").collect()
    assert [(r.chunk_no, r.field_key, r.value, r.source_bbox) for r in got] == [
        (4, "x", "1", None), (5, "x", '[1,{"b":2}]', None),
        (7, "a", None, None), (9, "a", None, [1, 2, 1]), (10, "x", "1", None),
    ]


def test_keys_of_a_map_are_not_looked_up_one_by_one(spark, make):
    """The map of an answer's members is built once, not for each of its keys."""
    raw = json.dumps({f"k{i}": {"value": i} for i in range(300)})
    out = E.explode_fields(make(RAW, ("c", 0, raw, None)))
    assert [r.field_key for r in out.orderBy("pos").collect()] == [f"k{i}" for i in range(300)]
    assert "element_at(try_variant_get" not in plan(out)


def test_traced_texts_are_shuffled_not_their_bigrams(spark):
    from clauseloom.operators import trace as T

    lines = plan(T.locate_sources(A.traces(spark, SF), A.blocks(spark, SF))).split("\n")
    below = [lines[i + 1] for i, line in enumerate(lines) if "RepartitionByExpression" in line]
    assert len(below) == 2 and not any("grams" in line for line in below)


def test_requested_keys_are_not_broadcast(spark):
    """The definitions are the small side; the keys of all contracts would go through the driver."""
    for name in ("extraction_diagnostics", "reconcile", "field_sets"):
        assert "BuildLeft" not in registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_kept_fields_are_not_parsed_again_for_tracing(spark):
    """Tracing read the answers several times over, each time from their text."""
    from clauseloom.plans import batch
    from clauseloom.plans import extraction_queries as X

    contracts, responses, sets = X.line_answers(spark, SF)
    out = batch.extract(contracts, A.blocks(spark, SF), responses, A.definitions(spark), sets)

    def leaves():
        found = out.fields.select("contract_id", "bbox")._jdf.queryExecution().withCachedData().collectLeaves()
        return [found.apply(i).nodeName() for i in range(found.size())]

    before = leaves()
    matched = out.matched.persist()
    try:
        after = leaves()
        kept = after.count("InMemoryRelation")
        # what is left are the blocks; every reading of the matched fields is one of the kept rows
        assert kept > 1 and len(after) - kept < len(before) / 2
    finally:
        matched.unpersist()
