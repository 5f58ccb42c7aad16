from __future__ import annotations

import json
import random

import pytest

from clauseloom.operators import extraction as E
from clauseloom.plans import batch
from clauseloom.schemas import BLOCKS, DEFINITIONS, seed_rows

RAW = "contract_id STRING, chunk_no INT, raw STRING, error STRING"


@pytest.fixture
def answers(make):
    return lambda *raws: make(RAW, *[("c", i, r, None) for i, r in enumerate(raws)])


def test_recover_json(answers):
    raws = [
        ' {"a": 1} ', '```json\n{"a": 2}\n```', "前言\n```\n{\"a\": 3}\n```尾", 'text {"a": {"b": 4}} tail', "no json", "", "{broken", '{"a": } x {"b": 5}',
    ]
    got = [r.json for r in E.recover_json(answers(*raws)).orderBy("chunk_no").collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": 3}', '{"a": {"b": 4}}', None, None, None, None]


def fields(df):
    return [(r.chunk_no, r.pos, r.field_key, r.value, r.confidence) for r in E.explode_fields(df).orderBy("chunk_no", "pos").collect()]


def test_field_shapes(answers):
    listed = {"fields": [{"field_key": "z", "field_value": "甲", "confidence": 0.5}, {"field_key": "a", "value": 1.50}], "contract_type": "lease"}
    mapped = {"party-b": {"value": True}, "party-a": {"source_text": "s"}, "contract_type": "service", "note": {"x": 1}, "n": 3}
    both = {"fields": [{"field_key": "k", "field_value": None, "value": "ignored"}]}
    own_key = {"fields": [], "x": {"field_key": "named", "field_value": [1, 2]}}
    got = fields(answers(*[json.dumps(d, ensure_ascii=False) for d in (listed, mapped, both, own_key)]))
    assert got == [
        (0, 0, "z", "甲", 0.5), (0, 1, "a", "1.5", 0.8), (1, 0, "party-b", "True", 0.8), (1, 1, "party-a", None, 0.8),
        (2, 0, "k", None, 0.8), (3, 0, "named", "[1,2]", 0.8),
    ]


def test_broken_fields_reject_the_answer(answers):
    raws = [
        '{"fields":[{"field_value":"x"},{"field_key":"a","value":"1"}]}', '{"fields":[{"field_key":5,"value":"x"}]}',
        '{"fields":[{"field_key":"a","confidence":"high"}]}', '{"fields":"none"}', "[1]", '{"fields":[{"field_key":"ok"}]}',
    ]
    assert fields(answers(*raws)) == [(5, 0, "ok", None, 0.8)]


def test_typing(answers, make):
    raw = E.explode_fields(answers(
        '{"fields":[{"field_key":"a","field_value":"v","source_bbox":[1,2,3,4],"source_page":2},{"field_key":"b","field_name":"自带","source_bbox":[1]},{"field_key":"zzz"}]}'
    ))
    defs = make(DEFINITIONS, ("a", "名A", "", "money", False, 1, True, None), ("b", "名B", "", "string", False, 2, True, None))
    rows = {r.field_key: r for r in E.type_fields(raw, defs).collect()}
    assert (rows["a"].field_name, rows["a"].value_type, tuple(rows["a"].bbox), rows["a"].page_no) == ("名A", "money", (1, 2, 3, 4), 2)
    assert (rows["b"].field_name, rows["b"].bbox, rows["b"].value) == ("自带", None, None)
    assert [r.field_key for r in E.unrequested(raw, defs).collect()] == ["zzz"]


CHUNK = "contract_id STRING, field_key STRING, chunk_no INT, pos INT, value STRING, confidence DOUBLE, page_no INT"


def test_arbitration_against_pairwise_choice(make):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        for n in range(rng.randrange(1, 7)):
            rows.append((f"k{k}", "f", n, 0, rng.choice([None, "", " ", "x", "y"]), rng.choice([0.5, 0.9]), rng.choice([None, 1, 2])))

    def better(new, old):
        filled = [bool(x[4] and x[4].strip()) for x in (new, old)]
        if filled[0] != filled[1]:
            return filled[0]
        if not filled[0]:
            return False
        page = lambda x: 10**9 if x[6] is None else x[6]
        return (-new[5], page(new)) < (-old[5], page(old))

    best: dict = {}
    for row in rows:
        if row[0] not in best or better(row, best[row[0]]):
            best[row[0]] = row
    rng.shuffle(rows)
    got = {r.contract_id: r.chunk_no for r in E.merge_fields(make(CHUNK, *rows)).collect()}
    assert got == {k: v[2] for k, v in best.items()}


def test_contract_type_of_chunks(make):
    ddl = "contract_id STRING, chunk_no INT, contract_type STRING, contract_type_confidence DOUBLE"
    types = make(ddl, ("c", 0, "unknown", 0.9), ("c", 1, "service", 0.4), ("c", 2, "lease", 0.9), ("d", 0, None, 0.5), ("d", 1, "", 0.5))
    assert {tuple(r) for r in E.merge_contract_type(types).collect()} == {("c", "service", 0.4), ("d", None, 0.0)}


RETURNED = (
    "contract_id STRING, field_key STRING, pos INT, field_name STRING, value STRING, value_type STRING, source_text STRING, "
    "page_no INT, bbox STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>, confidence DOUBLE"
)


def test_reconcile(make):
    asked = make(
        "contract_id STRING, field_key STRING, field_name STRING, value_type STRING, sort_order INT",
        *[(c, k, f"名{k}", "string", i) for c in ("c", "d") for i, k in enumerate(("a", "b"))],
    )
    back = make(
        RETURNED, ("c", "a", 0, None, "old", None, None, 1, None, 0.9), ("c", "a", 1, None, "new", None, None, 1, None, 0.3),
        ("c", "odd", 2, None, "x", None, None, 1, None, 0.9), ("d", "odd", 0, None, "x", None, None, 1, None, 0.9),
    )
    got, failed = E.reconcile(back, asked)
    assert sorted((r.contract_id, r.field_key, r.field_name, r.value, r.confidence, r.missing) for r in got.collect()) == [
        ("c", "a", "名a", "new", 0.3, False), ("c", "b", "名b", None, 0.0, True),
    ]
    assert [r.contract_id for r in failed.collect()] == ["d"]
    diag = E.extraction_diagnostics(got, back, asked).first()
    assert (diag.returned_keys, diag.non_null_keys, diag.null_keys, diag.missing_keys, diag.unknown_keys) == ("a", "a", "b", "b", "odd")


def test_reconcile_merges_the_answers_once(make):
    """Counting a contract's hits read and merged all answers a second time, and failed contracts gathered their values."""
    asked = make("contract_id STRING, field_key STRING, field_name STRING, value_type STRING, sort_order INT", ("c", "a", "A", "string", 0), ("d", "a", "A", "string", 0))
    got, failed = E.reconcile(make(RETURNED, ("c", "a", 0, None, "x", None, None, 1, None, 0.9)), asked)
    merges = [df._jdf.queryExecution().optimizedPlan().toString().count("max_by(") for df in (got, failed)]
    assert merges == [1, 0]
    assert [r.contract_id for r in got.collect()] == ["c"] and [r.contract_id for r in failed.collect()] == ["d"]


def test_field_sets(make):
    defs = make(
        DEFINITIONS, ("common-1", "x", "", "string", False, 1, True, None), ("lease-1", "x", "", "string", False, 2, True, "lease"),
        ("service-1", "x", "", "string", False, 3, True, "service"), ("off", "x", "", "string", False, 4, False, None),
    )
    contracts = make("contract_id STRING, contract_type STRING", ("l", "lease"), ("u", "unknown"), ("n", None), ("o", "other"), ("own", "lease"))
    sets = E.fields_for_type(contracts, defs)
    own = make("contract_id STRING, field_key STRING, field_name STRING, description STRING, value_type STRING, sort_order INT", ("own", "mine", "x", "", "string", 1))
    got: dict = {}
    for r in E.effective_field_set(sets, own).orderBy("sort_order").collect():
        got.setdefault(r.contract_id, []).append(r.field_key)
    everything = ["common-1", "lease-1", "service-1"]
    assert got == {"l": ["common-1", "lease-1"], "u": everything, "n": everything, "o": ["common-1"], "own": ["mine"]}


def test_type_authority(make):
    c = make("contract_id STRING, contract_type STRING, confidence DOUBLE", ("a", "service", 0.8), ("b", "unknown", 0.1), ("d", None, None))
    i = make("contract_id STRING, contract_type STRING, contract_type_confidence DOUBLE", ("a", "lease", 0.9), ("b", "lease", 0.7))
    assert {tuple(r) for r in E.resolve_type(c, i).collect()} == {("a", "service", 0.8), ("b", "lease", 0.7), ("d", None, None)}


def test_whole_batch(make, spark):
    """Responses to findings: classification, field set, tracing and rules in one plan."""
    blocks = make(
        BLOCKS, ("1", "c", 1, "text", "甲方：北京某某公司", 0.9, (0.0, 0.0, 10.0, 10.0), 1, None, None, 100, 200),
        ("2", "c", 1, "text", "租赁标的物说明", 0.9, (0.0, 20.0, 10.0, 30.0), 2, None, None, 100, 200),
    )
    contracts = make("contract_id STRING, ocr_completed_at STRING", ("c", "done"), ("waiting", None), ("bad", "done"))
    blocks = blocks.unionByName(blocks.limit(1).selectExpr(*[f"'bad' AS {c}" if c == "contract_id" else c for c in blocks.columns]))
    raw = json.dumps({"fields": [{"field_key": "party-a-name", "field_value": "北京某某公司", "source_text": "甲方：北京某某公司", "source_page": 1, "confidence": 0.6}]})
    responses = make(RAW, ("c", 0, raw, None), ("bad", 0, "nothing", None))
    defs = spark.createDataFrame(seed_rows(), DEFINITIONS)
    out = batch.extract(contracts, blocks, responses, defs)
    rows = {r.field_key: r for r in out.fields.collect()}
    assert len(rows) == 23 and tuple(rows["party-a-name"].bbox) == (0, 0, 10, 10) and rows["end-date"].value is None
    assert [r.contract_id for r in out.failed.collect()] == ["bad"]
    assert {r.contract_id: r.contract_type for r in out.types.collect()}["c"] == "lease"
    keys = [(r.contract_id, r.rule_key, r.field_key) for r in out.violations.collect() if r.rule_key == "required_fields"]
    assert keys == [("c", "required_fields", "party-b-name")]


def test_one_set_of_rules_for_all_answers(answers):
    """The same field reads alike whatever its siblings look like."""
    field = {"field_key": "k", "value": "v", "source_page": "3", "source_bbox": ["1", "2", 3, 4.5], "confidence": "0.5"}
    boolean = {"field_key": "b", "field_value": True, "source_page": 3.0, "field_name": None}
    docs = [{"fields": [field]}, {"fields": [field, boolean]}]
    got = E.explode_fields(answers(*[json.dumps(d) for d in docs])).filter("field_key = 'k'").collect()
    assert [(r.source_page, r.source_bbox, r.confidence) for r in got] == [(3, [1.0, 2.0, 3.0, 4.5], 0.5)] * 2
    assert [r.source_page for r in E.explode_fields(answers(json.dumps(docs[1]))).collect()] == [3, 3]


@pytest.mark.parametrize("broken", [
    {"source_page": 3.5}, {"source_page": "x"}, {"source_page": [1]}, {"source_bbox": [1, "x"]}, {"source_bbox": 5}, {"source_bbox": [1, None]},
    {"field_name": 5}, {"source_text": 12}, {"confidence": None}, {"confidence": {}}, {"field_key": True},
])
def test_members_of_other_types_reject_the_answer(answers, broken):
    good = {"field_key": "a", "value": "x", "source_page": None, "source_bbox": None, "source_text": None}
    raws = [json.dumps({"fields": [good, {**good, **broken}]}), json.dumps({"fields": [good, good]})]
    assert {r.chunk_no for r in E.explode_fields(answers(*raws)).collect()} == {1}


def test_types_of_the_answer_itself(answers):
    raws = ['{"fields":[{"field_key":"a"}],"contract_type":5}', '{"fields":[{"field_key":"a"}],"contract_type_confidence":null}',
            '{"fields":[{"field_key":"a"}],"contract_type":null,"contract_type_confidence":"0.5"}', '{"fields":[{"field_key":"a"}, 7]}']
    assert [r.chunk_no for r in E.explode_fields(answers(*raws)).collect()] == [2]
