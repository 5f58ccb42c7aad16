from __future__ import annotations

import json
from types import SimpleNamespace

from clauseloom.operators import rules as V
from clauseloom.plans import batch
from clauseloom.schemas import DEFINITIONS, seed_rows
from clauseloom.streaming import jobs


def response(*texts):
    items = [{"block_label": "text", "block_content": t, "block_bbox": [0, i * 30, 100, i * 30 + 20]} for i, t in enumerate(texts)]
    return json.dumps({"layoutParsingResults": [{"prunedResult": {"parsing_res_list": items}}]}, ensure_ascii=False)


def answer(**values):
    fields = [{"field_key": k.replace("_", "-"), "field_value": v, "source_text": f"{v}在此处说明", "source_page": 1, "confidence": 0.9} for k, v in values.items()]
    return json.dumps({"fields": fields}, ensure_ascii=False)


def drop(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")


def test_incremental_equals_batch(spark, tmp_path):
    """Files arrive in two rounds; the stored state equals one batch run over everything."""
    ocr, models, work = tmp_path / "ocr", tmp_path / "models", str(tmp_path / "work")
    contracts = spark.createDataFrame([("a", "done"), ("b", "done")], "contract_id STRING, ocr_completed_at STRING")
    defs = spark.createDataFrame(seed_rows(), DEFINITIONS)

    def drain():
        jobs.ingest_blocks(jobs.read_responses(spark, str(ocr)), f"{work}/ocr").awaitTermination()
        stream = jobs.read_responses(spark, str(models), "model")
        jobs.extract_fields(stream, f"{work}/ocr", contracts, defs, f"{work}/fields").awaitTermination()

    drop(ocr, "1.json", {"contract_id": "a", "body": response("甲公司在此处说明", "采购合同")}, {"contract_id": "b", "body": response("旧文字")})
    drop(models, "1.json", {"contract_id": "a", "chunk_no": 0, "raw": answer(party_a_name="甲公司")})
    drain()
    first = jobs.read_extracted(spark, f"{work}/fields", "fields").filter("value IS NOT NULL").collect()
    assert [(r.contract_id, r.field_key, r.bbox is not None) for r in first] == [("a", "party-a-name", True)]

    drop(ocr, "2.json", {"contract_id": "b", "body": response("乙公司在此处说明", "租赁")})
    drop(models, "2.json", {"contract_id": "a", "chunk_no": 1, "raw": answer(party_b_name="丙公司")}, {"contract_id": "b", "chunk_no": 0, "raw": answer(party_b_name="乙公司")})
    drain()

    blocks = jobs.read_blocks(spark, f"{work}/ocr")
    assert sorted(r.text for r in blocks.filter("contract_id = 'b'").collect()) == ["乙公司在此处说明", "租赁"]
    everything = spark.read.schema("contract_id STRING, chunk_no INT, raw STRING, error STRING").json(str(models))
    whole = batch.extract(contracts, blocks, everything, defs)
    cols = ["contract_id", "field_key", "value", "page_no", "bbox", "confidence"]
    stored = jobs.read_extracted(spark, f"{work}/fields", "fields")
    assert sorted(map(str, stored.select(*cols).collect())) == sorted(map(str, whole.fields.select(*cols).collect()))
    found = jobs.read_extracted(spark, f"{work}/fields", "violations").select("contract_id", "rule_key", "field_key", "message")
    expected = V.validate(stored, contracts).select("contract_id", "rule_key", "field_key", "message")
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert spark.streams.active == []


def test_work_folder_follows_the_cluster(tmp_path):
    shared = SimpleNamespace(conf={"spark.checkpoint.dir": f"{tmp_path}/"})
    assert jobs.work_folder(shared, "x").startswith(f"{tmp_path}/x-")
