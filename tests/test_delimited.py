"""Records of delimited text against Python's own reader, with files cut into parts anywhere."""

from __future__ import annotations

import csv
import io
import random

import pytest

from clauseloom.sources import definitions as D
from clauseloom.sources import delimited as L


@pytest.fixture(params=["17b", "64b", "128m"])
def cuts(spark, request):
    """The size of the parts that a file is read in."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    for name in names:
        spark.conf.set(name, request.param)
    yield request.param
    for name in names:
        spark.conf.unset(name)


def test_records_with_line_ends_in_quotes(spark, tmp_path, monkeypatch, cuts):
    monkeypatch.setattr(L, "RUN", 3)
    rng = random.Random(5)
    bits = ["a", "字段", '"', ",", "\n", " ", "'", "\n\n", "x"]
    rows = [["".join(rng.choice(bits) for _ in range(rng.randrange(6))) for _ in range(3)] for _ in range(60)]
    rows = [r for r in rows if any(r)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n", quoting=csv.QUOTE_ALL).writerows(rows)
    path = tmp_path / "in.csv"
    path.write_text(out.getvalue(), encoding="utf-8", newline="")
    found = L.records(spark, str(path)).orderBy("record").collect()
    assert [r.record for r in found] == list(range(len(found)))
    assert [next(csv.reader(io.StringIO(r.text, newline=""), strict=True)) for r in found] == rows
    if cuts != "128m":
        assert L.records(spark, str(path)).select("file").rdd.getNumPartitions() >= 1


def test_definitions_across_parts(spark, tmp_path, cuts):
    names = [f"字段{i}" + ("\n第二行" if i % 5 == 0 else "") + ('"引"' if i % 7 == 0 else "") for i in range(80)]
    body = "字段名称,字段描述,值类型\n" + "\n".join('"' + n.replace('"', '""') + f'",说明{i},' for i, n in enumerate(names)) + "\n\n"
    (tmp_path / "d.csv").write_text(body, encoding="utf-8", newline="")
    got = D.read_field_definitions(spark, str(tmp_path / "d.csv")).collect()
    assert sorted(r.field_name for r in got) == sorted(names)
    assert {r.value_type for r in got} == {"string"} and {r.description for r in got} == {f"说明{i}" for i in range(80)}


def test_empty_file_and_open_quote(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert L.records(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "o.csv").write_text('a,"b\nc\n\nd')
    assert [r.text for r in L.records(spark, str(tmp_path / "o.csv")).collect()] == ['a,"b\nc\n\nd']
