"""The pipeline: its stages on odd rows and the whole of it against the stages' rules."""

from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from clauseloom.llm import near_dedup
from tests.llm.conftest import ODD, SF
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_packing import check as check_packing
from tests.llm.test_passage_dedup import brute as brute_passages


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), "extra", 1, 2, 3) for i, t in ODD]
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, _id int, _tk int, _gone int"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("name, stage", pipeline.STAGES[:-1])
def test_odd_rows(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text)
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_near_copies_keep_one(spark, odd):
    kept = pipeline.keep_one_of_near_copies(spark, odd, SF)
    want = sorted({(i, t) for i, t in ODD if i != 10}, key=str)
    assert rows_of(kept) == want  # 9 and 10 differ in case alone; the repeated row of 4 stays once
    assert near_dedup.near_duplicates(kept).where("not kept").count() == 0


def test_unknown_languages_go(spark, odd):
    kept = pipeline.keep_known_language(spark, odd, SF)
    assert {r.doc_id for r in kept.collect()} == {None, 4, 5, 6, 7, 8, 9, 10}
    no_lang = odd.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars", "score")
    assert {r.doc_id for r in pipeline.keep_known_language(spark, no_lang, SF).collect()} == {None, 4, 5, 6, 7, 8, 9, 10}


def test_whole_run(spark, sf_docs):
    got = pipeline.run(spark, SF).collect()
    rows = list(zip(sf_docs.doc_id, sf_docs.text))  # every text of this table is in a language of its own label
    rows = [(i, t) for i, _, _, t in brute_lines(rows, 10)]
    keep = {i for i, _, c in brute_near(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in keep]
    rows = [(i, kept.decode("utf-8", "ignore")) for i, *_, kept in brute_passages(rows, 400)]
    used, least = check_packing(rows, got, 2048)
    assert used <= 1.03 * least + 1
