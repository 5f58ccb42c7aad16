"""Levelled runs behind a manifest against a plain dictionary."""

from __future__ import annotations

import os
import random

import pytest

from clauseloom.sources import store as S

ROWS = "contract_id STRING, n INT, text STRING"


def write(store, batch_id, rows, keys, make):
    with store.batch(batch_id) as made:
        if not made.done:
            made.write("t", make(ROWS, *rows), make("contract_id STRING", *[(k,) for k in keys]))


def current(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_newest_batch_of_a_key_wins(spark, make, tmp_path):
    store, rng, want = S.Store(spark, str(tmp_path), fan=2), random.Random(1), {}
    keys = [None, "", "a", "b", "c", "d", "e"]
    for batch_id in range(9):
        touched = rng.sample(keys, 3)
        rows = [(k, batch_id, f"{k}-{i}") for k in touched for i in range(rng.randrange(3))]  # some keys lose their rows
        write(store, batch_id, rows, touched, make)
        want = {k: v for k, v in want.items() if k not in touched} | {k: [r for r in rows if r[0] == k] for k in touched}
        assert current(store.read("t")) == sorted((r for v in want.values() for r in v), key=str)
    runs = store.snapshot().runs["t"]
    assert len(runs) <= 4 and [r["level"] for r in runs] == sorted((r["level"] for r in runs), reverse=True)
    some = make("contract_id STRING", (None,), ("a",), ("zzz",), ("a",))
    assert current(store.read("t", some)) == sorted((r for k in (None, "a") for r in want[k]), key=str)
    assert store.read("t", make("contract_id STRING")).count() == 0
    # only what the last two manifests name is left
    named = {r["path"] for m in (store.snapshot(), store.snapshot(store.snapshot().number - 1)) for r in m.runs["t"]}
    assert {f"t/{x}" for x in os.listdir(tmp_path / "t")} == named


def test_repeated_batch_and_unknown_table(spark, make, tmp_path):
    store = S.Store(spark, str(tmp_path))
    write(store, 5, [("a", 1, "x")], ["a"], make)
    write(store, 5, [("a", 2, "y")], ["a"], make)
    write(store, 4, [("a", 3, "z")], ["a"], make)
    assert current(store.read("t")) == [("a", 1, "x")]
    with pytest.raises(KeyError):
        store.read("other")
    with pytest.raises(ValueError):
        S.Store(spark, str(tmp_path), fan=1)


def test_tables_of_a_batch_appear_together(spark, make, tmp_path):
    store = S.Store(spark, str(tmp_path))
    keys = make("contract_id STRING", ("a",))

    def both(batch_id, stop):
        with store.batch(batch_id) as made:
            made.write("fields", make(ROWS, ("a", batch_id, "f")), keys)
            if stop:
                raise OSError("lost")
            made.write("findings", make(ROWS, ("a", batch_id, "v")), keys)

    both(0, False)
    before = store.snapshot()
    with pytest.raises(OSError):
        both(1, True)  # stops between the two tables
    assert store.snapshot() == before
    assert [current(store.read(t)) for t in ("fields", "findings")] == [[("a", 0, "f")], [("a", 0, "v")]]
    both(1, False)
    assert [current(store.read(t)) for t in ("fields", "findings")] == [[("a", 1, "f")], [("a", 1, "v")]]
    assert current(store.read("fields", snapshot=before)) == [("a", 0, "f")]  # readers of the manifest before


@pytest.mark.parametrize("step", ["_publish", "_retire", "_write"])
def test_stop_while_runs_are_merged(spark, make, tmp_path, monkeypatch, step):
    store = S.Store(spark, str(tmp_path), fan=2)
    write(store, 0, [("a", 0, "x"), ("b", 0, "y")], ["a", "b"], make)
    plain, calls = getattr(S.Store, step), []

    def lost(self, *args):
        calls.append(args)
        if step != "_write" or len(calls) == 2:  # the second write is that of the merged run
            raise OSError("lost")
        return plain(self, *args)

    monkeypatch.setattr(S.Store, step, lost)
    with pytest.raises(OSError):
        write(store, 1, [("a", 1, "z")], ["a"], make)
    monkeypatch.setattr(S.Store, step, plain)
    seen = [("a", 1, "z"), ("b", 0, "y")] if step == "_retire" else [("a", 0, "x"), ("b", 0, "y")]
    assert current(store.read("t")) == seen
    write(store, 1, [("a", 1, "z")], ["a"], make)
    write(store, 2, [("c", 2, "w")], ["c"], make)
    assert current(store.read("t")) == [("a", 1, "z"), ("b", 0, "y"), ("c", 2, "w")]


def test_look_up_opens_files_of_the_keys_alone(spark, make, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = S.Store(spark, str(tmp_path), fan=8)
        for batch_id in range(3):
            rows = spark.range(4000).selectExpr(f"concat('k', id + {1000 * batch_id}) AS contract_id", f"{batch_id} AS n", "'x' AS text")
            with store.batch(batch_id) as made:
                made.write("t", rows, rows)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        one = make("contract_id STRING", ("k2500",))
        assert current(store.read("t", one)) == [("k2500", 2, "x")]
        assert store.opened == 6  # rows and keys of three runs, of four files each
        assert len(list(tmp_path.glob("t/*/rows/*.parquet"))) == 12
        assert store.read("t", spark.range(6000).selectExpr("concat('k', id) AS contract_id")).count() == 6000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_merge_joins_rows_and_keys_once(spark, make, tmp_path, monkeypatch):
    """With no older run left the merged keys were joined to a second working-out of the merged rows."""
    plans = {}
    whole = S.Store._write_part

    def seen(self, folder, df):
        plans.setdefault(folder.split("/")[-1], []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return whole(self, folder, df)

    monkeypatch.setattr(S.Store, "_write_part", seen, raising=True)
    store = S.Store(spark, str(tmp_path), fan=2)
    write(store, 0, [("a", 1, "x"), ("b", 2, "y")], ["a", "b"], make)
    write(store, 1, [("b", 3, "z")], ["a", "b"], make)  # a is gone
    assert "Join" in plans["rows"][-1] and "Join" not in plans["keys"][-1]
    assert current(store.read("t")) == [("b", 3, "z")]
    assert current(store.read("t", make("contract_id STRING", ("a",), ("b",)))) == [("b", 3, "z")]
