"""Saved tables: whole versions, two writers at once, failures, old versions, histories."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from protolith.operators import versions


@pytest.fixture
def store(spark, tmp_path):
    return versions.Store(spark, str(tmp_path / "store"))


def files(store):
    return sorted(f.name for f in Path(store.path).iterdir())


def test_versions(spark, store):
    assert store.version() == 0 and store.read() == {} and store.table("t", "a int").collect() == []
    one = spark.createDataFrame([(1, None)], "a int, `b c` array<string>")
    assert store.commit(lambda t: {"t": one}, "first") == 1
    assert store.commit(lambda t: {"u": one.limit(0)}) == 2
    assert store.commit(lambda t: {"t": t["t"].union(one)}) == 3
    assert [store.read(v)["t"].count() for v in (1, 2, 3)] == [1, 1, 2]
    assert store.read()["u"].schema.simpleString() == one.schema.simpleString() and store.read()["u"].count() == 0
    assert [tuple(r) for r in versions.progress(store).collect()] == [(3, ""), (2, ""), (1, "first")]
    store.forget(1)
    assert store.versions() == [3] and store.read()["t"].count() == 2 and len(files(store)) == 3


def test_failures_leave_nothing(spark, store):
    store.commit(lambda t: {"t": spark.range(3)})
    before = files(store)
    with pytest.raises(Exception, match="stop"):
        store.commit(lambda t: {"a": spark.range(2), "t": spark.range(9).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))})
    assert files(store) == before and store.version() == 1 and store.read()["t"].count() == 3
    with pytest.raises(versions.Conflict):
        store.commit(lambda t: (store._claim(store.version() + 1, '{"note": "", "tables": {}}'), {"t": spark.range(1)})[1], tries=2)
    assert files(store) == before


def test_two_writers_lose_nothing(spark, store):
    failed = []

    def write(who):
        mine = versions.Store(spark, store.path)
        try:
            for k in range(4):
                row = spark.createDataFrame([(who, k)], "who int, k int")
                mine.commit(lambda t, row=row: {"t": t["t"].union(row) if "t" in t else row})
        except Exception as e:  # told by the main thread
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and store.version() == 12
    assert sorted(tuple(r) for r in store.read()["t"].collect()) == [(w, k) for w in range(3) for k in range(4)]
    # What lost a race is deleted: a snapshot for each version, and the log.
    assert len(files(store)) == 13


def test_mappings_and_knowledge(spark, store):
    new = lambda *rows: spark.createDataFrame([(*r, "2024") for r in rows], "original string, target string, confidence double, ord long, created_at string")
    versions.save_mappings(store, new(("a", "X", 0.9, 1), ("b", "Y", 0.8, 2)))
    versions.save_mappings(store, new(("a", "Z", 1.0, 3), ("c", "Y", 0.7, 4), ("c", "W", 0.6, 5)))
    t = store.read()
    assert sorted(tuple(r) for r in t["mappings"].select("original", "target", "confidence").collect()) == [("a", "Z", 1.0), ("b", "Y", 0.8), ("c", "W", 0.6)]
    assert {(r["source"], r["hits"]) for r in t["knowledge"].collect()} == {("a", 2), ("b", 1), ("c", 2)}
    assert {(r["source"], r["target"]) for r in t["knowledge"].collect()} == {("a", "X"), ("b", "Y"), ("c", "Y")}


def test_templates_fields_and_history(spark, store):
    rows = lambda *r: spark.createDataFrame(list(r), versions.TEMPLATES)
    versions.save_templates(store, rows(("1", "甲", ["f1"], 0), ("2", "甲", None, 1)))
    versions.save_templates(store, rows(("2", "乙", ["f2"], 2)), spark.createDataFrame([("1",)], "id string"))
    assert [(r["id"], r["name"], r["field_ids"]) for r in store.read()["templates"].collect()] == [("2", "乙", ["f2"])]
    versions.replace_fields(store, spark.createDataFrame([("1", "参数", 0)], "id string, name string, ord long"))
    versions.replace_fields(store, spark.createDataFrame([("9", "值", 0)], "id string, name string, ord long"))
    assert [r["id"] for r in store.read()["protocol_fields"].collect()] == ["9"]
    tasks = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("task_id"), F.format_string("%04d", "id").alias("created_at"), F.lit("x").alias("raw_tables"))
    versions.add_history(store, tasks(0, 40))
    versions.add_history(store, tasks(40, 70))
    kept = store.read()["history"]
    assert kept.columns == ["task_id", "created_at"] and sorted(r["task_id"] for r in kept.collect()) == list(range(20, 70))
    assert set(store.read()) == {"templates", "protocol_fields", "history"}
