"""Writes, indexes, cursors and the change log of stored collections, and the registry against the list of operators."""

from __future__ import annotations

import pytest

from docweave import Database, read_json
from docweave.errors import InvalidArgument, InvalidUpdate
from docweave.functions import OPERATORS
from docweave.operators import STAGES
from docweave.operators.grouping import ACCUMULATORS
from docweave.operators.sinks import MergeError
from docweave.operators.windows import WINDOW_FUNCTIONS
from docweave.plans.filter import FILTER_OPERATORS
from docweave.sources.database import DuplicateKey, FailPointEnabled


def test_registry_is_complete():
    assert (len(OPERATORS), len(STAGES), len(FILTER_OPERATORS), len(ACCUMULATORS), len(WINDOW_FUNCTIONS)) == (152, 44, 29, 5, 15)


@pytest.fixture()
def db(spark, tmp_path):
    return Database(spark, folder=str(tmp_path))



def test_writes_and_changes(db):
    c = db["c"]
    assert c.insert([{"_id": 1, "n": 1, "s": "a"}, {"_id": 2, "n": 2}]) == 2
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": 1}])
    assert c.update({"_id": 1}, {"$inc": {"n": 5}, "$set": {"x.y": True}, "$unset": {"s": ""}}) == {"matched": 1, "modified": 1, "upserted": 0}
    assert c.update({"n": {"$gt": 0}}, [{"$set": {"n": {"$multiply": ["$n", 2]}}}], multi=True)["matched"] == 2
    assert c.update({"_id": 9, "n": {"$gt": 5}}, {"$set": {"s": "new"}}, upsert=True)["upserted"] == 1
    assert c.update({"_id": 2}, {"s": "replaced"})["modified"] == 1
    assert c.delete({"_id": 9}, limit=1) == 1
    got = {r["_id"]: r.asDict(True) for r in c.df.collect()}
    assert got[1]["n"] == 12 and got[1]["x"] == {"y": True} and got[1].get("s") is None
    assert got[2]["s"] == "replaced" and got[2]["n"] is None
    events = c.aggregate([{"$changeStream": {"fullDocument": "updateLookup"}}]).collect()
    assert [e["operationType"] for e in events] == ["insert", "insert", "update", "update", "update", "insert", "replace", "delete"]
    later = c.aggregate([{"$changeStream": {"resumeAfter": {"seq": events[5]["_id"]["seq"]}}}]).collect()
    assert [e["operationType"] for e in later] == ["replace", "delete"]
    with pytest.raises(InvalidArgument):
        c.aggregate([{"$changeStream": {"resumeAfter": {"seq": 1}}}])
    with pytest.raises(InvalidUpdate):
        c.update({}, {"$push": {"a": 1}})


def test_streamed_changes(db, tmp_path):
    from docweave.plans.frame import Context
    from docweave.streaming.changestream import read_stream

    db["c"].insert([{"_id": 1}, {"_id": 2}])
    query = read_stream({}, Context(db, "c")).select("_id.seq", "operationType").writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert db.spark.table("changes").count() == 2


def test_split_of_large_events(db):
    from docweave.streaming.changestream import change_stream, split_large_events
    from docweave.plans.frame import Context

    db["c"].insert([{"_id": 1, "s": "x" * 300}])
    whole = change_stream({}, Context(db, "c"))
    assert split_large_events(whole).count() == 1
    parts = split_large_events(whole, limit=330).orderBy("_id.fragmentNum").collect()
    assert [p["splitEvent"]["fragment"] for p in parts] == list(range(1, len(parts) + 1)) and len(parts) == 2 and parts[0]["splitEvent"]["of"] == 2
    assert sum(p["fullDocument"] is not None for p in parts) == 1


def test_merge_modes(db):
    db["t"].insert([{"_id": 1, "a": 1, "b": 1}, {"_id": 2, "a": 2, "b": 2}])
    new = [{"$documents": [{"_id": 2, "a": 20}, {"_id": 3, "a": 30}]}]
    db.aggregate([*new, {"$merge": {"into": "t", "whenMatched": "merge"}}])
    assert {r["_id"]: (r["a"], r["b"]) for r in db["t"].df.collect()} == {1: (1, 1), 2: (20, 2), 3: (30, None)}
    db.aggregate([{"$documents": [{"_id": 1, "a": 5}, {"_id": 7, "a": 7}]}, {"$merge": {"into": "t", "whenMatched": "replace", "whenNotMatched": "discard"}}])
    assert {r["_id"]: (r["a"], r["b"]) for r in db["t"].df.collect()} == {1: (5, None), 2: (20, 2), 3: (30, None)}
    with pytest.raises(MergeError) as e:
        db.aggregate([*new, {"$merge": {"into": "t", "whenMatched": "fail"}}])
    assert e.value.code == 11000
    with pytest.raises(MergeError) as e:
        db.aggregate([{"$documents": [{"_id": 99, "a": 1}, {"_id": 3, "a": 31}]}, {"$merge": {"into": "t", "whenNotMatched": "fail"}}])
    assert e.value.code == 13113 and {r["_id"]: r["a"] for r in db["t"].df.collect()} == {1: 5, 2: 20, 3: 31}


def test_catalog_commands(db):
    db["a"].insert([{"_id": i, "k": i // 2} for i in range(4)])
    with pytest.raises(DuplicateKey):
        db["a"].create_index({"k": 1}, unique=True)
    assert db["a"].create_index({"k": 1}) == "k_1" and len(db["a"].list_indexes()) == 2
    db.rename("a", "b")
    assert db.list_collections() == ["b"] and db["b"].count({"k": 1}) == 2 and db["b"].count({}, skip=3) == 1
    cursor = db["b"].cursor([{"$sort": {"_id": 1}}], batch=3)
    assert [r["_id"] for r in cursor.get_more()] == [0, 1, 2] and len(cursor.get_more()) == 1 and not cursor.open
    assert {r["value"] for r in db["b"].distinct("k").collect()} == {0, 1}
    assert db["b"].aggregate([{"$collStats": {"count": {}, "storageStats": {"scale": 2}}}]).first()["count"] == 4
    assert "Scan parquet" in db["b"].explain([{"$match": {"k": 1}}])
    assert db.drop("b") and not db.drop("b")


def test_dynamic_documents(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"a": 1, "b": {"c": "x"}}\n{"a": "one"}\n{"a": null}\n')
    df = read_json(spark, str(path), dynamic=True)
    c = Database(spark, {"c": df})["c"]
    kinds = sorted(r["t"] for r in c.aggregate([{"$project": {"t": {"$type": "$doc.a"}}}]).collect())
    assert kinds == ["long", "null", "string"]
    assert c.count({"doc.a": 1}) == 1 and c.count({"doc.b.c": "x"}) == 1 and c.count({"doc.b.c": {"$exists": False}}) == 2


def test_inserts_are_deltas(db):
    c, store = db["c"], db.store
    store.fold = 2
    c.insert([{"_id": 0, "n": 0, "x": 0.5}])
    for i in range(1, 8):
        c.insert([{"_id": i, "n": i}])
    assert store.versions("c") == [1] and [d[:2] for d in store.deltas("c", 1)] == [(1, 4), (5, 6), (7, 7)]
    assert [(r["_id"], r["n"]) for r in c.df.orderBy("_id").collect()] == [(i, i) for i in range(8)]
    assert store.size("c") > 0
    for twice in ([{"_id": 6}], [{"_id": 90}, {"_id": 90}]):
        with pytest.raises(DuplicateKey):
            c.insert(twice)
    c.create_index({"n": 1}, unique=True)
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": 40, "n": 7}])
    c.insert([{"_id": 40, "x": 1}])  # a narrower number fits
    with pytest.raises(DuplicateKey):
        c.insert([{"_id": 41, "x": 1.0}])  # a second document without the key
    c.insert([{"_id": 41, "n": 41, "y": "new"}])  # a field of its own: the next version
    assert store.versions("c") == [1, 2] and store.deltas("c", 2) == [] and c.count() == 10
    assert c.delete({"_id": {"$lt": 8}}) == 8 and c.count() == 2
    c.insert([{"_id": 42, "n": 42}])
    assert store.versions("c") == [2, 3] and {r["_id"] for r in c.df.collect()} == {40, 41, 42}
    assert not [n for n in store._names(f"{store.folder}/c") if n.startswith("v1")]


def test_delta_that_was_not_completed(db):
    c, store = db["c"], db.store
    c.insert([{"_id": 1}, {"_id": 2, "n": 1}])
    c.insert([{"_id": 3, "n": 1}])
    store.remove("c/v1d1-1/_SUCCESS")  # as a lost driver leaves it
    assert c.count() == 2
    c.insert([{"_id": 4, "n": 1}])
    assert {r["_id"] for r in c.df.collect()} == {1, 2, 4}


def test_parameters_and_fail_points(db):
    assert db.get_parameter() == {"authenticationMechanisms": [], "requireApiVersion": False, "ok": 1.0}
    assert db.get_parameter(1, requireApiVersion=1, other=1) == {"requireApiVersion": False, "ok": 1.0} and db.get_parameter(2) == {"ok": 1.0}
    assert db.kill_all_sessions([]) == {"ok": 1.0}
    db.configure_fail_point("failCommand", {"times": 1}, {"failCommands": ["Count"], "errorCode": 91, "errorLabels": ["again"]})
    assert db["c"].find().count() == 0
    with pytest.raises(FailPointEnabled) as failed:
        db["c"].count()
    assert failed.value.code == 91 and failed.value.labels == ["again"] and db["c"].count() == 0
    db.configure_fail_point("failCommand", "alwaysOn", {"failCommands": ["find"]})
    assert db["c"].find().count() == 0  # no error is named
    db.configure_fail_point("failCommand", "off")
    for point, mode, data in (("other", "off", None), ("failCommand", "on", {}), ("failCommand", "alwaysOn", {}), ("failCommand", "alwaysOn", {"failCommands": ["find"], "errorCode": "x"})):
        with pytest.raises(InvalidArgument):
            db.configure_fail_point(point, mode, data)
