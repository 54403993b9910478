"""Stages on small literal collections, and what they reject."""

from __future__ import annotations

import datetime as dt

import pytest

from docweave import Database
from docweave.errors import ExpectedDocument, InvalidStage, MixedProjection, UnsupportedOperator, UnsupportedStage


@pytest.fixture(scope="module")
def run(spark):
    def evaluate(rows, pipeline, **others):
        db = Database(spark)
        make = lambda rs: db.aggregate([{"$documents": [{k: {"$literal": v} for k, v in r.items()} for r in rs]}])
        db.tables = {"c": make(rows), **{n: make(r) for n, r in others.items()}}

        def bare(v):
            if isinstance(v, dict):
                return {k: bare(x) for k, x in v.items() if x is not None}
            return [bare(x) for x in v] if isinstance(v, list) else v

        return [bare(r.asDict(True)) for r in db["c"].aggregate(pipeline).collect()]

    return evaluate


def by(rows, *keys):
    return sorted(rows, key=lambda r: tuple(str(r.get(k)) for k in keys))


CATCH = [{"_id": i, "boat": b, "fish": f, "kilos": k} for i, (b, f, k) in enumerate([("Heron", "cod", 1), ("Heron", "eel", 2), ("Tern", "cod", 5), ("Heron", "cod", 4)])]


def test_group_keeps_input_order(run):
    out = run(CATCH, [{"$group": {"_id": "$boat", "kilos": {"$sum": "$kilos"}, "mean": {"$avg": "$kilos"}, "opening": {"$first": "$fish"}, "log": {"$push": "$fish"}, "kinds": {"$addToSet": "$fish"}}}])
    assert by(out, "_id") == [{"_id": "Heron", "kilos": 7, "mean": 7 / 3, "opening": "cod", "log": ["cod", "eel", "cod"], "kinds": ["cod", "eel"]}, {"_id": "Tern", "kilos": 5, "mean": 5.0, "opening": "cod", "log": ["cod"], "kinds": ["cod"]}]
    assert run(CATCH, [{"$match": {"boat": "Gull"}}, {"$group": {"_id": None, "n": {"$sum": 1}}}]) == []
    assert run(CATCH, [{"$sort": {"kilos": -1}}, {"$group": {"_id": None, "all": {"$push": "$kilos"}}}, {"$project": {"_id": 0}}]) == [{"all": [5, 4, 2, 1]}]


def test_group_order_counts_for_limits(run):
    assert run(CATCH, [{"$group": {"_id": "$kilos"}}, {"$limit": 2}]) == [{"_id": 1}, {"_id": 2}]


def test_sort_is_stable_and_nulls_are_low(run):
    rows = [{"i": 1, "a": 2}, {"i": 2}, {"i": 3, "a": 2}, {"i": 4, "a": 1}]
    assert [r["i"] for r in run(rows, [{"$sort": {"a": 1}}])][0] == 2
    assert [r["i"] for r in run(rows, [{"$sort": {"i": -1}}, {"$sort": {"a": -1, "i": 1}}])] == [1, 3, 4, 2]


def test_project_forms(run):
    rows = [{"_id": 1, "a": {"b": 1, "c": 2}, "d": 3}]
    assert run(rows, [{"$project": {"a.b": 1}}]) == [{"_id": 1, "a": {"b": 1}}]
    assert run(rows, [{"$project": {"a.b": 0, "_id": 0}}]) == [{"a": {"c": 2}, "d": 3}]
    assert run(rows, [{"$project": {"_id": "$d", "x.y": {"$add": ["$d", 1]}}}]) == [{"_id": 1, "x.y": 4}]
    assert run(rows, [{"$project": {"d": 1.0}}]) == [{"_id": 1, "d": 1.0}]
    assert run(rows, [{"$set": {"a.c.e": 5, "n.m": "$d"}}, {"$project": {"_id": 0, "a": 1, "n": 1}}]) == [{"a": {"b": 1, "c": {"e": 5}}, "n": {"m": 3}}]


def test_unwind(run):
    rows = [{"_id": 1, "a": [1, 2]}, {"_id": 2, "a": []}, {"_id": 3}]
    assert run(rows, [{"$unwind": "$a"}]) == [{"_id": 1, "a": 1}, {"_id": 1, "a": 2}]
    assert by(run(rows, [{"$unwind": {"path": "$a", "preserveNullAndEmptyArrays": True}}]), "_id") == [{"_id": 1, "a": 1}, {"_id": 1, "a": 2}, {"_id": 2}, {"_id": 3}]
    assert run([{"_id": 1, "a": 5}], [{"$unwind": "$a"}]) == []


def test_buckets(run):
    rows = [{"_id": i, "n": i} for i in range(1, 11)]
    out = run(rows, [{"$bucketAuto": {"groupBy": "$n", "buckets": 3, "output": {"n": {"$sum": 1}, "all": {"$push": "$n"}}}}])
    assert by(out, "n") and sorted(out, key=lambda r: r["_id"]["min"]) == [{"_id": {"min": 1, "max": 5}, "n": 4, "all": [1, 2, 3, 4]}, {"_id": {"min": 5, "max": 8}, "n": 3, "all": [5, 6, 7]}, {"_id": {"min": 8, "max": 10}, "n": 3, "all": [8, 9, 10]}]
    out = run(rows, [{"$bucket": {"groupBy": "$n", "boundaries": [0, 4, 8], "default": "rest"}}])
    assert {str(r["_id"]): r["count"] for r in out} == {"0": 3, "4": 4, "rest": 3}
    with pytest.raises(Exception, match="bucket"):
        run(rows, [{"$bucket": {"groupBy": "$n", "boundaries": [0, 4]}}])


def test_lookup_forms(run):
    local = [{"_id": 1, "k": "a", "ks": ["a", "c"]}, {"_id": 2, "k": "z", "ks": []}, {"_id": 3, "ks": ["b"]}]
    foreign = [{"f": "a", "v": 1}, {"f": "b", "v": 2}, {"f": "a", "v": 3}, {"v": 4}]
    out = run(local, [{"$lookup": {"from": "o", "localField": "k", "foreignField": "f", "as": "m"}}, {"$project": {"v": {"$map": {"input": "$m", "in": "$$this.v"}}}}], o=foreign)
    assert by(out, "_id") == [{"_id": 1, "v": [1, 3]}, {"_id": 2, "v": []}, {"_id": 3, "v": [4]}]  # missing meets missing
    out = run(local, [{"$lookup": {"from": "o", "localField": "ks", "foreignField": "f", "as": "m"}}, {"$project": {"v": {"$map": {"input": "$m", "in": "$$this.v"}}}}], o=foreign)
    assert by(out, "_id") == [{"_id": 1, "v": [1, 3]}, {"_id": 2, "v": []}, {"_id": 3, "v": [2]}]
    out = run(local, [{"$lookup": {"from": "o", "let": {"i": "$_id"}, "pipeline": [{"$match": {"$expr": {"$gt": ["$v", "$$i"]}}}, {"$sort": {"v": -1}}, {"$limit": 1}, {"$project": {"v": 1, "i": "$$i"}}], "as": "m"}}, {"$project": {"m": 1}}], o=foreign)
    assert by(out, "_id") == [{"_id": i, "m": [{"v": 4, "i": i}]} for i in (1, 2, 3)]
    out = run(local, [{"$lookup": {"from": "o", "let": {"i": "$k"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$f", "$$i"]}}}, {"$group": {"_id": None, "t": {"$sum": "$v"}}}], "as": "m"}}, {"$project": {"t": {"$sum": {"$map": {"input": "$m", "in": "$$this.t"}}}}}], o=foreign)
    assert by(out, "_id") == [{"_id": 1, "t": 4}, {"_id": 2, "t": 0}, {"_id": 3, "t": 4}]
    assert run(local, [{"$lookup": {"from": "o", "localField": "k", "foreignField": "f", "as": "m"}}, {"$unwind": "$m"}, {"$match": {"m.v": 3}}, {"$project": {"_id": 1}}], o=foreign) == [{"_id": 1}]


def test_graph_lookup_stops_at_cycles(run):
    people = [{"name": "a", "next": ["b"]}, {"name": "b", "next": ["c", "a"]}, {"name": "c", "next": ["a"]}, {"name": "d", "next": ["d"]}]
    out = run([{"_id": 1, "s": "a"}, {"_id": 2, "s": "x"}], [{"$graphLookup": {"from": "p", "startWith": "$s", "connectFromField": "next", "connectToField": "name", "as": "r", "depthField": "d"}}, {"$project": {"r": {"$map": {"input": "$r", "in": {"$concat": ["$$this.name", {"$toString": "$$this.d"}]}}}}}], p=people)
    assert by(out, "_id") == [{"_id": 1, "r": ["a0", "b1", "c2"]}, {"_id": 2, "r": []}]
    out = run([{"_id": 1, "s": "a"}], [{"$graphLookup": {"from": "p", "startWith": "$s", "connectFromField": "next", "connectToField": "name", "as": "r", "maxDepth": 1, "restrictSearchWithMatch": {"name": {"$ne": "c"}}}}, {"$project": {"n": {"$size": "$r"}}}], p=people)
    assert out == [{"_id": 1, "n": 2}]


def test_redact(run):
    rows = [{"_id": 1, "level": 1, "sub": {"level": 5, "x": 1}, "items": [{"level": 1, "y": 1}, {"level": 9, "y": 2}]}, {"_id": 2, "level": 9}]
    out = run(rows, [{"$redact": {"$cond": [{"$lte": ["$level", 4]}, "$$DESCEND", "$$PRUNE"]}}])
    assert out == [{"_id": 1, "level": 1, "items": [{"level": 1, "y": 1}]}]


def test_windows_by_value_in_falling_order(run):
    rows = [{"_id": i, "s": s} for i, s in enumerate([1, 2, 2, 10])]
    out = run(rows, [{"$setWindowFields": {"sortBy": {"s": -1}, "output": {"near": {"$push": "$s", "window": {"range": [-1, 0]}}, "first": {"$first": "$s", "window": {"range": [-1, 0]}}, "rank": {"$rank": {}}, "dense": {"$denseRank": {}}, "next": {"$shift": {"output": "$s", "by": 1, "default": 0}}}}}])
    got = {r["_id"]: r for r in out}
    assert got[0]["near"] == [1] and sorted(got[1]["near"]) == [1, 2, 2] and got[1]["first"] == 2 and got[3]["rank"] == 1 and got[0]["rank"] == 4 and got[0]["dense"] == 3 and got[0]["next"] == 0


def test_densify_and_fill(run):
    rows = [{"p": "a", "v": 0, "x": 1}, {"p": "a", "v": 4, "x": 5}, {"p": "b", "v": 3}]
    out = run(rows, [{"$densify": {"field": "v", "partitionByFields": ["p"], "range": {"step": 2, "bounds": "full"}}}, {"$fill": {"partitionBy": "$p", "sortBy": {"v": 1}, "output": {"x": {"method": "linear"}}}}])
    assert by(out, "p", "v") == [{"p": "a", "v": 0, "x": 1.0}, {"p": "a", "v": 2, "x": 3.0}, {"p": "a", "v": 4, "x": 5.0}, {"p": "b", "v": 3}]
    days = [{"t": dt.datetime(2024, 1, 31)}, {"t": dt.datetime(2024, 4, 30)}]
    out = run(days, [{"$densify": {"field": "t", "range": {"step": 1, "unit": "month", "bounds": "full"}}}])
    assert sorted(r["t"].replace(tzinfo=None) for r in out) == [dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 29), dt.datetime(2024, 4, 29), dt.datetime(2024, 4, 30)]


def test_facet_and_union(run):
    out = run(CATCH, [{"$facet": {"n": [{"$count": "n"}], "x": [{"$match": {"fish": "eel"}}, {"$project": {"kilos": 1, "_id": 0}}]}}])
    assert out == [{"n": [{"n": 4}], "x": [{"kilos": 2}]}]
    assert by(run([{"_id": 1}], [{"$unionWith": {"coll": "o", "pipeline": [{"$match": {"_id": {"$gt": 1}}}]}}], o=[{"_id": 1}, {"_id": 2, "z": 5}]), "_id") == [{"_id": 1}, {"_id": 2, "z": 5}]


@pytest.mark.parametrize(
    ("pipeline", "error"),
    [
        ([{"$vectorSearch": {}}], UnsupportedStage), ([{"$match": {}, "$limit": 1}], InvalidStage), ([{"$project": {"a": 1, "b": 0}}], MixedProjection), ([{"$project": {}}], InvalidStage), ([{"$group": {"n": {"$sum": 1}}}], InvalidStage), ([{"$group": {"_id": 1, "n": {"$max": "$a"}}}], UnsupportedOperator), ([{"$replaceRoot": {"newRoot": 5}}], ExpectedDocument),
        ([{"$out": "x"}, {"$match": {}}], InvalidStage), ([{"$match": {}}, {"$documents": []}], InvalidStage), ([{"$bucket": {"groupBy": "$a", "boundaries": [3, 1]}}], InvalidStage), ([{"$bucketAuto": {"groupBy": "$a", "buckets": 2, "granularity": "R5"}}], InvalidStage), ([{"$facet": {"a": [{"$facet": {}}]}}], InvalidStage), ([{"$lookup": {"from": "c", "localField": "a", "as": "x"}}], InvalidStage),
        ([{"$setWindowFields": {"output": {"r": {"$rank": {}}}}}], InvalidStage), ([{"$setWindowFields": {"output": {"r": {"$derivative": {}}}}}], UnsupportedOperator), ([{"$densify": {"field": "a", "range": {"step": 0, "bounds": "full"}}}], InvalidStage), ([{"$fill": {"output": {"a": {"method": "linear"}}}}], InvalidStage), ([{"$geoNear": {"near": [1, 2], "limit": 3}}], InvalidStage), ([{"$merge": {"into": "x", "whenMatched": "fail", "whenNotMatched": "discard"}}], InvalidStage),
        ([{"$currentOp": {}}], InvalidStage), ([{"$listSearchIndexes": {"id": "a", "name": "b"}}], Exception), ([{"$listMqlEntities": {}}], InvalidStage), ([{"$sample": {}}], InvalidStage), ([{"$count": "$n"}], InvalidStage),
    ],
)
def test_rejected(run, pipeline, error):
    with pytest.raises(error):
        run([{"_id": 1, "a": 1}], pipeline)


def test_group_sum_fails_on_text(run):
    with pytest.raises(Exception, match="numeric"):
        run([{"_id": 1, "a": "x"}], [{"$group": {"_id": None, "n": {"$sum": "$a"}}}])
