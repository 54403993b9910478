"""Joins whose pipelines name variables of outer pipelines, and null and missing join keys."""

from __future__ import annotations

import pytest

from docweave import Database
from docweave.errors import InvalidStage


@pytest.fixture(scope="module")
def garden(spark):
    beds = [(1, "sun", [3, 4], 10), (2, "shade", None, 20), (3, "sun", [], 30), (4, None, [None, 5], 40)]
    plants = [(3, "sun", [1, 9], "thyme"), (4, "shade", None, "fern"), (5, "sun", [], "sage"), (None, "moss", [2], "moss")]
    soils = [("sun", "dry", 15), ("sun", "wet", 35), ("shade", "wet", 5)]
    return Database(spark, {
        "beds": spark.createDataFrame(beds, "bed int, light string, wants array<int>, room int"),
        "plants": spark.createDataFrame(plants, "plant int, likes string, beds array<int>, name string"),
        "soils": spark.createDataFrame(soils, "light string, kind string, least int"),
    })


def run(garden, pipeline, name="beds"):
    return sorted(((r["bed"], r["got"]) for r in garden[name].aggregate(pipeline).collect()), key=repr)


NAMES = {"$map": {"input": "$got", "as": "x", "in": "$$x.name"}}


def names(garden, spec):
    return dict(run(garden, [{"$lookup": {**spec, "as": "got"}}, {"$project": {"bed": 1, "got": {"$sortArray": {"input": NAMES, "sortBy": 1}}}}]))


def test_null_arrays_join_null_and_empty_ones_nothing(garden):
    assert names(garden, {"from": "plants", "localField": "wants", "foreignField": "plant"}) == {1: ["fern", "thyme"], 2: ["moss"], 3: [], 4: ["moss", "sage"]}
    assert names(garden, {"from": "plants", "localField": "bed", "foreignField": "beds"}) == {1: ["thyme"], 2: ["moss"], 3: [], 4: []}
    assert names(garden, {"from": "plants", "localField": "nowhere", "foreignField": "beds"}) == dict.fromkeys((1, 2, 3, 4), ["fern"])
    assert names(garden, {"from": "plants", "localField": "wants", "foreignField": "plant", "pipeline": []}) == {1: ["fern", "thyme"], 2: ["moss"], 3: [], 4: ["moss", "sage"]}
    assert names(garden, {"from": "plants", "localField": "wants", "foreignField": "beds", "pipeline": []}) == {1: [], 2: ["fern"], 3: [], 4: ["fern"]}


def test_inner_pipelines_see_outer_variables_under_their_own_names(garden):
    inner = {"from": "soils", "localField": "likes", "foreignField": "light", "as": "soil", "pipeline": [{"$match": {"$expr": {"$gte": ["$$room", "$least"]}}}]}
    kept = {"$project": {"name": 1, "n": {"$size": "$soil"}}}
    spec = {"from": "plants", "localField": "light", "foreignField": "likes", "let": {"room": "$room"}, "as": "got"}
    counted = {"$project": {"bed": 1, "got": {"$sum": {"$map": {"input": "$got", "as": "x", "in": "$$x.n"}}}}}
    assert run(garden, [{"$lookup": {**spec, "pipeline": [{"$lookup": inner}, kept]}}, counted]) == [(1, 0), (2, 1), (3, 2), (4, 0)]
    # the same with a variable of its own between both, and one that hides the outer name
    own = {**inner, "let": {"mine": "$plant"}}
    assert run(garden, [{"$lookup": {**spec, "pipeline": [{"$lookup": own}, kept]}}, counted]) == [(1, 0), (2, 1), (3, 2), (4, 0)]
    hidden = {**inner, "let": {"room": 100}}
    assert run(garden, [{"$lookup": {**spec, "pipeline": [{"$lookup": hidden}, kept]}}, counted]) == [(1, 4), (2, 1), (3, 4), (4, 0)]
    free = {"from": "soils", "as": "soil", "pipeline": [{"$match": {"$expr": {"$lt": ["$$room", "$least"]}}}]}
    assert run(garden, [{"$lookup": {**spec, "pipeline": [{"$lookup": free}, kept]}}, counted]) == [(1, 4), (2, 1), (3, 2), (4, 0)]


def test_walks_start_from_null_and_obey_outer_variables(garden):
    walk = {"from": "plants", "startWith": "$wants", "connectFromField": "beds", "connectToField": "plant", "as": "got"}
    assert dict(run(garden, [{"$graphLookup": walk}, {"$project": {"bed": 1, "got": NAMES}}])) == {1: ["thyme", "fern"], 2: ["moss"], 3: [], 4: ["moss", "sage"]}
    inside = {"from": "plants", "startWith": "$plant", "connectFromField": "beds", "connectToField": "plant", "as": "seen", "restrictSearchWithMatch": {"$expr": {"$eq": ["$likes", "$$light"]}}}
    spec = {"from": "plants", "let": {"light": "$light"}, "as": "got", "pipeline": [{"$graphLookup": inside}, {"$project": {"n": {"$size": "$seen"}}}]}
    assert run(garden, [{"$lookup": spec}, {"$project": {"bed": 1, "got": {"$sum": {"$map": {"input": "$got", "as": "x", "in": "$$x.n"}}}}}]) == [(1, 2), (2, 1), (3, 2), (4, 0)]


def test_sample_keeps_the_order_of_small_collections(garden):
    ordered = garden["beds"].aggregate([{"$sort": {"room": -1}}, {"$sample": {"size": 9}}]).collect()
    assert [r["bed"] for r in ordered] == [4, 3, 2, 1]
    with pytest.raises(InvalidStage):
        garden["beds"].aggregate([{"$sample": {"size": 0}}])


def test_fields_that_later_stages_do_not_read_are_left_out(garden):
    look = {"$lookup": {"from": "plants", "localField": "bed", "foreignField": "plant", "as": "got"}}
    size = {"$project": {"bed": 1, "got": {"$size": "$got"}}}

    def plan(stages):
        return garden["beds"].aggregate(stages)._jdf.queryExecution().optimizedPlan().toString()

    assert "name, name#" in plan([look]) and "name, name#" not in plan([look, size])
    assert run(garden, [look, {"$match": {"got.name": "thyme"}}, size]) == [(3, 1)]
    assert run(garden, [look, {"$match": {"got.0.name": "fern"}}, size]) == []  # digits name a field
    assert run(garden, [look, {"$match": {"$or": [{"got": {"$elemMatch": {"likes": "sun", "name": "thyme"}}}, {"got.absent": {"$exists": True}}]}}, size]) == [(3, 1)]
    assert run(garden, [look, {"$match": {"bed": 3}}, {"$project": {"bed": 1, "got": {"$arrayElemAt": ["$got", 0]}}}])[0][1]["likes"] == "sun"
    assert run(garden, [look, {"$match": {"bed": 3, "got": {"$size": 1}}}, {"$project": {"bed": 1, "got": 1}}])[0][1][0]["name"] == "thyme"
