"""Filters on small literal collections: paths through arrays, missing fields, and the order across types."""

from __future__ import annotations

import re

import pytest

from docweave import Database
from docweave.errors import InvalidArgument, InvalidStructure, UnsupportedOperator

ROWS = [
    {"k": 1, "grams": 7, "mark": "oak", "tags": [1, 5, 9], "state": {"on": True, "n": 2}, "items": [{"a": 1, "b": "x"}, {"a": 5, "b": "y"}], "bin": b"\x05"},
    {"k": 2, "grams": -8, "mark": "Oar", "tags": [], "state": {"on": False}, "items": [{"a": 5, "b": "x"}], "bin": b"\x00"},
    {"k": 3, "mark": "zz", "tags": [2, 2], "nested": [[1, 2], [3]]},
    {"k": 4, "grams": 0},
]


@pytest.fixture(scope="module")
def collection(spark):
    db = Database(spark)
    db.tables["c"] = db.aggregate([{"$documents": [{k: {"$literal": v} for k, v in r.items()} for r in ROWS]}]).cache()
    return db["c"]


@pytest.mark.parametrize(
    ("spec", "keys"),
    [
        ({"grams": 7}, [1]), ({"grams": {"$ne": 7}}, [2, 3, 4]), ({"grams": {"$lt": 5}}, [2, 4]), ({"grams": {"$gte": 0.0}}, [1, 4]), ({"grams": None}, []), ({"grams": {"$in": [7, 0, None]}}, [1, 4]), ({"grams": {"$nin": [7]}}, [2, 3, 4]),
        ({"state.on": True}, [1]), ({"state.n": {"$exists": False}}, [2, 3, 4]), ({"tags": 5}, [1]), ({"tags": {"$gt": 6}}, [1]), ({"tags": [2, 2]}, [3]), ({"tags": {"$size": 0}}, [2]), ({"tags": {"$all": [1, 9]}}, [1]), ({"tags": {"$all": []}}, []),
        ({"items.a": 5}, [1, 2]), ({"items": {"$elemMatch": {"a": 5, "b": "x"}}}, [2]), ({"tags": {"$elemMatch": {"$gt": 1, "$lt": 6}}}, [1, 3]), ({"nested": 3}, [3]), ({"mark": {"$regex": "^oa", "$options": "i"}}, [1, 2]), ({"mark": re.compile("A", re.I)}, [1, 2]), ({"mark": {"$not": re.compile("z")}}, [1, 2, 4]),
        ({"grams": {"$mod": [4, 3]}}, [1]), ({"grams": {"$mod": [4, 0]}}, [2, 4]), ({"grams": {"$bitsAllSet": [0, 1, 2]}}, [1]), ({"grams": {"$bitsAnySet": [60]}}, [2]), ({"grams": {"$bitsAllClear": 7}}, [2, 4]), ({"bin": {"$bitsAllSet": [0, 2]}}, [1]), ({"mark": {"$gt": 5}}, [1, 2, 3]), ({"grams": {"$type": "number"}}, [1, 2, 4]), ({"tags": {"$type": "int"}}, [1, 3]), ({"tags": {"$type": "array"}}, [1, 2, 3]),
        ({"$or": []}, []), ({"$and": []}, [1, 2, 3, 4]), ({"$nor": [{"grams": 7}, {"k": 2}]}, [3, 4]), ({"$expr": {"$gt": [{"$divide": [56, "$grams"]}, 7]}}, [1]), ({"$expr": {"$eq": ["$grams", None]}}, [3]), ({"$alwaysFalse": 1}, []), ({"$sampleRate": 0}, []), ({"$comment": "x", "k": 1}, [1]), ({"grams": {"$not": {"$gt": 0}}}, [2, 3, 4]),
    ],
)
def test_matches(collection, spec, keys):
    assert sorted(r["k"] for r in collection.find(spec).select("k").collect()) == keys[:]




@pytest.mark.parametrize(
    ("spec", "error"),
    [
        ({"$where": "1"}, UnsupportedOperator), ({"a": {"$near": 1}}, UnsupportedOperator), ({"$text": {}}, UnsupportedOperator), ({"a": {"$jsonSchema": {}}}, UnsupportedOperator), ({"a": {"$in": 1}}, InvalidStructure), ({"a": {"$exists": 1}}, InvalidStructure), ({"a": {"$size": -1}}, InvalidStructure),
        ({"a": {"$options": "i"}}, InvalidStructure), ({"a": {"$mod": [0, 1]}}, InvalidStructure), ({"a": {"$regex": "(?<=x)y"}}, InvalidArgument), ({"a": {"$elemMatch": {"$expr": True}}}, InvalidStructure), ({"$alwaysTrue": 2}, InvalidStructure), ({"$sampleRate": 2}, InvalidStructure), ({"a": {"$type": "nope"}}, InvalidStructure), ({"a": {"$all": [{"$elemMatch": {}}]}}, InvalidStructure),
        ({"a": {"$gt": 1, "b": 2}}, InvalidStructure), ({"$and": {}}, InvalidStructure),
    ],
)
def test_rejected(collection, spec, error):
    with pytest.raises(error):
        collection.find(spec)


def test_plain_comparisons_reach_the_scan(spark):
    from docweave import read_tables
    from tests.conftest import SF

    db = Database(spark, read_tables(spark, SF, ["orders"]))
    import datetime as dt

    plan = db["orders"].explain(filter={"o_orderdate": {"$lt": dt.datetime(1995, 1, 1)}, "o_orderkey": {"$gte": 5}, "o_orderstatus": {"$in": ["F"]}})
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "LessThan(o_orderdate" in pushed and "GreaterThanOrEqual(o_orderkey,5)" in pushed and "o_orderstatus" in pushed
