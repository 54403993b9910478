"""Expression operators on one literal document each, with the values that the document model asks for."""

from __future__ import annotations

import datetime as dt

import pytest

from docweave import Timestamp
from docweave.errors import ExpectedNumeric, InvalidArgument, QueryError, UnsupportedOperator

DAY = dt.datetime(2024, 1, 31, 10, 30, 15, 250000)
DOC = {
    "n": 7, "neg": -7, "d": 2.5, "z": 0, "s": "Hello", "u": "naïve été", "nul": None, "b": True, "a": [3, 1, 2], "dup": [1, 2, 2, 3], "e": [], "w": ["x", "y"],
    "o": {"p": 1, "q": "t"}, "docs": [{"k": 2, "v": "b"}, {"k": 1, "v": "a"}], "t": DAY, "ts": Timestamp(42, 7), "bin": b"\x01\x02",
}


@pytest.fixture(scope="module")
def run(db):
    """Many expressions over the document in one query, so that the suite stays quick."""

    def evaluate(**expressions):
        rows = [{k: {"$literal": v} for k, v in DOC.items()}]
        out = db.aggregate([{"$documents": rows}, {"$project": {"_id": 0, **expressions}}]).collect()[0].asDict(True)
        return {k: out.get(k) for k in expressions}

    return evaluate


def check(run, **pairs):
    got = run(**{k: e for k, (e, _) in pairs.items()})
    assert got == {k: want for k, (_, want) in pairs.items()}


def test_arithmetic(run):
    check(
        run,
        add=({"$add": ["$n", 3, "$z"]}, 10), sub=({"$subtract": ["$n", "$d"]}, 4.5), mul=({"$multiply": ["$n", "$n"]}, 49), div=({"$divide": ["$n", 2]}, 3.5), mod=({"$mod": ["$neg", 3]}, -1),
        half=({"$round": [{"$literal": 2.5}]}, 3), halfn=({"$round": [{"$literal": -2.5}]}, -3), place=({"$round": [{"$literal": 1234.5678}, 2]}, 1234.57), tens=({"$round": ["$n", -1]}, 10),
        trunc=({"$trunc": [{"$literal": -2.7}]}, -2), ceil=({"$ceil": "$d"}, 3.0), floor=({"$floor": "$d"}, 2.0), abs=({"$abs": "$neg"}, 7), pow=({"$pow": [2, 10]}, 1024), none=({"$exp": "$nul"}, None),
        bits=({"$bitXor": ["$n", 2]}, 5), inv=({"$bitNot": "$n"}, -8),
    )


def test_comparison_across_types(run):
    check(
        run,
        null_low=({"$lt": ["$nul", "$b"]}, True), bool_number=({"$lt": ["$b", "$z"]}, True), number_string=({"$lt": ["$n", "$s"]}, True), object_array=({"$lt": ["$o", "$a"]}, True),
        missing_null=({"$eq": ["$gone", None]}, True), same=({"$eq": ["$n", 7.0]}, True), cmp=({"$cmp": ["$d", "$n"]}, -1), arrays=({"$gt": ["$a", [3, 0]]}, True),
    )


def test_control(run):
    check(
        run,
        switch=({"$switch": {"branches": [{"case": "$z", "then": "a"}, {"case": "$s", "then": "b"}]}}, "b"), ifnull=({"$ifNull": ["$nul", "$gone", 5]}, 5),
        lazy=({"$and": ["$z", {"$divide": [1, "$z"]}]}, False), let=({"$let": {"vars": {"x": {"$add": ["$n", 1]}}, "in": {"$multiply": ["$$x", "$$x"]}}}, 64),
        remove=({"$setField": {"field": "p", "input": "$o", "value": "$$REMOVE"}}, {"q": "t"}), put=({"$setField": {"field": "r", "input": "$o", "value": 9}}, {"p": 1, "q": "t", "r": 9}), root=({"$getField": {"field": "n", "input": "$$ROOT"}}, 7),
        not_empty=({"$not": [""]}, False),
    )


def test_arrays(run):
    check(
        run,
        at=({"$arrayElemAt": ["$a", -1]}, 2), out=({"$arrayElemAt": ["$a", 9]}, None), slice=({"$slice": ["$a", -2]}, [1, 2]), slice3=({"$slice": ["$a", 1, 1]}, [1]), rng=({"$range": [5, 0, -2]}, [5, 3, 1]), empty=({"$range": [5, 5]}, []),
        idx=({"$indexOfArray": ["$dup", 2, 2]}, 2), none=({"$indexOfArray": ["$dup", 9]}, -1), filt=({"$filter": {"input": "$dup", "cond": {"$gte": ["$$this", 2]}, "limit": 2}}, [2, 2]), mp=({"$map": {"input": "$a", "as": "x", "in": {"$add": ["$$x", "$n"]}}}, [10, 8, 9]),
        red=({"$reduce": {"input": "$w", "initialValue": "", "in": {"$concat": ["$$value", "$$this"]}}}, "xy"), sort=({"$sortArray": {"input": "$docs", "sortBy": {"k": 1}}}, [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]), down=({"$sortArray": {"input": "$a", "sortBy": -1}}, [3, 2, 1]),
        zip=({"$zip": {"inputs": ["$a", "$dup"], "useLongestLength": True, "defaults": [0, 0]}}, [[3, 1], [1, 2], [2, 2], [0, 3]]), union=({"$setUnion": ["$dup", [9]]}, [1, 2, 3, 9]), diff=({"$setDifference": ["$dup", [2]]}, [1, 3]), inter=({"$setIntersection": ["$a", "$dup"]}, [3, 1, 2]),
        eq=({"$setEquals": ["$a", "$dup"]}, True), obj=({"$objectToArray": {"x": 1, "y": 2}}, [{"k": "x", "v": 1}, {"k": "y", "v": 2}]), back=({"$arrayToObject": "$docs2"}, None), first=({"$first": "$e"}, None), firstn=({"$firstN": {"input": "$a", "n": 2}}, [3, 1]), maxn=({"$maxN": {"input": "$a", "n": 2}}, [3, 2]),
        size=({"$size": "$e"}, 0), cat=({"$concatArrays": ["$a", "$nul"]}, None), merged=({"$mergeObjects": ["$o", {"q": "z"}, None]}, {"p": 1, "q": "z"}),
    )


def test_statistics(run):
    check(
        run,
        sum=({"$sum": "$a"}, 6), sums=({"$sum": ["$n", "$s", "$d"]}, 9.5), avg=({"$avg": "$a"}, 2.0), noavg=({"$avg": "$w"}, None), mx=({"$max": "$a"}, 3), mn=({"$min": ["$n", None, 3]}, 3), pop=({"$stdDevPop": [[2, 4]]}, 1.0), samp=({"$stdDevSamp": [[2]]}, None),
        med=({"$median": {"input": [1, 2, 3, 10], "method": "continuous"}}, 2.5), p=({"$percentile": {"input": [1, 2, 3, 10], "p": [0.5, 0.9], "method": "approximate"}}, [2.0, 10.0]), nop=({"$percentile": {"input": "$e", "p": [0.5], "method": "discrete"}}, [None]),
    )


def test_strings(run):
    check(
        run,
        low=({"$toLower": "$n"}, "7"), nul=({"$toUpper": "$nul"}, ""), ascii=({"$toUpper": "$u"}, "NAïVE éTé"), bytes=({"$strLenBytes": "$u"}, 12), cps=({"$strLenCP": "$u"}, 9), sub=({"$substrCP": ["$u", 2, 3]}, "ïve"), subb=({"$substrBytes": ["$u", 2, 2]}, "ï"), tail=({"$substrBytes": ["$s", 3, -1]}, "lo"),
        at=({"$indexOfCP": ["$u", "é"]}, 6), atb=({"$indexOfBytes": ["$u", "é"]}, 7), none=({"$indexOfCP": ["$s", "l", 4]}, -1), split=({"$split": ["a.b.c", "."]}, ["a", "b", "c"]), one=({"$replaceOne": {"input": "$s", "find": "l", "replacement": "L"}}, "HeLlo"), al=({"$replaceAll": {"input": "$s", "find": "l", "replacement": ""}}, "Heo"),
        trim=({"$trim": {"input": "  x\t "}}, "x"), chars=({"$ltrim": {"input": "xxyx", "chars": "x"}}, "yx"), cc=({"$strcasecmp": ["$s", "HELLO"]}, 0), cat=({"$concat": ["a", "$nul"]}, None),
        find=({"$regexFind": {"input": "$s", "regex": "l(l)(o)"}}, {"match": "llo", "idx": 2, "captures": ["l", "o"]}), al2=({"$regexFindAll": {"input": "$u", "regex": "[^a-z ]"}}, [{"match": "ï", "idx": 2, "captures": ["ï"]}, {"match": "é", "idx": 6, "captures": ["é"]}, {"match": "é", "idx": 8, "captures": ["é"]}]),
        m=({"$regexMatch": {"input": "$s", "regex": "^hell", "options": "i"}}, True),
    )


def test_dates(run):
    utc = lambda *a: dt.datetime(*a)
    got = run(
        leap={"$dateAdd": {"startDate": "$t", "unit": "month", "amount": 1}}, zone={"$dateToString": {"date": "$t", "format": "%Y-%m-%d %H:%M %z %Z", "timezone": "America/New_York"}}, whole={"$dateDiff": {"startDate": "$t", "endDate": {"$dateAdd": {"startDate": "$t", "unit": "month", "amount": 1}}, "unit": "month"}},
        weeks={"$dateDiff": {"startDate": dt.datetime(2024, 1, 6), "endDate": dt.datetime(2024, 1, 7), "unit": "week"}}, back={"$dateDiff": {"startDate": dt.datetime(2024, 1, 1, 1), "endDate": dt.datetime(2024, 1, 1), "unit": "hour"}}, bin={"$dateTrunc": {"date": "$t", "unit": "minute", "binSize": 20}}, days={"$dateTrunc": {"date": "$t", "unit": "day", "binSize": 7}},
        made={"$dateFromParts": {"isoWeekYear": 2020, "isoWeek": 53, "isoDayOfWeek": 5}}, parsed={"$dateFromString": {"dateString": "2024-03-01T10:00:00.5+02:00"}}, local={"$dateFromString": {"dateString": "2024-03-01 10:00:00", "timezone": "+02:00"}}, named={"$dateFromString": {"dateString": "5 Mar 2021", "format": "%d %b %Y"}}, nul={"$year": "$nul"},
        week={"$week": dt.datetime(2024, 1, 7)}, iso={"$isoWeek": dt.datetime(2021, 1, 1)}, ms={"$millisecond": "$t"}, sec={"$tsSecond": "$ts"}, text={"$dateToString": {"date": "$t"}},
    )
    got = {k: v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v for k, v in got.items()}
    assert got == {
        "leap": utc(2024, 2, 29, 10, 30, 15, 250000), "zone": "2024-01-31 05:30 -0500 -300", "whole": 1, "weeks": 1, "back": -1, "bin": utc(2024, 1, 31, 10, 20), "days": utc(2024, 1, 29), "made": utc(2021, 1, 1), "parsed": utc(2024, 3, 1, 8, 0, 0, 500000), "local": utc(2024, 3, 1, 8),
        "named": utc(2021, 3, 5), "nul": None, "week": 1, "iso": 53, "ms": 250, "sec": 42, "text": "2024-01-31T10:30:15.250Z",
    }


def test_conversions(run):
    check(
        run,
        b=({"$toBool": "$s"}, True), z=({"$toBool": "$z"}, False), i=({"$toInt": {"$literal": -2.9}}, -2), s=({"$toString": "$d"}, "2.5"), whole=({"$toString": {"$literal": 3.0}}, "3"), js=({"$toString": "$o"}, '{"p":1,"q":"t"}'), arr=({"$toString": "$a"}, "[3,1,2]"), date=({"$toString": "$t"}, "2024-01-31T10:30:15.250Z"),
        ms=({"$toLong": "$t"}, 1706697015250), bad=({"$convert": {"input": " 1", "to": "int", "onError": -1}}, -1), nul=({"$convert": {"input": "$nul", "to": 2, "onNull": "n"}}, "n"), oid=({"$toObjectId": "0123456789ABCDEF01234567"}, "0123456789abcdef01234567"),
        num=({"$isNumber": "$s"}, False), ty=({"$type": "$a"}, "array"), mi=({"$type": "$gone"}, "missing"), lit=({"$type": {"$literal": None}}, "null"), bs=({"$bsonSize": "$o"}, 5 + 7 + 9), bn=({"$binarySize": "$bin"}, 2),
        h1=({"$toHashedIndexKey": {"$pow": [2, 4]}}, 2598032665634823220), h2=({"$toHashedIndexKey": None}, 2338878944348059895),
    )


@pytest.mark.parametrize(
    ("expression", "error"),
    [
        ({"$add": ["$s", 1]}, ExpectedNumeric), ({"$nope": 1}, UnsupportedOperator), ({"$similarityCosine": 1}, UnsupportedOperator), ("$$UNKNOWN", InvalidArgument), ({"$subtract": [1]}, InvalidArgument), ({"$not": "$b"}, InvalidArgument), ({"$dateAdd": {"startDate": "$t", "unit": "eon", "amount": 1}}, InvalidArgument),
        ({"$zip": {"inputs": ["$a"], "defaults": [1]}}, InvalidArgument), ({"$regexMatch": {"input": "$s", "regex": "(?=a)"}}, InvalidArgument), ({"$round": "$d"}, InvalidArgument), ({"$size": "$s"}, InvalidArgument), ({"$convert": {"input": 1, "to": "int", "base": 2}}, InvalidArgument), ({"$let": {"vars": {"X": 1}, "in": 1}}, InvalidArgument),
    ],
)
def test_rejected(run, expression, error):
    with pytest.raises(error):
        run(x=expression)


@pytest.mark.parametrize("expression", [{"$divide": [1, "$z"]}, {"$add": [1, "$nulnum"]}, {"$ln": "$z"}, {"$sqrt": "$neg"}, {"$toInt": "$s"}, {"$range": [0, 1, "$z"]}, {"$dateFromParts": {"year": 2023, "month": 2, "day": 30}}, {"$substrBytes": ["$u", 3, 1]}, {"$dateFromString": {"dateString": "$s"}}])
def test_fails_while_running(run, expression):
    with pytest.raises(Exception) as e:
        run(x=expression)
    assert isinstance(e.value, QueryError) or "USER_RAISED" in str(e.value) or "expected" in str(e.value)
