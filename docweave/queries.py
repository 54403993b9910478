"""Registered queries over the driver's tables: a pipeline or a filter for each family of operators, with its SQL."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.errors import QueryError
from docweave.operators.sinks import MergeError
from docweave.plans.frame import shared_folder
from docweave.sources.database import Database, DuplicateKey, FailPointEnabled
from docweave.sources.tables import read_json, read_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _database(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> Database:
    return Database(spark, read_tables(spark, sf_dir, list(names)))


def pipeline(name: str, tables: str, stages: list, sql: str | None = None) -> None:
    """A pipeline over the first of the tables."""
    names = tuple(tables.split())
    QUERIES[name] = lambda spark, sf_dir: _database(spark, sf_dir, names)[names[0]].aggregate(stages)
    if sql:
        ORACLE_SQL[name] = sql


def function(name: str, sql: str | None = None):
    def note(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return note


def fields(**e: Any) -> dict:
    return {"$project": {"_id": 0, **e}}


D = dt.datetime

# the flagship

pipeline(
    "pricing_summary", "lineitem",
    [
        {"$match": {"l_shipdate": {"$lte": D(1998, 9, 2)}}},
        {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "avg_price": {"$avg": "$l_extendedprice"}, "n": {"$sum": 1}}},
        {"$project": {"_id": 0, "flag": "$_id.flag", "status": "$_id.status", "sum_qty": {"$round": ["$sum_qty", 2]}, "avg_price": {"$round": ["$avg_price", 4]}, "n": 1}},
        {"$sort": {"flag": 1, "status": 1}},
    ],
    """SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*)::BIGINT AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2""",
)

# filters

_ORDER = fields(o_orderkey=1, o_totalprice=1)
for _name, _match, _sql in (
    ("filter_comparisons", {"o_totalprice": {"$gt": 1000, "$lte": 250000.5}, "o_orderkey": {"$gte": 10, "$lt": 50000}, "o_orderstatus": {"$ne": "F"}, "o_orderpriority": {"$eq": "1-URGENT"}},
     "o_totalprice > 1000 AND o_totalprice <= 250000.5 AND o_orderkey >= 10 AND o_orderkey < 50000 AND o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'"),
    ("filter_in_nin", {"o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}, "o_orderstatus": {"$nin": ["F", "P"]}}, "o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('F', 'P')"),
    ("filter_logic", {"$or": [{"o_orderstatus": "O"}, {"$and": [{"o_totalprice": {"$lt": 50000}}, {"o_orderkey": {"$gt": 100}}]}], "$nor": [{"o_orderpriority": "5-LOW"}, {"o_custkey": {"$lte": 20}}]},
     "(o_orderstatus = 'O' OR (o_totalprice < 50000 AND o_orderkey > 100)) AND NOT (o_orderpriority = '5-LOW' OR o_custkey <= 20)"),
    ("filter_not", {"o_totalprice": {"$not": {"$gt": 100000}}, "o_orderpriority": {"$not": re.compile("^[45]")}}, "NOT o_totalprice > 100000 AND NOT regexp_matches(o_orderpriority, '^[45]')"),
    ("filter_mod", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3"),
    ("filter_bits", {"o_orderkey": {"$bitsAllSet": 3, "$bitsAnyClear": [2, 3]}, "o_custkey": {"$bitsAllClear": [0], "$bitsAnySet": 6}},
     "(o_orderkey & 3) = 3 AND (o_orderkey & 12) <> 12 AND (o_custkey & 1) = 0 AND (o_custkey & 6) <> 0"),
    ("filter_exists_type", {"o_totalprice": {"$exists": True, "$type": "double"}, "absent": {"$exists": False}, "o_orderkey": {"$type": ["long", 16]}, "o_orderstatus": {"$type": 2}, "$or": [{"o_custkey": {"$type": "string"}}, {"o_orderkey": {"$type": "number", "$mod": [3, 1]}}]}, "o_totalprice IS NOT NULL AND o_orderkey % 3 = 1"),
    ("filter_no_type_bracketing", {"o_orderstatus": {"$gt": 5}, "o_orderdate": {"$gt": "zzz"}, "o_orderkey": {"$lt": "a"}, "$or": [{"o_totalprice": {"$gt": "a"}}, {"o_totalprice": {"$gt": 100000}}]}, "o_totalprice > 100000"),
    ("filter_expr", {"$expr": {"$and": [{"$gt": ["$o_totalprice", {"$multiply": ["$o_custkey", 100]}]}, {"$ne": ["$o_orderstatus", "P"]}]}, "$comment": "over a hundred a customer number"}, "o_totalprice > o_custkey * 100.0 AND o_orderstatus <> 'P'"),
    ("filter_expr_errors", {"$expr": {"$gt": [{"$divide": [100, {"$subtract": ["$o_custkey", 10]}]}, 2]}}, "o_custkey <> 10 AND 100.0 / nullif(o_custkey - 10, 0) > 2"),
    ("filter_always", {"$alwaysTrue": 1, "$or": [{"$alwaysFalse": 1}, {"o_orderkey": {"$lte": 100}}]}, "o_orderkey <= 100"),
):
    pipeline(_name, "orders", [{"$match": _match}, _ORDER], f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_sql}")

pipeline("filter_regex", "part", [{"$match": {"p_name": {"$regex": "^.*[ae]", "$options": "i"}, "p_brand": re.compile("brand#[1-3]", re.I)}}, fields(p_partkey=1, p_name=1)],
         "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^.*[ae]', 'i') AND regexp_matches(p_brand, 'brand#[1-3]', 'i')")
pipeline("filter_sample_rate_all", "orders", [{"$match": {"$sampleRate": 1.0}}, {"$count": "n"}], "SELECT count(*)::BIGINT AS n FROM orders")
pipeline("filter_sample_rate", "orders", [{"$match": {"$sampleRate": 0.5}}, fields(o_orderkey=1)])
pipeline(
    "filter_arrays", "documents",
    [
        {"$set": {"words": {"$split": ["$text", " "]}, "head": {"$slice": [{"$split": ["$text", " "]}, 3]}}},
        {"$match": {"head": {"$size": 3}, "words": {"$all": ["the", "of"], "$elemMatch": {"$regex": "^a", "$ne": "and"}}}},
        fields(doc_id=1, first={"$arrayElemAt": ["$words", 0]}, n={"$size": "$words"}),
    ],
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
       SELECT doc_id, w[1] AS first, len(w)::BIGINT AS n FROM w WHERE len(w[1:3]) = 3 AND list_contains(w, 'the') AND list_contains(w, 'of') AND len(list_filter(w, lambda x: x LIKE 'a%' AND x <> 'and')) > 0""",
)
pipeline(
    "filter_array_of_documents", "orders lineitem",
    [
        {"$lookup": {"from": "lineitem", "localField": "o_orderkey", "foreignField": "l_orderkey", "as": "lines"}},
        {"$match": {"lines.l_returnflag": "R", "lines": {"$elemMatch": {"l_quantity": {"$gt": 40}, "l_linestatus": "F"}}}},
        fields(o_orderkey=1, n={"$size": "$lines"}),
    ],
    """SELECT o_orderkey, count(*)::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
       HAVING bool_or(l_returnflag = 'R') AND bool_or(l_quantity > 40 AND l_linestatus = 'F')""",
)

# stages on single documents

pipeline("stage_project_computed", "customer", [{"$project": {"c_custkey": 1, "net": {"$subtract": ["$c_acctbal", 100]}, "gone": "$absent"}}], "SELECT c_custkey, c_acctbal - 100 AS net FROM customer")
pipeline("stage_project_exclude", "nation", [{"$project": {"n_name": 0}}], "SELECT n_nationkey, n_regionkey FROM nation")
pipeline(
    "stage_set_unset_nested", "customer",
    [
        {"$set": {"who.key": "$c_custkey", "who.name": "$c_name", "twice": {"$multiply": ["$c_acctbal", 2]}}},
        {"$addFields": {"four": {"$multiply": ["$twice", 2]}, "who.segment": "$c_mktsegment"}},
        {"$unset": ["who.name", "c_nationkey"]},
        fields(key="$who.key", segment="$who.segment", none={"$type": "$who.name"}, four=1),
    ],
    "SELECT c_custkey AS key, c_mktsegment AS segment, 'missing' AS none, c_acctbal * 4 AS four FROM customer",
)
pipeline("stage_replace_root", "supplier", [{"$replaceRoot": {"newRoot": {"id": "$s_suppkey", "place": {"nation": "$s_nationkey"}}}}, {"$replaceWith": {"$mergeObjects": ["$place", {"id": "$id"}]}}], "SELECT s_nationkey AS nation, s_suppkey AS id FROM supplier")
pipeline(
    "stage_redact", "orders",
    [
        {"$project": {"_id": 0, "o_orderkey": 1, "level": {"$cond": [{"$eq": ["$o_orderstatus", "F"]}, 1, 2]}, "secret": {"level": {"$cond": [{"$gt": ["$o_totalprice", 100000]}, 3, 1]}, "price": "$o_totalprice"}}},
        {"$redact": {"$cond": [{"$lte": ["$level", 2]}, "$$DESCEND", "$$PRUNE"]}},
        fields(o_orderkey=1, price="$secret.price", seen={"$type": "$secret"}),
    ],
    "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_totalprice > 100000 THEN 'missing' ELSE 'object' END AS seen FROM orders",
)

# rows

pipeline("stage_sort_skip_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 5}, {"$limit": 20}, _ORDER], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
pipeline("stage_count", "lineitem", [{"$match": {"l_quantity": {"$gte": 25}}}, {"$count": "n"}], "SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_quantity >= 25")
pipeline("stage_count_empty", "region", [{"$match": {"r_name": "NOWHERE"}}, {"$count": "n"}], "SELECT 0::BIGINT AS n")
pipeline("stage_sample_all", "nation", [{"$sample": {"size": 1000}}, fields(n_name=1)], "SELECT n_name FROM nation")
pipeline("stage_sample", "customer", [{"$sample": {"size": 10}}, fields(c_custkey=1)])
pipeline(
    "stage_unwind", "documents",
    [fields(doc_id=1, lines={"$split": ["$text", "\n"]}), {"$unwind": "$lines"}, {"$group": {"_id": "$doc_id", "n": {"$sum": 1}, "bytes": {"$sum": {"$strLenBytes": "$lines"}}}}],
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id AS _id, count(*)::BIGINT AS n, sum(strlen(line))::BIGINT AS bytes FROM l GROUP BY 1",
)
pipeline("stage_unwind_preserve", "customer", [fields(c_custkey=1, a={"$cond": [{"$gt": ["$c_acctbal", 5000]}, [1, 2], []]}), {"$unwind": {"path": "$a", "preserveNullAndEmptyArrays": True}}],
         "SELECT c_custkey, unnest(CASE WHEN c_acctbal > 5000 THEN [1, 2] ELSE [NULL] END) AS a FROM customer")


@function("stage_documents", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) t(a, b)")
def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Database(spark).aggregate([{"$documents": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}, {"a": {"$add": [1, 2]}}]}, {"$set": {"a": {"$toInt": "$a"}}}])


# groups

pipeline(
    "group_accumulators", "orders",
    [
        {"$sort": {"o_orderdate": 1, "o_orderkey": 1}},
        {"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}, "first": {"$first": "$o_orderkey"}, "keys": {"$push": "$o_orderkey"}, "states": {"$addToSet": "$o_orderstatus"}}},
        {"$project": {"n": 1, "total": {"$round": ["$total", 2]}, "mean": {"$round": ["$mean", 4]}, "first": 1, "third": {"$arrayElemAt": ["$keys", 2]}, "listed": {"$size": "$keys"}, "states": {"$size": "$states"}}},
    ],
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
       SELECT o_orderpriority AS _id, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, max(CASE WHEN rn = 1 THEN o_orderkey END) AS first,
       max(CASE WHEN rn = 3 THEN o_orderkey END) AS third, count(*)::BIGINT AS listed, count(DISTINCT o_orderstatus)::BIGINT AS states FROM o GROUP BY 1""",
)
pipeline("group_all", "lineitem", [{"$group": {"_id": None, "n": {"$sum": 1}, "lines": {"$sum": "$l_linenumber"}}}, fields(n=1, lines=1)], "SELECT count(*)::BIGINT AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem")
pipeline("group_distinct_keys", "customer", [{"$group": {"_id": {"s": "$c_mktsegment", "n": "$c_nationkey"}}}, fields(s="$_id.s", n="$_id.n")], "SELECT DISTINCT c_mktsegment AS s, c_nationkey AS n FROM customer")
pipeline("sort_by_count", "customer", [{"$sortByCount": "$c_mktsegment"}], 'SELECT c_mktsegment AS _id, count(*)::BIGINT AS "count" FROM customer GROUP BY 1')
pipeline("bucket", "orders", [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0, 50000, 100000, 200000], "default": -1, "output": {"n": {"$sum": 1}, "mean": {"$avg": "$o_totalprice"}}}}, {"$set": {"mean": {"$round": ["$mean", 4]}}}],
         """SELECT (CASE WHEN o_totalprice >= 0 AND o_totalprice < 50000 THEN 0 WHEN o_totalprice >= 50000 AND o_totalprice < 100000 THEN 50000 WHEN o_totalprice >= 100000 AND o_totalprice < 200000 THEN 100000 ELSE -1 END)::INTEGER AS _id,
            count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""")  # fmt: skip
pipeline("bucket_auto", "orders", [{"$bucketAuto": {"groupBy": "$o_orderkey", "buckets": 7, "output": {"n": {"$sum": 1}, "total": {"$sum": "$o_custkey"}}}}, fields(low="$_id.min", high="$_id.max", n=1, total=1)],
         """WITH b AS (SELECT *, ntile(7) OVER (ORDER BY o_orderkey) AS b FROM orders), g AS (SELECT b, min(o_orderkey) AS low, max(o_orderkey) AS own, count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS total FROM b GROUP BY 1)
            SELECT low, coalesce(lead(low) OVER (ORDER BY b), own) AS high, n, total FROM g""")  # fmt: skip
pipeline(
    "facet", "customer",
    [
        {"$facet": {"segments": [{"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}}}], "rich": [{"$match": {"c_acctbal": {"$gt": 5000}}}, {"$count": "n"}], "none": [{"$match": {"c_custkey": -1}}]}},
        fields(segments={"$size": "$segments"}, most={"$max": "$segments.n"}, rich={"$arrayElemAt": [{"$map": {"input": "$rich", "as": "r", "in": "$$r.n"}}, 0]}, none={"$size": "$none"}),
        {"$unset": "most"},
    ],
    "SELECT (SELECT count(DISTINCT c_mktsegment) FROM customer)::BIGINT AS segments, (SELECT count(*) FROM customer WHERE c_acctbal > 5000)::BIGINT AS rich, 0::BIGINT AS none",
)

# joins

pipeline(
    "lookup_equality", "nation region",
    [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, fields(n_name=1, region={"$arrayElemAt": [{"$map": {"input": "$r", "as": "x", "in": "$$x.r_name"}}, 0]}, n={"$size": "$r"})],
    "SELECT n_name, r_name AS region, 1::BIGINT AS n FROM nation JOIN region ON r_regionkey = n_regionkey",
)
pipeline(
    "lookup_unwind_join", "orders customer",
    [{"$match": {"o_totalprice": {"$gt": 100000}}}, {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$group": {"_id": "$c.c_mktsegment", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"}}}, {"$set": {"total": {"$round": ["$total", 2]}}}],
    "SELECT c_mktsegment AS _id, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1",
)
pipeline("lookup_anti", "customer nation", [{"$lookup": {"from": "nation", "localField": "c_custkey", "foreignField": "n_nationkey", "as": "s"}}, {"$match": {"s": {"$size": 0}}}, fields(c_custkey=1)], "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)")
pipeline(
    "lookup_nested", "region nation supplier",
    [
        {"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "let": {"r": "$r_regionkey", "k": "$r_name"}, "as": "nations", "pipeline": [
            {"$lookup": {"from": "supplier", "let": {"k": "$n_nationkey"}, "as": "s", "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$s_nationkey", "$$k"]}, {"$gt": ["$s_acctbal", {"$multiply": ["$$r", 1000]}]}]}}}, {"$project": {"s_suppkey": 1}}]}},
            fields(n_name=1, n={"$size": "$s"}, name="$$k"),
        ]}},
        {"$unwind": "$nations"},
        fields(r_name="$nations.name", n_name="$nations.n_name", n="$nations.n"),
    ],
    "SELECT r_name, n_name, count(s_suppkey)::BIGINT AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > r_regionkey * 1000 GROUP BY 1, 2",
)
pipeline(
    "lookup_null_arrays", "region",
    [
        {"$set": {"wanted": {"$cond": [{"$eq": [{"$mod": ["$r_regionkey", 2]}, 0]}, [{"$toInt": "$r_regionkey"}, 3], None]}}},
        {"$lookup": {"localField": "wanted", "foreignField": "k", "pipeline": [{"$documents": [{"k": None, "v": 1}, {"k": 3, "v": 2}, {"k": 2, "v": 4}]}], "as": "d"}},
        fields(r_name=1, total={"$toLong": {"$sum": {"$map": {"input": "$d", "as": "x", "in": "$$x.v"}}}}),
    ],
    "SELECT r_name, CASE WHEN r_regionkey % 2 = 1 THEN 1 WHEN r_regionkey = 2 THEN 6 ELSE 2 END::BIGINT AS total FROM region",
)
pipeline(
    "graph_lookup_variables", "region nation",
    [
        {"$lookup": {"from": "nation", "let": {"r": "$r_regionkey"}, "as": "n", "pipeline": [
            {"$match": {"$expr": {"$eq": ["$n_regionkey", "$$r"]}}},
            {"$graphLookup": {"from": "nation", "startWith": "$n_regionkey", "connectFromField": "n_regionkey", "connectToField": "n_nationkey", "as": "reach", "restrictSearchWithMatch": {"$expr": {"$lte": ["$n_nationkey", {"$add": ["$$r", 1]}]}}}},
            fields(n={"$size": "$reach"}),
        ]}},
        fields(r_name=1, nations={"$size": "$n"}, reach={"$max": {"$map": {"input": "$n", "as": "x", "in": "$$x.n"}}}),
    ],
    """WITH RECURSIVE w(r, node) AS (SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey = r_regionkey
         UNION SELECT w.r, c.n_nationkey FROM w JOIN nation p ON p.n_nationkey = w.node JOIN nation c ON c.n_nationkey = p.n_regionkey AND c.n_nationkey <= w.r + 1)
       SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS nations, (SELECT count(*) FROM w WHERE w.r = r_regionkey)::BIGINT AS reach FROM region""",
)
pipeline("lookup_semi", "customer orders", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}}, {"$match": {"o": {"$ne": []}}}, fields(c_custkey=1, n={"$size": "$o"})], "SELECT o_custkey AS c_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1")
pipeline(
    "lookup_arrays", "region nation",
    [{"$set": {"wanted": [{"$toInt": {"$multiply": ["$r_regionkey", 5]}}, {"$toInt": {"$add": ["$r_regionkey", 1]}}]}}, {"$lookup": {"from": "nation", "localField": "wanted", "foreignField": "n_nationkey", "as": "n"}}, fields(r_name=1, n={"$size": "$n"})],
    "SELECT r_name, count(n_nationkey)::BIGINT AS n FROM region LEFT JOIN nation ON n_nationkey IN (r_regionkey * 5, r_regionkey + 1) GROUP BY 1",
)
pipeline(
    "lookup_correlated", "customer orders",
    [
        {"$lookup": {"from": "orders", "let": {"k": "$c_custkey", "b": "$c_acctbal"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$k"]}, {"$gt": ["$o_totalprice", {"$multiply": ["$$b", 10]}]}]}}}, {"$project": {"o_orderkey": 1}}], "as": "o"}},
        fields(c_custkey=1, n={"$size": "$o"}),
    ],
    "SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10 GROUP BY c_custkey",
)
pipeline("lookup_uncorrelated", "region nation", [{"$lookup": {"from": "nation", "pipeline": [{"$match": {"n_regionkey": 1}}, {"$project": {"n_name": 1}}], "as": "all"}}, fields(r_name=1, n={"$size": "$all"})], "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = 1)::BIGINT AS n FROM region")
pipeline("union_with", "supplier customer", [fields(key="$s_suppkey", bal="$s_acctbal"), {"$unionWith": {"coll": "customer", "pipeline": [{"$match": {"c_acctbal": {"$lt": 0}}}, fields(key="$c_custkey", segment="$c_mktsegment")]}}],
         "SELECT s_suppkey AS key, s_acctbal AS bal, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer WHERE c_acctbal < 0")
pipeline(
    "graph_lookup", "nation",
    [
        {"$set": {"next": {"$toInt": {"$add": ["$n_nationkey", 3]}}}},
        {"$graphLookup": {"from": "nation", "startWith": "$next", "connectFromField": "n_regionkey", "connectToField": "n_nationkey", "as": "reach", "maxDepth": 3, "depthField": "depth"}},
        fields(n_nationkey=1, n={"$size": "$reach"}, deepest={"$max": {"$map": {"input": "$reach", "as": "r", "in": "$$r.depth"}}}),
    ],
    """WITH RECURSIVE w(root, node, depth) AS (SELECT a.n_nationkey, b.n_nationkey, 0 FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 3
         UNION SELECT w.root, c.n_nationkey, w.depth + 1 FROM w JOIN nation p ON p.n_nationkey = w.node JOIN nation c ON c.n_nationkey = p.n_regionkey WHERE w.depth < 3),
       f AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2)
       SELECT n_nationkey, count(node)::BIGINT AS n, max(depth)::BIGINT AS deepest FROM nation LEFT JOIN f ON root = n_nationkey GROUP BY 1""",
)

# windows and series

pipeline(
    "window_functions", "events",
    [
        {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {
            "running": {"$sum": "$value", "window": {"documents": ["unbounded", "current"]}}, "near": {"$avg": "$value", "window": {"documents": [-2, 0]}},
            "low": {"$min": "$value"}, "high": {"$max": "$value", "window": {"documents": ["unbounded", "unbounded"]}}, "n": {"$count": {}},
            "first": {"$first": "$event_type"}, "last": {"$last": "$event_type", "window": {"documents": ["current", 1]}}, "rank": {"$rank": {}}, "dense": {"$denseRank": {}}, "number": {"$documentNumber": {}},
            "before": {"$shift": {"output": "$event_type", "by": -1, "default": "none"}}}}},
        fields(event_id=1, running={"$round": ["$running", 4]}, near={"$round": ["$near", 4]}, low=1, high=1, n=1, first=1, last=1, rank=1, dense=1, number=1, before=1),
    ],
    """SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running, round(avg(value) OVER (w ROWS 2 PRECEDING), 4) AS near, min(value) OVER (w ROWS UNBOUNDED PRECEDING) AS low,
       max(value) OVER (PARTITION BY user_id) AS high, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS n, first_value(event_type) OVER (w ROWS UNBOUNDED PRECEDING) AS first,
       last_value(event_type) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS last, rank() OVER w AS rank, dense_rank() OVER w AS dense, row_number() OVER w AS number,
       lag(event_type, 1, 'none') OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
pipeline(
    "window_ranges", "orders",
    [
        {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_totalprice": -1}, "output": {"close": {"$count": {}, "window": {"range": [-20000, 5000.5]}}, "sum": {"$sum": "$o_orderkey", "window": {"range": ["unbounded", "current"]}}}}},
        {"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderdate": 1}, "output": {"month": {"$count": {}, "window": {"range": [-1, 1], "unit": "month"}}, "week": {"$sum": "$o_orderkey", "window": {"range": [-7, 0], "unit": "day"}}}}},
        fields(o_orderkey=1, close=1, sum=1, month=1, week=1),
    ],
    """SELECT o_orderkey, count(*) OVER (p RANGE BETWEEN 20000 PRECEDING AND 5000.5 FOLLOWING) AS close, (sum(o_orderkey) OVER (p RANGE UNBOUNDED PRECEDING))::BIGINT AS sum,
       count(*) OVER (d RANGE BETWEEN INTERVAL 1 MONTH PRECEDING AND INTERVAL 1 MONTH FOLLOWING) AS month, (sum(o_orderkey) OVER (d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW))::BIGINT AS week
       FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_totalprice), d AS (PARTITION BY o_custkey ORDER BY o_orderdate)""",
)
pipeline(
    "window_lists", "events",
    [
        {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"ts": 1}, "output": {"last3": {"$push": "$event_type", "window": {"documents": [-2, 0]}}, "kinds": {"$addToSet": "$event_type", "window": {"documents": ["unbounded", "current"]}}}}},
        fields(event_id=1, last3={"$reduce": {"input": "$last3", "initialValue": "", "in": {"$concat": ["$$value", "/", "$$this"]}}}, kinds={"$size": "$kinds"}),
    ],
    """SELECT event_id, '/' || array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts ROWS 2 PRECEDING), '/') AS last3,
       len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)))::BIGINT AS kinds FROM events""",
)
_GAPS = {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$value", None]}
pipeline(
    "window_fills", "events",
    [
        {"$set": {"v": _GAPS}},
        {"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"carried": {"$locf": "$v"}, "line": {"$linearFill": "$v"}}}},
        fields(event_id=1, carried=1, line={"$cond": [{"$eq": ["$line", None]}, None, {"$round": [{"$ifNull": ["$line", 0]}, 6]}]}),
    ],
    """WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
       a AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER p AS pk,
             first_value(v IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER n AS nk FROM e
             WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT event_id, pv AS carried, round(CASE WHEN v IS NOT NULL THEN v WHEN pk IS NOT NULL AND nk IS NOT NULL THEN pv + (nv - pv) * (event_id - pk)::DOUBLE / (nk - pk) END, 6) AS line FROM a""",
)
pipeline(
    "densify_dates", "events",
    [
        {"$group": {"_id": {"t": "$event_type", "h": {"$dateTrunc": {"date": "$ts", "unit": "hour"}}}, "n": {"$sum": 1}}},
        fields(t="$_id.t", h="$_id.h", n=1),
        {"$densify": {"field": "h", "partitionByFields": ["t"], "range": {"step": 6, "unit": "hour", "bounds": "full"}}},
        {"$group": {"_id": "$t", "rows": {"$sum": 1}, "filled": {"$sum": {"$cond": [{"$eq": ["$n", None]}, 1, 0]}}}},
    ],
    """WITH g AS (SELECT DISTINCT event_type AS t, date_trunc('hour', ts) AS h FROM events), b AS (SELECT t, min(h) AS lo, max(h) AS hi FROM g GROUP BY 1),
       s AS (SELECT t, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS h FROM b), x AS (SELECT s.* FROM s ANTI JOIN g USING (t, h))
       SELECT t AS _id, ((SELECT count(*) FROM g WHERE g.t = b.t) + (SELECT count(*) FROM x WHERE x.t = b.t))::BIGINT AS rows, (SELECT count(*) FROM x WHERE x.t = b.t)::BIGINT AS filled FROM b""",
)
pipeline("densify_numbers", "nation", [fields(k={"$multiply": ["$n_nationkey", 4]}), {"$densify": {"field": "k", "range": {"step": 3, "bounds": [0, 40]}}}],
         "SELECT (n_nationkey * 4)::BIGINT AS k FROM nation UNION SELECT range::BIGINT FROM range(0, 40, 3)")
pipeline(
    "fill", "events",
    [
        {"$set": {"v": _GAPS, "w": _GAPS}},
        {"$fill": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"v": {"method": "locf"}, "w": {"value": -1}}}},
        fields(event_id=1, v=1, w=1),
    ],
    """WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
       SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v, coalesce(v, -1) AS w FROM e""",
)
pipeline(
    "geo_near", "customer",
    [
        {"$project": {"_id": 0, "c_custkey": 1, "loc": ["$c_acctbal", {"$multiply": ["$c_nationkey", 100.0]}]}},
        {"$geoNear": {"near": [1000, 500], "distanceField": "d", "key": "loc", "maxDistance": 4000, "minDistance": 10, "distanceMultiplier": 2.0, "query": {"c_custkey": {"$gt": 5}}}},
        fields(c_custkey=1, d={"$round": ["$d", 6]}, m={"$round": [{"$meta": "geoNearDistance"}, 6]}),
    ],
    """WITH d AS (SELECT c_custkey, sqrt((1000 - c_acctbal) * (1000 - c_acctbal) + (500 - c_nationkey * 100.0) * (500 - c_nationkey * 100.0)) AS d FROM customer WHERE c_custkey > 5)
       SELECT c_custkey, round(d * 2, 6) AS d, round(d * 2, 6) AS m FROM d WHERE d BETWEEN 10 AND 4000""",
)
pipeline(
    "geo_near_spherical", "customer",
    [
        {"$project": {"_id": 0, "c_custkey": 1, "loc": {"type": "Point", "coordinates": [{"$multiply": ["$c_nationkey", 5.0]}, {"$divide": ["$c_acctbal", 200]}]}}},
        {"$geoNear": {"near": {"type": "Point", "coordinates": [10, 20]}, "distanceField": "d", "spherical": True, "maxDistance": 3000000}},
        fields(c_custkey=1, d={"$round": [{"$divide": ["$d", 1000]}, 3]}),
    ],
    """WITH p AS (SELECT c_custkey, radians(c_nationkey * 5.0) AS lon, radians(c_acctbal / 200) AS lat FROM customer), h AS (SELECT c_custkey, pow(sin((lat - radians(20)) / 2), 2) + cos(radians(20)) * cos(lat) * pow(sin((lon - radians(10)) / 2), 2) AS h FROM p),
       d AS (SELECT c_custkey, 6378137.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS d FROM h) SELECT c_custkey, round(d / 1000, 3) AS d FROM d WHERE d <= 3000000""",
)

# expressions

pipeline(
    "expr_control", "orders",
    [fields(o_orderkey=1,
        cond={"$cond": {"if": {"$gt": ["$o_totalprice", 100000]}, "then": "big", "else": "small"}},
        sw={"$switch": {"branches": [{"case": {"$eq": ["$o_orderstatus", "O"]}, "then": 1}, {"case": {"$eq": ["$o_orderstatus", "F"]}, "then": 2}], "default": 3}},
        ifnull={"$ifNull": ["$absent", None, "$o_orderstatus"]}, let={"$let": {"vars": {"x": "$o_custkey", "y": 2}, "in": {"$multiply": ["$$x", "$$y"]}}},
        lit={"$literal": "$o_orderkey"}, const={"$const": 7}, same={"$expr": "$o_custkey"},
        get={"$getField": {"field": "b", "input": {"$setField": {"field": "b", "input": {"a": 1, "b": 2}, "value": "$o_custkey"}}}}, unset={"$type": {"$getField": {"field": "a", "input": {"$unsetField": {"field": "a", "input": {"a": 1, "b": 2}}}}}})],
    """SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS cond, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS sw, o_orderstatus AS ifnull, (o_custkey * 2)::BIGINT AS let,
       '$o_orderkey' AS lit, 7 AS const, o_custkey AS same, o_custkey AS get, 'missing' AS unset FROM orders""",
)
_COMPARE = dict(eq={"$eq": ["$o_orderstatus", "O"]}, ne={"$ne": ["$o_orderstatus", "O"]}, gt={"$gt": ["$o_totalprice", 100000]}, gte={"$gte": ["$o_custkey", 50]}, lt={"$lt": ["$o_orderkey", "$o_custkey"]}, lte={"$lte": ["$o_orderkey", 10]},
                cmp={"$cmp": ["$o_custkey", 75]}, types={"$lt": ["$o_orderkey", "$o_orderstatus"]}, none={"$eq": ["$absent", None]}, isin={"$in": ["$o_orderstatus", ["O", "P"]]}, both={"$and": [{"$gt": ["$o_custkey", 10]}, "$o_orderkey"]},
                either={"$or": [False, {"$eq": ["$o_custkey", 3]}]}, nope={"$not": [{"$gt": ["$o_custkey", 10]}]}, every={"$allElementsTrue": [[True, True]]}, some={"$anyElementTrue": [[False, {"$gt": ["$o_custkey", 100]}]]})
pipeline(
    "expr_compare", "orders", [fields(o_orderkey=1, **_COMPARE)],
    """SELECT o_orderkey, o_orderstatus = 'O' AS eq, o_orderstatus <> 'O' AS ne, o_totalprice > 100000 AS gt, o_custkey >= 50 AS gte, o_orderkey < o_custkey AS lt, o_orderkey <= 10 AS lte, (CASE WHEN o_custkey < 75 THEN -1 WHEN o_custkey = 75 THEN 0 ELSE 1 END)::INTEGER AS cmp,
       true AS types, true AS none, o_orderstatus IN ('O', 'P') AS isin, o_custkey > 10 AND o_orderkey <> 0 AS both, o_custkey = 3 AS either, NOT o_custkey > 10 AS nope, true AS every, o_custkey > 100 AS some FROM orders""",
)
pipeline(
    "expr_arithmetic", "lineitem",
    [fields(l_orderkey=1, l_linenumber=1, add={"$add": ["$l_quantity", "$l_tax", 1]}, sub={"$subtract": ["$l_orderkey", "$l_partkey"]}, mul={"$multiply": ["$l_extendedprice", "$l_discount"]}, div={"$divide": ["$l_extendedprice", "$l_quantity"]},
        mod={"$mod": ["$l_partkey", 7]}, neg={"$mod": [{"$subtract": [0, "$l_partkey"]}, 7]}, abs={"$abs": {"$subtract": ["$l_orderkey", "$l_partkey"]}}, ceil={"$ceil": "$l_extendedprice"}, floor={"$floor": "$l_extendedprice"}, round={"$round": ["$l_extendedprice", -2]}, trunc={"$trunc": ["$l_extendedprice", 1]},
        band={"$bitAnd": ["$l_partkey", 12]}, bor={"$bitOr": ["$l_partkey", 5]}, bxor={"$bitXor": ["$l_partkey", "$l_orderkey"]}, bnot={"$bitNot": "$l_partkey"})],
    """SELECT l_orderkey, l_linenumber, l_quantity + l_tax + 1 AS add, (l_orderkey - l_partkey)::BIGINT AS sub, l_extendedprice * l_discount AS mul, l_extendedprice / l_quantity AS div, (l_partkey % 7)::BIGINT AS mod, ((-l_partkey) % 7)::BIGINT AS neg, abs(l_orderkey - l_partkey)::BIGINT AS abs,
       ceil(l_extendedprice) AS ceil, floor(l_extendedprice) AS floor, round(l_extendedprice * 0.01) / 0.01 AS round, trunc(l_extendedprice * 10) / 10 AS trunc, (l_partkey & 12)::BIGINT AS band, (l_partkey | 5)::BIGINT AS bor, xor(l_partkey, l_orderkey)::BIGINT AS bxor, (~l_partkey)::BIGINT AS bnot FROM lineitem""",
)
_X = {"$divide": [{"$add": ["$p_size", 1]}, 60]}
_R = lambda e: {"$round": [e, 9]}
pipeline(
    "expr_transcendental", "part",
    [fields(p_partkey=1, exp=_R({"$exp": _X}), ln=_R({"$ln": "$p_retailprice"}), log=_R({"$log": ["$p_retailprice", 3]}), log10=_R({"$log10": "$p_retailprice"}), pow=_R({"$pow": [_X, 3]}), sqrt=_R({"$sqrt": "$p_retailprice"}),
        acos=_R({"$acos": _X}), acosh=_R({"$acosh": "$p_retailprice"}), asin=_R({"$asin": _X}), asinh=_R({"$asinh": _X}), atan=_R({"$atan": _X}), atan2=_R({"$atan2": [_X, "$p_size"]}), atanh=_R({"$atanh": _X}), cos=_R({"$cos": _X}), cosh=_R({"$cosh": _X}),
        sin=_R({"$sin": _X}), sinh=_R({"$sinh": _X}), tan=_R({"$tan": _X}), tanh=_R({"$tanh": _X}), rad=_R({"$degreesToRadians": "$p_size"}), deg=_R({"$radiansToDegrees": _X}), none={"$type": {"$exp": "$absent"}})],
    """WITH p AS (SELECT *, (p_size + 1) / 60.0::DOUBLE AS x FROM part)
       SELECT p_partkey, round(exp(x), 9) AS exp, round(ln(p_retailprice), 9) AS ln, round(ln(p_retailprice) / ln(3), 9) AS log, round(log10(p_retailprice), 9) AS log10, round(pow(x, 3), 9) AS pow, round(sqrt(p_retailprice), 9) AS sqrt, round(acos(x), 9) AS acos, round(acosh(p_retailprice), 9) AS acosh,
       round(asin(x), 9) AS asin, round(asinh(x), 9) AS asinh, round(atan(x), 9) AS atan, round(atan2(x, p_size), 9) AS atan2, round(atanh(x), 9) AS atanh, round(cos(x), 9) AS cos, round(cosh(x), 9) AS cosh, round(sin(x), 9) AS sin, round(sinh(x), 9) AS sinh, round(tan(x), 9) AS tan, round(tanh(x), 9) AS tanh,
       round(radians(p_size), 9) AS rad, round(degrees(x), 9) AS deg, 'missing' AS none FROM p""",
)
pipeline(
    "expr_strings", "part",
    [fields(p_partkey=1, concat={"$concat": ["$p_brand", "/", "$p_type"]}, lower={"$toLower": "$p_type"}, upper={"$toUpper": "$p_name"}, cmp={"$strcasecmp": ["$p_name", "$p_type"]}, bytes={"$strLenBytes": "$p_name"}, cps={"$strLenCP": "$p_name"}, bin={"$binarySize": "$p_name"},
        sub={"$substr": ["$p_type", 2, 3]}, subb={"$substrBytes": ["$p_type", 1, -1]}, subc={"$substrCP": ["$p_type", 1, 4]}, at={"$indexOfCP": ["$p_name", "a"]}, atb={"$indexOfBytes": ["$p_name", "e", 2]}, split={"$size": {"$split": ["$p_name", " "]}}, one={"$replaceOne": {"input": "$p_name", "find": "a", "replacement": "<>"}},
        all={"$replaceAll": {"input": "$p_name", "find": "a", "replacement": "<>"}}, trim={"$trim": {"input": {"$concat": ["  ", "$p_brand", " "]}}}, ltrim={"$ltrim": {"input": "$p_brand", "chars": "Br"}}, rtrim={"$rtrim": {"input": "$p_brand", "chars": "0123456789"}},
        match={"$regexMatch": {"input": "$p_name", "regex": "E", "options": "i"}})],
    """SELECT p_partkey, p_brand || '/' || p_type AS concat, lower(p_type) AS lower, upper(p_name) AS upper, (CASE WHEN lower(p_name) < lower(p_type) THEN -1 WHEN lower(p_name) > lower(p_type) THEN 1 ELSE 0 END)::INTEGER AS cmp, strlen(p_name)::BIGINT AS bytes, length(p_name)::BIGINT AS cps, strlen(p_name)::INTEGER AS bin,
       substr(p_type, 3, 3) AS sub, substr(p_type, 2) AS subb, substr(p_type, 2, 4) AS subc, (instr(p_name, 'a') - 1)::BIGINT AS at, (CASE WHEN instr(substr(p_name, 3), 'e') > 0 THEN instr(substr(p_name, 3), 'e') + 1 ELSE -1 END)::BIGINT AS atb, len(string_split(p_name, ' '))::BIGINT AS split,
       CASE WHEN instr(p_name, 'a') > 0 THEN substr(p_name, 1, instr(p_name, 'a') - 1) || '<>' || substr(p_name, instr(p_name, 'a') + 1) ELSE p_name END AS one, replace(p_name, 'a', '<>') AS all, p_brand AS trim, ltrim(p_brand, 'Br') AS ltrim, rtrim(p_brand, '0123456789') AS rtrim, regexp_matches(p_name, 'E', 'i') AS match FROM part""",
)
pipeline(
    "expr_regex", "part",
    [fields(p_partkey=1, f={"$regexFind": {"input": "$p_brand", "regex": "([A-Z])[a-z]+#(\\d)"}}, a={"$regexFindAll": {"input": "$p_brand", "regex": "\\d"}}), fields(p_partkey=1, found="$f.match", at="$f.idx", group={"$arrayElemAt": ["$f.captures", 1]}, n={"$size": "$a"}, last={"$let": {"vars": {"l": {"$last": "$a"}}, "in": "$$l.match"}})],
    "SELECT p_partkey, regexp_extract(p_brand, '([A-Z])[a-z]+#(\\d)') AS found, 0 AS at, regexp_extract(p_brand, '([A-Z])[a-z]+#(\\d)', 2) AS group, len(regexp_extract_all(p_brand, '\\d'))::BIGINT AS n, regexp_extract_all(p_brand, '\\d')[-1] AS last FROM part",
)
_T = {"$slice": ["$embedding", 8]}
pipeline(
    "expr_arrays", "embeddings",
    [
        {"$project": {"_id": 0, "vec_id": 1, "label": 1, "a": {"$map": {"input": "$embedding", "as": "x", "in": {"$toLong": {"$multiply": ["$$x", 100]}}}}}},
        fields(vec_id=1, at={"$arrayElemAt": ["$a", -2]}, first={"$first": "$a"}, last={"$last": "$a"}, size={"$size": "$a"}, isarr={"$isArray": "$a"}, pos={"$size": {"$filter": {"input": "$a", "as": "x", "cond": {"$gt": ["$$x", 0]}}}}, sum={"$reduce": {"input": "$a", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}},
            rev={"$arrayElemAt": [{"$reverseArray": "$a"}, 0]}, cat={"$size": {"$concatArrays": ["$a", [1, 2]]}}, idx={"$indexOfArray": ["$a", {"$arrayElemAt": ["$a", 3]}]}, rng={"$size": {"$range": [0, {"$size": "$a"}, 3]}}, slice={"$arrayElemAt": [{"$slice": ["$a", -3, 2]}, 0]},
            low={"$arrayElemAt": [{"$sortArray": {"input": "$a", "sortBy": 1}}, 0]}, zip={"$arrayElemAt": [{"$arrayElemAt": [{"$zip": {"inputs": ["$a", [7, 8, 9]]}}, 2]}, 1]}, f2={"$sum": {"$firstN": {"input": "$a", "n": 2}}}, l2={"$sum": {"$lastN": {"input": "$a", "n": 2}}}, m2={"$sum": {"$maxN": {"input": "$a", "n": 2}}}, n2={"$sum": {"$minN": {"input": "$a", "n": 2}}}),
    ],
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: trunc(x::DOUBLE * 100)::BIGINT) AS a FROM embeddings)
       SELECT vec_id, a[-2] AS at, a[1] AS first, a[-1] AS last, len(a)::BIGINT AS size, typeof(a) LIKE '%[]' AS isarr, len(list_filter(a, lambda x: x > 0))::BIGINT AS pos, list_sum(a)::BIGINT AS sum, list_reverse(a)[1] AS rev, len(list_concat(a, [1, 2]))::BIGINT AS cat, (list_position(a, a[4]) - 1)::BIGINT AS idx, len(range(0, len(a)::BIGINT, 3))::BIGINT AS rng, a[-3] AS slice, list_min(a) AS low, list_zip(a, [7, 8, 9])[3][2]::BIGINT AS zip,
       (a[1] + a[2])::BIGINT AS f2, (a[-1] + a[-2])::BIGINT AS l2, list_sum(list_sort(a, 'DESC')[1:2])::BIGINT AS m2, list_sum(list_sort(a)[1:2])::BIGINT AS n2 FROM e""",
)
_A, _B = {"$split": ["$p_name", " "]}, {"$split": ["$p_type", " "]}
pipeline(
    "expr_sets_objects", "part",
    [fields(p_partkey=1, union={"$size": {"$setUnion": [_A, ["x", "x"]]}}, inter={"$size": {"$setIntersection": [_A, ["widget", "small", "bolt"]]}}, diff={"$size": {"$setDifference": [_A, ["x"]]}}, equal={"$setEquals": [{"$reverseArray": [_A]}, ["small", "widget", "small"]]}, subset={"$setIsSubset": [_A, ["small", "large", "widget", "bolt"]]},
        pairs={"$size": {"$objectToArray": {"a": "$p_name", "b": "$p_type"}}}, back={"$getField": {"field": "k2", "input": {"$arrayToObject": [["k1", "$p_name"], ["k2", "$p_type"]]}}}, merged={"$getField": {"field": "b", "input": {"$mergeObjects": [{"a": 1, "b": "$p_name"}, None, {"b": "$p_type"}]}}})],
    """WITH p AS (SELECT *, string_split(p_name, ' ') AS a FROM part) SELECT p_partkey, len(list_distinct(list_append(a, 'x')))::BIGINT AS union, len(list_filter(list_distinct(a), lambda w: w IN ('widget', 'small', 'bolt')))::BIGINT AS inter, len(list_filter(list_distinct(a), lambda w: w <> 'x'))::BIGINT AS diff, len(list_distinct(a)) = 2 AND list_has_all(a, ['small', 'widget']) AS equal, list_has_all(['small', 'large', 'widget', 'bolt'], a) AS subset,
       2::BIGINT AS pairs, p_type AS back, p_type AS merged FROM p""",
)
pipeline(
    "expr_statistics", "embeddings",
    [
        fields(vec_id=1, sum=_R({"$sum": "$embedding"}), avg=_R({"$avg": "$embedding"}), min=_R({"$min": {"$map": {"input": "$embedding", "as": "x", "in": {"$toDouble": "$$x"}}}}), max=_R({"$max": {"$map": {"input": "$embedding", "as": "x", "in": {"$toDouble": "$$x"}}}}), pop=_R({"$stdDevPop": "$embedding"}), samp=_R({"$stdDevSamp": "$embedding"}),
            med=_R({"$median": {"input": "$embedding", "method": "continuous"}}), p90=_R({"$arrayElemAt": [{"$percentile": {"input": "$embedding", "p": [0.9], "method": "discrete"}}, 0]}), several={"$max": ["$label", 4, None]}),
    ],
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(list_sum(e), 9) AS sum, round(list_avg(e), 9) AS avg, round(list_min(e), 9) AS min, round(list_max(e), 9) AS max, round(list_stddev_pop(e), 9) AS pop, round(list_stddev_samp(e), 9) AS samp,
       round(list_aggregate(e, 'quantile_cont', 0.5), 9) AS med, round(list_sort(e)[ceil(len(e) * 0.9)::INTEGER], 9) AS p90, greatest(label, 4)::INTEGER AS several FROM e""",
)
_DATE = "$o_orderdate"
pipeline(
    "expr_date_parts", "orders",
    [fields(o_orderkey=1, y={"$year": _DATE}, m={"$month": _DATE}, d={"$dayOfMonth": _DATE}, h={"$hour": _DATE}, mi={"$minute": _DATE}, s={"$second": _DATE}, ms={"$millisecond": _DATE}, dow={"$dayOfWeek": _DATE}, doy={"$dayOfYear": _DATE}, w={"$week": _DATE}, idow={"$isoDayOfWeek": _DATE}, iw={"$isoWeek": _DATE}, iy={"$isoWeekYear": _DATE},
        local={"$hour": {"date": _DATE, "timezone": "+05:30"}}, parts={"$let": {"vars": {"p": {"$dateToParts": {"date": _DATE}}}, "in": {"$add": ["$$p.year", "$$p.month", "$$p.day"]}}}, isoparts={"$let": {"vars": {"p": {"$dateToParts": {"date": _DATE, "iso8601": True}}}, "in": {"$add": ["$$p.isoWeekYear", "$$p.isoWeek"]}}})],
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, hour(o_orderdate)::INTEGER AS h, minute(o_orderdate)::INTEGER AS mi, second(o_orderdate)::INTEGER AS s, (millisecond(o_orderdate) % 1000)::INTEGER AS ms, (dayofweek(o_orderdate) + 1)::INTEGER AS dow, dayofyear(o_orderdate)::INTEGER AS doy,
       strftime(o_orderdate, '%U')::INTEGER AS w, isodow(o_orderdate)::INTEGER AS idow, weekofyear(o_orderdate)::INTEGER AS iw, isoyear(o_orderdate)::BIGINT AS iy, hour(o_orderdate + INTERVAL 330 MINUTE)::INTEGER AS local, (year(o_orderdate) + month(o_orderdate) + day(o_orderdate))::BIGINT AS parts, (isoyear(o_orderdate) + weekofyear(o_orderdate))::BIGINT AS isoparts FROM orders""",
)
_TO = D(1998, 1, 31, 12)
pipeline(
    "expr_date_math", "orders",
    [fields(o_orderkey=1, plus={"$dateAdd": {"startDate": _DATE, "unit": "month", "amount": 1}}, minus={"$dateSubtract": {"startDate": _DATE, "unit": "hour", "amount": 36}}, days={"$dateDiff": {"startDate": _DATE, "endDate": _TO, "unit": "day"}}, hours={"$dateDiff": {"startDate": _DATE, "endDate": _TO, "unit": "hour"}}, years={"$dateDiff": {"startDate": _DATE, "endDate": _TO, "unit": "year"}},
        month={"$dateTrunc": {"date": _DATE, "unit": "month"}}, quarter={"$dateTrunc": {"date": _DATE, "unit": "quarter"}}, week={"$dateTrunc": {"date": _DATE, "unit": "week", "startOfWeek": "monday"}}, hour6={"$dateTrunc": {"date": _DATE, "unit": "hour", "binSize": 6}}, made={"$dateFromParts": {"year": {"$year": _DATE}, "month": {"$month": _DATE}, "day": 1, "hour": 5}},
        text={"$dateToString": {"date": _DATE, "format": "%Y/%m/%d %H:%M:%S.%L %j %G-%V-%u %U %b"}}, iso={"$dateToString": {"date": _DATE}}, back={"$dateFromString": {"dateString": {"$dateToString": {"date": _DATE, "format": "%d.%m.%Y"}}, "format": "%d.%m.%Y"}}, bad={"$dateFromString": {"dateString": "no date", "onError": D(2000, 1, 1)}})],
    """SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS plus, o_orderdate - INTERVAL 36 HOUR AS minus, date_diff('day', o_orderdate, TIMESTAMP '1998-01-31 12:00:00')::BIGINT AS days, trunc((epoch_ms(TIMESTAMP '1998-01-31 12:00:00') - epoch_ms(o_orderdate)) / 3600000)::BIGINT AS hours,
       date_sub('year', o_orderdate, TIMESTAMP '1998-01-31 12:00:00')::BIGINT AS years, date_trunc('month', o_orderdate)::TIMESTAMP AS month, date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, date_trunc('week', o_orderdate)::TIMESTAMP AS week, date_trunc('day', o_orderdate) + INTERVAL (hour(o_orderdate) // 6 * 6) HOUR AS hour6,
       date_trunc('month', o_orderdate) + INTERVAL 5 HOUR AS made, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S.') || lpad((millisecond(o_orderdate) % 1000)::VARCHAR, 3, '0') || strftime(o_orderdate, ' %j %G-%V-%u %U %b') AS text, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad((millisecond(o_orderdate) % 1000)::VARCHAR, 3, '0') || 'Z' AS iso,
       date_trunc('day', o_orderdate)::TIMESTAMP AS back, TIMESTAMP '2000-01-01' AS bad FROM orders""",
)
pipeline(
    "expr_convert", "customer",
    [fields(c_custkey=1, b={"$toBool": "$c_nationkey"}, i={"$toInt": "$c_acctbal"}, l={"$toLong": {"$toString": "$c_custkey"}}, d={"$toDouble": "$c_nationkey"}, s={"$toString": "$c_custkey"}, date={"$toDate": {"$multiply": ["$c_custkey", 86400000]}}, dec={"$toDouble": {"$toDecimal": "$c_nationkey"}}, oid={"$toObjectId": {"$concat": ["0123456789abcdef0123456", {"$toString": {"$mod": ["$c_custkey", 10]}}]}},
        conv={"$convert": {"input": "$c_name", "to": "int", "onError": -1}}, none={"$convert": {"input": "$absent", "to": "string", "onNull": "nil"}}, num={"$isNumber": "$c_acctbal"}, t={"$type": "$c_custkey"}, tm={"$type": "$absent"}, size={"$bsonSize": {"k": "$c_custkey", "n": "$c_name"}}, hash={"$toHashedIndexKey": "$absent"})],
    """SELECT c_custkey, c_nationkey <> 0 AS b, trunc(c_acctbal)::INTEGER AS i, c_custkey AS l, c_nationkey::DOUBLE AS d, c_custkey::VARCHAR AS s, make_timestamp((c_custkey * 86400000000)::BIGINT) AS date, c_nationkey::DOUBLE AS dec, '0123456789abcdef0123456' || (c_custkey % 10)::VARCHAR AS oid, -1 AS conv, 'nil' AS none, true AS num, 'long' AS t, 'missing' AS tm,
       (5 + 3 + 8 + 3 + 5 + strlen(c_name))::INTEGER AS size, 2338878944348059895::BIGINT AS hash FROM customer""",
)
pipeline("expr_timestamp", "events", [{"$project": {"_id": 0, "event_id": 1, "t": {"time": {"$toLong": "$user_id"}, "increment": "$event_id"}}}, fields(event_id=1, s={"$tsSecond": "$t"}, i={"$tsIncrement": "$t"})], "SELECT event_id, user_id AS s, event_id AS i FROM events")
pipeline("expr_rand", "nation", [fields(n_name=1, ok={"$let": {"vars": {"r": {"$rand": {}}}, "in": {"$and": [{"$gte": ["$$r", 0]}, {"$lt": ["$$r", 1]}]}}})], "SELECT n_name, true AS ok FROM nation")


@function("dynamic_fields", "SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN props->>'$.k' IS NULL THEN 'missing' ELSE 'long' END AS t FROM events WHERE (props->>'$.k')::BIGINT > 50")
def _dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A VARIANT column: fields of any type, found while the query runs."""
    events = read_tables(spark, sf_dir, ["events"])["events"].withColumn("props", F.parse_json("props"))
    return Database(spark, {"events": events})["events"].aggregate([{"$match": {"props.k": {"$gt": 50}}}, fields(event_id=1, k={"$add": ["$props.k", 0]}, t={"$type": "$props.k"}), {"$set": {"k": {"$toLong": "$k"}}}])


pipeline(
    "fill_linear", "events",
    [
        {"$set": {"v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, {"$multiply": ["$event_id", 2.0]}, None]}}},
        {"$fill": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"v": {"method": "linear"}}}},
        fields(event_id=1, v={"$cond": [{"$eq": ["$v", None]}, None, {"$round": ["$v", 6]}]}),
    ],
    """WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id END AS k FROM events), r AS (SELECT *, min(k) OVER (PARTITION BY user_id) AS low, max(k) OVER (PARTITION BY user_id) AS high FROM e)
       SELECT event_id, CASE WHEN event_id BETWEEN low AND high THEN event_id * 2.0::DOUBLE END AS v FROM r""",
)
pipeline(
    "stage_project_paths", "customer",
    [
        {"$replaceWith": {"_id": "$c_custkey", "a": {"b": {"c": "$c_name", "d": "$c_acctbal"}, "e": "$c_nationkey"}, "f": 1}},
        {"$project": {"a.b.c": 1, "a.e": 1}},
        {"$project": {"_id": 1, "c": "$a.b.c", "e": "$a.e", "gone": {"$type": "$a.b.d"}, "f": {"$type": "$f"}}},
    ],
    "SELECT c_custkey AS _id, c_name AS c, c_nationkey AS e, 'missing' AS gone, 'missing' AS f FROM customer",
)


# commands


@function("read_json_lines", "SELECT (props->>'$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text, written and read with a schema."""
    folder = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    read_tables(spark, sf_dir, ["events"])["events"].select("props").write.text(folder)
    return Database(spark, {"e": read_json(spark, folder, "k long")})["e"].aggregate([{"$group": {"_id": "$k", "n": {"$sum": 1}}}, fields(k="$_id", n=1)])


@function("command_insert", "SELECT c_custkey AS _id, c_name AS name FROM customer UNION ALL SELECT n_nationkey + 10000000, n_name FROM nation")
def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as the first rows, another as a delta beside them; a third that repeats keys is refused whole."""
    db = _database(spark, sf_dir, ("customer", "nation"))
    db["t"].insert(db["customer"].df.selectExpr("c_custkey AS _id", "c_name AS name"))
    db["t"].insert(db["nation"].df.selectExpr("n_nationkey + 10000000 AS _id", "n_name AS name"))
    try:
        db["t"].insert(db["nation"].df.selectExpr("n_nationkey + 10000024 AS _id", "n_name AS name"))
    except DuplicateKey:
        return db["t"].df
    raise AssertionError("a repeated key was inserted")


@function("command_update_kinds", """SELECT n_nationkey AS _id, CASE WHEN n_nationkey = 7 THEN 70 ELSE n_regionkey END::INTEGER AS region, CASE WHEN n_nationkey = 7 OR n_regionkey = 4 THEN NULL WHEN n_regionkey = 2 THEN n_name || '!' ELSE n_name END AS name FROM nation
       UNION ALL SELECT 99, 9, 'new'""")  # fmt: skip
def _update_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replacement, an update by a pipeline, a field unset, and an upsert."""
    db = _database(spark, sf_dir, ("nation",))
    db["nation"].aggregate([{"$replaceWith": {"_id": "$n_nationkey", "region": "$n_regionkey", "name": "$n_name"}}, {"$out": "t"}])
    db["t"].update({"region": 2}, [{"$set": {"name": {"$concat": ["$name", "!"]}}}], multi=True)
    db["t"].update({"_id": 7}, [{"$set": {"name": "seven"}}])
    db["t"].update({"_id": 7}, {"region": 70})
    db["t"].update({"region": 4}, {"$unset": {"name": ""}}, multi=True)
    db["t"].update({"_id": 99, "region": 9}, {"$set": {"name": "new"}}, upsert=True)
    return db["t"].df


@function("sink_merge_modes", """SELECT n_nationkey AS _id, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS tag, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS region FROM nation WHERE n_nationkey < 20""")
def _merge_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields merged into documents that match, others discarded; a merge that must not match is refused."""
    db = _database(spark, sf_dir, ("nation",))
    db["nation"].aggregate([{"$match": {"n_nationkey": {"$lt": 20}}}, {"$replaceWith": {"_id": "$n_nationkey", "tag": "old", "name": "$n_name"}}, {"$out": "t"}])
    db["nation"].aggregate([{"$match": {"n_nationkey": {"$mod": [2, 0]}}}, {"$replaceWith": {"_id": "$n_nationkey", "tag": "new", "region": "$n_regionkey"}}, {"$merge": {"into": "t", "whenMatched": "merge", "whenNotMatched": "discard"}}])
    try:
        db["nation"].aggregate([{"$match": {"n_nationkey": 3}}, {"$replaceWith": {"_id": "$n_nationkey", "tag": "bad"}}, {"$merge": {"into": "t", "whenMatched": "fail"}}])
    except MergeError:
        return db["t"].df
    raise AssertionError("a merge that matches was not refused")


def _told(spark: SparkSession, told: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in told.items()], "what string, told string")


@function("command_catalog", """SELECT 'rows' AS what, (SELECT count(*) FROM nation)::VARCHAR AS told UNION ALL SELECT * FROM (VALUES ('created', 'empty nation t'), ('indexes', '_id_ n_regionkey_1'), ('dropped', '_id_'), ('renamed', 'nation u'), ('databases', 'other test'),
       ('gone', 'True False'), ('after', ''), ('hello', 'True'), ('ping', '1.0'), ('build', '1.0'), ('sessions', '1.0'), ('parameters', 'authenticationMechanisms ok requireApiVersion'), ('fails', '91'), ('explained', 'True')) v(what, told)""")  # fmt: skip
def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, ("nation",))
    Database(spark, name="other", siblings=db.siblings)
    db["nation"].aggregate([{"$replaceWith": {"_id": "$n_nationkey", "n_regionkey": "$n_regionkey"}}, {"$out": "t"}])
    db.create("empty")
    told: dict[str, Any] = {"rows": db["t"].count(), "created": " ".join(db.list_collections())}
    db["t"].create_index({"n_regionkey": 1})
    told["indexes"] = " ".join(i["name"] for i in db["t"].list_indexes())
    db["t"].drop_index("n_regionkey_1")
    told["dropped"] = " ".join(i["name"] for i in db["t"].list_indexes())
    told["explained"] = "PushedFilters: [IsNotNull(n_regionkey), EqualTo(n_regionkey,1)]" in db["t"].explain([{"$match": {"n_regionkey": 1}}])
    db.rename("t", "u")
    db.drop("empty")
    told |= {"renamed": " ".join(db.list_collections()), "databases": " ".join(db.list_databases()), "gone": f"{db.drop('u')} {db.drop('u')}"}
    db.drop_database()
    told |= {"after": " ".join(db.list_collections()), "hello": db.hello()["isWritablePrimary"], "ping": db.ping()["ok"], "build": db.build_info()["ok"], "sessions": db.kill_all_sessions()["ok"], "parameters": " ".join(sorted(db.get_parameter()))}
    db.configure_fail_point("failCommand", {"times": 1}, {"failCommands": ["count"], "errorCode": 91})
    try:
        db["nation"].count()
    except FailPointEnabled as e:
        told["fails"] = e.code
    return _told(spark, told)


@function("command_cursor", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 7 AS batch, n_nationkey AS id FROM nation QUALIFY batch < 3")
def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of a cursor, which then is killed."""
    cursor = _database(spark, sf_dir, ("nation",))["nation"].cursor([{"$sort": {"n_nationkey": 1}}], batch=7)
    rows = [(b, r["n_nationkey"]) for b in range(3) for r in cursor.get_more()]
    cursor.kill()
    return spark.createDataFrame(rows + [(9, r["n_nationkey"]) for r in cursor.get_more()], "batch long, id int")


@function("change_stream_images", """SELECT n_nationkey AS id, n_regionkey AS before, n_regionkey + 10 AS after, (n_regionkey + 10)::VARCHAR AS updated FROM nation WHERE n_regionkey = 1""")
def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images before and after, in a stream that goes on after the last event of the first write."""
    db = _database(spark, sf_dir, ("nation",))
    db["t"].insert(db["nation"].df.selectExpr("n_nationkey AS _id", "n_regionkey AS region"))
    last = db["t"].aggregate([{"$changeStream": {}}]).agg(F.max("_id.seq")).first()[0]
    db["t"].update({"region": 1}, {"$inc": {"region": 10}}, multi=True)
    events = db["t"].aggregate([{"$changeStream": {"resumeAfter": {"seq": last}, "fullDocument": "required", "fullDocumentBeforeChange": "required"}}])
    whole = lambda c, path: F.try_variant_get(c, path, "int")
    updated = F.try_variant_get("updateDescription", "$.updatedFields.region", "string")
    return events.select(whole("documentKey", "$._id").alias("id"), whole("fullDocumentBeforeChange", "$.region").alias("before"), whole("fullDocument", "$.region").alias("after"), updated.alias("updated"))


@function("errors", """SELECT * FROM (VALUES ('stage', 'UnsupportedStage'), ('operator', 'UnsupportedOperator'), ('two stages in one', 'InvalidStage'), ('sort', 'InvalidStage'), ('limit', 'InvalidStage'), ('sample', 'InvalidStage'), ('mixed', 'MixedProjection'),
       ('update', 'InvalidUpdate'), ('id', 'InvalidUpdate'), ('index', 'InvalidArgument'), ('numbers', 'ExpectedNumeric'), ('merge', 'InvalidStage'), ('sibling', 'InvalidArgument')) v(what, told)""")  # fmt: skip
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and by which error, before any row is read."""
    db = _database(spark, sf_dir, ("nation",))
    c = db["nation"]
    asked = {
        "stage": lambda: c.aggregate([{"$absent": {}}]), "operator": lambda: c.aggregate([fields(x={"$absent": 1})]), "two stages in one": lambda: c.aggregate([{"$limit": 1, "$skip": 1}]),
        "sort": lambda: c.aggregate([{"$sort": {"n_name": 2}}]), "limit": lambda: c.aggregate([{"$limit": 1.5}]), "sample": lambda: c.aggregate([{"$sample": {"size": 0}}]), "mixed": lambda: c.aggregate([{"$project": {"n_name": 1, "n_regionkey": 0}}]),
        "update": lambda: c.update({}, {"$push": {"a": 1}}), "id": lambda: c.update({}, {"$set": {"_id": 1}}), "index": lambda: c.drop_index("_id_"), "numbers": lambda: c.aggregate([fields(x={"$add": ["$n_name", 1]})]),
        "merge": lambda: c.aggregate([{"$merge": {"into": "t", "whenMatched": "fail", "whenNotMatched": "discard"}}]), "sibling": lambda: db.sibling("none"),
    }
    told = {}
    for what, ask in asked.items():
        try:
            ask()
            told[what] = "nothing"
        except QueryError as e:
            told[what] = type(e).__name__
    return _told(spark, told)


@function("command_find", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 3")
def _find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _database(spark, sf_dir, ("customer",))["customer"].find({"c_mktsegment": "BUILDING"}, {"c_custkey": 1, "c_name": 1}, {"c_acctbal": -1, "c_custkey": 1}, 3, 10)


@function("command_distinct", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus = 'O'")
def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _database(spark, sf_dir, ("orders",))["orders"].distinct("o_orderpriority", {"o_orderstatus": "O"})


@function("command_count", "SELECT count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 100000")
def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _database(spark, sf_dir, ("orders",))["orders"].count({"o_totalprice": {"$gt": 100000}})
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@function("sink_out", "SELECT n_nationkey AS _id, n_name FROM nation WHERE n_regionkey = 2")
def _out(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, ("nation",))
    db["nation"].aggregate([{"$match": {"n_regionkey": 2}}, {"$project": {"_id": "$absent", "id": "$n_nationkey", "n_name": 1}}, {"$replaceWith": {"_id": "$id", "n_name": "$n_name"}}, {"$out": "copy"}])
    return db["copy"].df


@function("sink_merge", """SELECT c_custkey AS _id, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE 0 END AS bal, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS tag FROM customer""")
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, ("customer",))
    db["customer"].aggregate([{"$replaceWith": {"_id": "$c_custkey", "bal": {"$toDouble": 0}, "tag": "old"}}, {"$match": {"_id": {"$mod": [4, 0]}}}, {"$out": "t"}])
    db["customer"].aggregate([{"$replaceWith": {"_id": "$c_custkey", "bal": {"$toDouble": 0}, "tag": "old"}}, {"$merge": {"into": "t", "whenMatched": "keepExisting"}}])
    db["customer"].aggregate([{"$match": {"c_custkey": {"$mod": [2, 0]}}}, {"$replaceWith": {"_id": "$c_custkey", "bal": "$c_acctbal", "tag": "new"}}, {"$merge": {"into": "t", "on": "_id", "whenMatched": "replace", "whenNotMatched": "fail"}}])
    return db["t"].df


@function("command_updates", "SELECT n_nationkey AS _id, (n_regionkey + CASE WHEN n_regionkey = 1 THEN 10 ELSE 0 END)::INTEGER AS region, CASE WHEN n_regionkey = 1 THEN 'moved' END AS note FROM nation WHERE n_regionkey <> 3")
def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, ("nation",))
    db["nation"].aggregate([{"$replaceWith": {"_id": "$n_nationkey", "region": "$n_regionkey"}}, {"$out": "t"}])
    db["t"].update({"region": 1}, {"$set": {"note": "moved"}, "$inc": {"region": 10}}, multi=True)
    db["t"].delete({"region": 3})
    return db["t"].df


@function("change_stream", "SELECT 'update' AS op, count(*)::BIGINT AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'delete', count(*)::BIGINT FROM nation WHERE n_regionkey = 3")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, ("nation",))
    db["nation"].aggregate([{"$replaceWith": {"_id": "$n_nationkey", "region": "$n_regionkey"}}, {"$out": "t"}])
    db["t"].update({"region": 1}, {"$inc": {"region": 10}}, multi=True)
    db["t"].delete({"region": 3})
    return db["t"].aggregate([{"$changeStream": {"fullDocument": "updateLookup"}}, {"$changeStreamSplitLargeEvent": {}}, {"$group": {"_id": "$operationType", "n": {"$sum": 1}}}, fields(op="$_id", n=1)])


@function("system_stages", """SELECT * FROM (VALUES ('$collStats', 1), ('$indexStats', 1), ('$planCacheStats', 0), ('$currentOp', 1), ('$listCatalog', 1), ('$listClusterCatalog', 1), ('$listCachedAndActiveUsers', 0),
       ('$listLocalSessions', 0), ('$listSessions', 0), ('$listSampledQueries', 0), ('$listSearchIndexes', 0), ('$querySettings', 0), ('$listMqlEntities', 44)) v(stage, n)""")
def _system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each stage that reports on the engine gives."""
    db = _database(spark, sf_dir, ("nation",))
    asked = {"$collStats": {"count": {}}, "$indexStats": {}, "$planCacheStats": {}, "$currentOp": {"localOps": True}, "$listCatalog": {}, "$listClusterCatalog": {}, "$listCachedAndActiveUsers": {}, "$listLocalSessions": {}, "$listSessions": {}, "$listSampledQueries": {}, "$listSearchIndexes": {}, "$querySettings": {}, "$listMqlEntities": {"entityType": "aggregationStages"}}
    out: DataFrame | None = None
    for name, spec in asked.items():
        one = db["nation"].aggregate([{name: spec}]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionAll(one)
    return out
