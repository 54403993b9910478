"""Stages that report on the engine itself, and the change stream."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidArgument, InvalidStage
from docweave.operators.base import STAGES, stage
from docweave.plans.frame import Context, Frame
from docweave.streaming.changestream import change_stream, split_large_events


def _rows(context: Context, rows: list[dict], schema: str) -> Frame:
    """A bounded table of facts about the engine."""
    return Frame(context.database.spark.createDataFrame([tuple(r.get(f.name) for f in T.StructType.fromDDL(schema)) for r in rows], schema))


def _document(spec: Any, allowed: dict[str, type | tuple]) -> dict:
    if not isinstance(spec, dict):
        raise InvalidStage("the stage takes a document")
    for k, v in spec.items():
        if k not in allowed or not isinstance(v, allowed[k]) or allowed[k] is not bool and isinstance(v, bool):
            raise InvalidStage(f"no such option, or of another type: {k}")
    return spec


@stage("$collStats", source=True)
def coll_stats(spec: Any, frame: Frame, context: Context) -> Frame:
    _document(spec, {"count": dict, "storageStats": dict})
    if spec.get("count"):
        raise InvalidStage("count takes an empty document")
    name = context.collection or ""
    out = frame.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{context.database.name}.{name}").alias("ns"), F.lit("spark").alias("host"), F.current_timestamp().alias("localTime"), "n")
    if "storageStats" in spec:
        storage = _document(spec["storageStats"], {"scale": int, "verbose": bool, "waitForLock": bool, "numericOnly": bool})
        scale = storage.get("scale", 1)
        if scale <= 0:
            raise InvalidStage("scale is positive")
        size = context.database.store.size(name) if name and name not in context.database.tables else 0
        indexes = 1 + len(context.database.indexes.get(name, {}))
        out = out.withColumn("storageStats", F.struct(F.col("n").alias("count"), F.lit(size // scale).cast("long").alias("size"), F.lit(indexes).alias("nindexes"), F.lit(scale).cast("long").alias("scaleFactor")))
    if "count" in spec:
        out = out.withColumn("count", F.col("n"))
    return Frame(out.drop("n"))


@stage("$indexStats", source=True)
def index_stats(spec: Any, frame: Frame, context: Context) -> Frame:
    _document(spec, {})
    rows = [{"name": i["name"], "key": i["key"], "unique": i["name"] == "_id_" or bool(i.get("unique")), "ops": 0, "host": "spark"} for i in context.database[context.collection or ""].list_indexes()]
    return _rows(context, rows, "name string, key map<string,int>, unique boolean, ops long, host string")


@stage("$planCacheStats", source=True)
def plan_cache_stats(spec: Any, frame: Frame, context: Context) -> Frame:
    """Plans are made anew for each query, so the cache is empty."""
    if _document(spec, {"allHosts": bool}).get("allHosts"):
        raise InvalidStage("allHosts is not supported")
    return _rows(context, [], "namespace string, filterShape string, sortShape string, projectionShape string, sequence long, host string")


@stage("$currentOp", source=True)
def current_op(spec: Any, frame: Frame | None, context: Context) -> Frame:
    if _document(spec, {"localOps": bool}).get("localOps") is not True:
        raise InvalidStage("$currentOp takes localOps: true")
    return _rows(context, [{"type": "op", "ns": "admin.$cmd.aggregate", "command": "aggregate"}], "type string, ns string, command string")


def _namespaces(context: Context) -> list[tuple[str, str]]:
    if context.collection:
        return [(context.database.name, context.collection)]
    return [(d, c) for d, db in sorted(context.database.siblings.items()) for c in db.list_collections()]


@stage("$listCatalog", source=True)
def list_catalog(spec: Any, frame: Frame | None, context: Context) -> Frame:
    _document(spec, {})
    rows = [{"db": d, "ns": f"{d}.{c}", "name": c, "type": "collection", "indexCount": len(context.database.sibling(d)[c].list_indexes())} for d, c in _namespaces(context)]
    return _rows(context, rows, "db string, ns string, name string, type string, indexCount long")


@stage("$listClusterCatalog", source=True)
def list_cluster_catalog(spec: Any, frame: Frame | None, context: Context) -> Frame:
    options = _document(spec, {"shards": bool, "tracked": bool, "balancingConfiguration": bool})
    schema = "db string, ns string, type string, readOnly boolean, sharded boolean" + (", tracked boolean" if options.get("tracked") else "") + (", shards array<string>" if options.get("shards") else "")
    rows = [{"db": d, "ns": f"{d}.{c}", "type": "collection", "readOnly": False, "sharded": False, "tracked": False, "shards": []} for d, c in _namespaces(context)]
    return _rows(context, rows, schema)


def _sessions(spec: Any) -> None:
    if not isinstance(spec, dict) or not set(spec) <= {"allUsers", "users"}:
        raise InvalidStage("the stage takes allUsers or users")
    users = spec.get("users", [])
    if not isinstance(spec.get("allUsers", False), bool) or not isinstance(users, list) or any(not isinstance(u, dict) or set(u) != {"user", "db"} for u in users):
        raise InvalidStage("users are documents of user and db")
    if spec.get("allUsers") and users:
        raise InvalidStage("allUsers and users exclude each other")


@stage("$listSessions", "$listLocalSessions", source=True)
def list_sessions(spec: Any, frame: Frame | None, context: Context) -> Frame:
    _sessions(spec)
    return _rows(context, [], "_id string, lastUse timestamp")


@stage("$listCachedAndActiveUsers", source=True)
def list_users(spec: Any, frame: Frame | None, context: Context) -> Frame:
    _document(spec, {})
    return _rows(context, [], "username string, db string, active boolean")


@stage("$listSampledQueries", source=True)
def list_sampled_queries(spec: Any, frame: Frame | None, context: Context) -> Frame:
    namespace = _document(spec, {"namespace": str}).get("namespace")
    if namespace is not None and (not all(namespace.partition(".")[::2]) or "\0" in namespace):
        raise InvalidStage("a namespace is database.collection")
    return _rows(context, [], "_id string, ns string")


@stage("$listSearchIndexes", source=True)
def list_search_indexes(spec: Any, frame: Frame, context: Context) -> Frame:
    if len(_document(spec, {"id": str, "name": str})) > 1:
        raise InvalidArgument("name and id exclude each other")
    return _rows(context, [], "id string, name string")


@stage("$querySettings", source=True)
def query_settings(spec: Any, frame: Frame | None, context: Context) -> Frame:
    _document(spec, {"showDebugQueryShape": bool})
    return _rows(context, [], "queryShapeHash string, settings string")


@stage("$listMqlEntities", source=True)
def list_entities(spec: Any, frame: Frame | None, context: Context) -> Frame:
    if spec != {"entityType": "aggregationStages"}:
        raise InvalidStage("$listMqlEntities takes entityType: aggregationStages")
    return _rows(context, [{"name": n} for n in sorted(STAGES)], "name string")


@stage("$changeStream", source=True)
def change_stream_stage(spec: Any, frame: Frame | None, context: Context) -> Frame:
    return Frame(change_stream(spec, context), (F.col("_id"),))


@stage("$changeStreamSplitLargeEvent")
def split_stage(spec: Any, frame: Frame, context: Context) -> Frame:
    if spec != {}:
        raise InvalidStage("$changeStreamSplitLargeEvent takes an empty document")
    return Frame(split_large_events(frame.df), (F.col("_id"),))


