"""$changeStream: a bounded read of the change log that was there when the query began, or the same events as a stream."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import ChangeStreamFatalError, InvalidArgument, InvalidStage
from docweave.functions.convert import encoded_size
from docweave.values import Timestamp, Val, quoted

if TYPE_CHECKING:
    from docweave.plans.frame import Context

_FULL = ("default", "updateLookup", "whenAvailable", "required")
_BEFORE = ("off", "whenAvailable", "required")
#: Bytes that an event may have before it is split.
LIMIT = 16 << 20


def parse(spec: Any, context: Context) -> dict:
    allowed = {"resumeAfter", "startAfter", "startAtOperationTime", "fullDocument", "fullDocumentBeforeChange", "allChangesForCluster", "showExpandedEvents"}
    if not isinstance(spec, dict) or not set(spec) <= allowed or len(set(spec) & {"resumeAfter", "startAfter", "startAtOperationTime"}) > 1:
        raise InvalidStage("$changeStream: unknown options, or several places to start at")
    if spec.get("fullDocument", "default") not in _FULL or spec.get("fullDocumentBeforeChange", "off") not in _BEFORE:
        raise InvalidStage("$changeStream: unknown mode")
    if any(not isinstance(spec.get(k, False), bool) for k in ("allChangesForCluster", "showExpandedEvents")):
        raise InvalidStage("$changeStream: a switch is a boolean")
    if "startAtOperationTime" in spec and not isinstance(spec["startAtOperationTime"], Timestamp):
        raise InvalidStage("$changeStream: startAtOperationTime is a timestamp")
    if spec.get("allChangesForCluster") and not (context.database.name == "admin" and context.collection is None):
        raise InvalidStage("$changeStream: all changes are seen from admin only")
    token = spec.get("resumeAfter", spec.get("startAfter"))
    if token is not None and (not isinstance(token, dict) or not {"seq"} <= set(token) <= {"seq", "fragmentNum"}):
        raise InvalidStage("$changeStream: a token is a document with seq")
    return spec


def shaped(events: DataFrame, spec: dict, context: Context) -> DataFrame:
    """Log rows as change events, of this namespace and from the start asked for. Works on streams as well."""
    if not spec.get("allChangesForCluster"):
        events = events.where(F.col("database") == context.database.name)
        if context.collection is not None:
            events = events.where(F.col("collection") == context.collection)
    if not spec.get("showExpandedEvents"):
        events = events.where("not expanded")
    if "startAtOperationTime" in spec:
        at = spec["startAtOperationTime"]
        events = events.where((F.col("clusterTime.time") > at.time) | ((F.col("clusterTime.time") == at.time) & (F.col("clusterTime.increment") >= at.increment)))
    token = spec.get("resumeAfter", spec.get("startAfter"))
    if token is not None:
        events = events.where(F.col("seq") >= token["seq"] if "fragmentNum" in token else F.col("seq") > token["seq"])
    full, before = spec.get("fullDocument", "default"), spec.get("fullDocumentBeforeChange", "off")
    shown = F.col("operationType").isin("insert", "replace") | ((F.col("operationType") == "update") & F.lit(full != "default"))
    document = F.when(shown, _required("fullDocument") if full == "required" else F.col("fullDocument"))
    columns = [
        F.struct("seq").alias("_id"), "operationType", "clusterTime", "wallTime", F.struct(F.col("database").alias("db"), F.col("collection").alias("coll")).alias("ns"),
        F.try_parse_json("documentKey").alias("documentKey"), F.try_parse_json("updateDescription").alias("updateDescription"), F.try_parse_json(document).alias("fullDocument"),
    ]
    if before != "off":
        image = _required("fullDocumentBeforeChange") if before == "required" else F.col("fullDocumentBeforeChange")
        columns.append(F.try_parse_json(image).alias("fullDocumentBeforeChange"))
    return events.select(*columns, F.try_parse_json("extraFields").alias("extraFields"))


def _required(name: str) -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"change stream event is missing a required {name}")).cast("string"))


def change_stream(spec: Any, context: Context) -> DataFrame:
    spec = parse(spec, context)
    log = context.database.changes.read()
    token = spec.get("resumeAfter", spec.get("startAfter"))
    if token is not None and not log.where(F.col("seq") == token["seq"]).limit(1).count():
        raise InvalidArgument("the resume token is not in the change log")
    out = shaped(log, spec, context)
    if token is not None and "fragmentNum" in token:
        # what is left of a split event begins after the fragment of the token
        out = out.withColumn("__skip", F.when(F.col("_id.seq") == token["seq"], token["fragmentNum"] + 1).otherwise(0))
    return out


def read_stream(spec: Any, context: Context, **options: Any) -> DataFrame:
    """The same events as a Structured Streaming source over the log's folder."""
    from docweave.sources.changes import LOG, SCHEMA

    store = context.database.store
    stream = context.database.spark.readStream.schema(SCHEMA).options(**options).parquet(f"{store.folder}/{LOG}")
    return shaped(stream, parse(spec, context), context)


def split_large_events(df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Events above the limit as fragments of whole fields, packed by rising size; _id gains fragmentNum, splitEvent tells fragment and of."""
    skip = "__skip" in df.columns
    if not skip and any(f.name == "fragmentNum" for f in df.schema["_id"].dataType if isinstance(df.schema["_id"].dataType, T.StructType)):
        raise ChangeStreamFatalError("the events are split already")
    names = [c for c in df.columns if c not in ("_id", "__skip")]
    size = lambda n: F.octet_length(F.to_json(F.col(n))) if isinstance(df.schema[n].dataType, T.VariantType) else encoded_size(Val(quoted(n), df.schema[n].dataType))
    fields = F.array(*[F.struct(F.coalesce(size(n), F.lit(0)).cast("long").alias("size"), F.lit(n).alias("name"), quoted(n).isNotNull().alias("there")) for n in names])
    present = F.array_sort(F.filter(fields, lambda f: f["there"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.map_from_entries(F.array().cast("array<struct<key:string,value:int>>")).alias("of"))

    def pack(s: Column, f: Column) -> Column:
        too_large = F.raise_error(F.lit("a field alone exceeds the size of an event")).cast("long")
        own = F.when(f["size"] > limit, too_large).otherwise(f["size"])
        new = s["used"] + own > limit
        n = F.when(new, s["n"] + 1).otherwise(s["n"])
        return F.struct(n.alias("n"), F.when(new, own).otherwise(s["used"] + own).alias("used"), F.map_concat(s["of"], F.create_map(f["name"], n)).alias("of"))

    packed = df.withColumn("__p", F.aggregate(present, start, pack))
    of = F.col("__p.n") + 1
    parts = packed.withColumn("__f", F.explode(F.sequence(F.lit(0), F.col("__p.n"))))
    if skip:
        parts = parts.where(F.col("__f") >= F.col("__skip"))
    own = lambda n: F.when((of == 1) | (F.try_element_at(F.col("__p.of"), F.lit(n)) == F.col("__f")), quoted(n)).alias(n)
    token = F.struct(F.col("_id.seq").alias("seq"), F.when(of > 1, F.col("__f")).alias("fragmentNum")).alias("_id")
    split = F.when(of > 1, F.struct((F.col("__f") + 1).alias("fragment"), of.alias("of"))).alias("splitEvent")
    return parts.select(token, *[own(n) for n in names], split)
