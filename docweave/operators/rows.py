"""Stages that pick rows: match, sort, limit, skip, sample, count, unwind, literal rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidStage, UnsupportedStage
from docweave.functions.base import META, OWNER, ROW_ID
from docweave.operators.base import stage
from docweave.plans.filter import compile_filter
from docweave.plans.frame import Context, Frame, apart, owned, sort_columns
from docweave.values import cast, common, literal, quoted


@stage("$match")
def match(spec: Any, frame: Frame, context: Context) -> Frame:
    return Frame(frame.df.where(compile_filter(spec, frame.scope(context))), frame.order)


def direction(way: Any) -> int:
    if isinstance(way, bool) or way not in (1, -1):
        raise InvalidStage("a sort direction is 1 or -1")
    return int(way)


@stage("$sort")
def sort(spec: Any, frame: Frame, context: Context) -> Frame:
    if not isinstance(spec, dict) or not spec:
        raise InvalidStage("$sort takes fields and directions")
    keys = sort_columns({k: direction(w) for k, w in spec.items()}, frame.scope(context))
    if not keys:
        return frame
    if owned(frame.df):
        return Frame(frame.df, tuple(keys) + frame.order)
    # what stands in an order already keeps it among equals
    return Frame(frame.df.orderBy(*keys, *frame.order))


def _length(spec: Any, name: str) -> int:
    if isinstance(spec, bool) or not isinstance(spec, int | float) or spec != int(spec):
        raise InvalidStage(f"{name} takes an integer")
    return max(0, int(spec))


@stage("$limit")
def limit(spec: Any, frame: Frame, context: Context) -> Frame:
    n = _length(spec, "$limit")
    return _places(frame, lambda place: place <= n) if owned(frame.df) else Frame(frame.ordered().limit(n))


def _places(frame: Frame, keep) -> Frame:
    """Rows by their place among those of the same owner."""
    df = frame.numbered()
    over = Window.partitionBy(OWNER).orderBy(*frame.order, F.col(ROW_ID))
    kept = df.withColumn("__place", F.row_number().over(over)).where(keep(F.col("__place"))).drop("__place", ROW_ID)
    return Frame(kept, frame.order)


@stage("$skip")
def skip(spec: Any, frame: Frame, context: Context) -> Frame:
    n = _length(spec, "$skip")
    return _places(frame, lambda place: place > n) if owned(frame.df) else Frame(frame.ordered().offset(n))


@stage("$sample")
def sample(spec: Any, frame: Frame, context: Context) -> Frame:
    if not isinstance(spec, dict) or set(spec) != {"size"}:
        raise InvalidStage("$sample takes a size")
    if isinstance(spec["size"], bool) or not isinstance(spec["size"], int) or spec["size"] < 1:
        raise InvalidStage("$sample takes a size of 1 or more")
    if owned(frame.df):
        raise UnsupportedStage("$sample does not draw for each row of an outer pipeline")
    if frame.df.limit(spec["size"] + 1).count() <= spec["size"]:  # all rows, in their order
        return frame
    # a top-n by a random key: no global sort
    drawn = frame.df.withColumn("__draw", F.rand()).orderBy("__draw").limit(spec["size"])
    return Frame(drawn.drop("__draw"))


@stage("$count")
def count(spec: Any, frame: Frame, context: Context) -> Frame:
    if not isinstance(spec, str) or not spec or spec.startswith("$") or "." in spec:
        raise InvalidStage("$count takes a field name")
    if owned(frame.df):
        return Frame(frame.df.groupBy(*apart(frame.df)).agg(F.count(F.lit(1)).alias(spec)))
    return Frame(frame.df.agg(F.count(F.lit(1)).alias(spec)))


@stage("$unwind")
def unwind(spec: Any, frame: Frame, context: Context) -> Frame:
    """Only arrays come apart: other values are dropped, or kept as they are with preserveNullAndEmptyArrays."""
    options = spec if isinstance(spec, dict) else {"path": spec}
    if not set(options) <= {"path", "preserveNullAndEmptyArrays", "includeArrayIndex"} or not isinstance(options.get("path"), str) or not options["path"].startswith("$"):
        raise InvalidStage("$unwind takes a path")
    preserve = options.get("preserveNullAndEmptyArrays", False)
    if not isinstance(preserve, bool):
        raise InvalidStage("$unwind: preserveNullAndEmptyArrays is a boolean")
    from docweave.plans.projection import columns, fields_of, put

    path = options["path"][1:]
    v = frame.scope(context).field(path)
    df = frame.df
    if not v.array:
        return Frame(df if preserve else df.where(F.lit(False)), frame.order)
    item = "__item"
    exploded = df.withColumn(item, F.explode_outer(v.col) if preserve else F.explode(v.col))
    if "." not in path:
        return Frame(exploded.select(*[(quoted(item) if c == path else quoted(c)).alias(c) for c in df.columns]), frame.order)
    from docweave.values import Val

    fields = put({k: x for k, x in fields_of(exploded.schema).items() if k != item}, path, Val(quoted(item), v.type.elementType))
    return Frame(exploded.select(*columns(fields)), frame.order)


@stage("$documents", source=True)
def documents(spec: Any, frame: Frame | None, context: Context) -> Frame:
    """Literal rows. Their fields may be expressions of constants."""
    if frame is not None and not context.nested:
        raise InvalidStage("$documents needs no collection")
    return Frame(literal_rows(spec, context))


def literal_rows(rows: Any, context: Context):
    from docweave.functions.base import Scope, compile_expression

    spark = context.database.spark
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise InvalidStage("$documents takes an array of documents")
    if not rows:
        return spark.range(0).select()
    empty = Scope(T.StructType([]), context.variables)
    compiled = [{k: compile_expression(v, empty) if _computed(v) else literal(v) for k, v in r.items()} for r in rows]
    names = list(dict.fromkeys(k for r in compiled for k in r))
    kinds = {n: common([r[n].type for r in compiled if n in r]) for n in names}
    structs = [F.struct(F.lit(i).cast("long").alias(ROW_ID), *[(cast(r[n], kinds[n]) if n in r else F.lit(None).cast(kinds[n])).alias(n) for n in names]) for i, r in enumerate(compiled)]
    made = spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    return made.drop(ROW_ID, META)


def _computed(v: Any) -> bool:
    if isinstance(v, str):
        return v.startswith("$")
    if isinstance(v, dict):
        return any(k.startswith("$") or _computed(x) for k, x in v.items())
    return isinstance(v, list) and any(_computed(x) for x in v)
