"""Stages that gather documents: group, sortByCount, bucket, bucketAuto, facet."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidStage, UnsupportedOperator, UnsupportedStage
from docweave.functions.base import ROW_ID, Scope, compile_expression
from docweave.operators.base import SINKS, run_pipeline, stage
from docweave.plans.frame import Context, Frame, apart, owned, ranked, visible, whole
from docweave.values import Val, literal, order, quoted, rank

ACCUMULATORS = ("$sum", "$avg", "$first", "$push", "$addToSet")


def _accumulator(name: str, spec: Any) -> tuple[str, Any]:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise InvalidStage(f"'{name}' needs one accumulator")
    ((op, e),) = spec.items()
    if op not in ACCUMULATORS:
        raise UnsupportedOperator(op)
    return op, e


def _strict(v: Val, op: str) -> Column:
    """Doubles; what is no number is an error while the query runs."""
    wrong = F.raise_error(F.lit(f"{op}: expected numeric value")).cast("double")
    return F.coalesce(v.col.cast("double"), wrong) if v.numeric else wrong


def _needs_order(outputs: dict[str, tuple[str, Any]]) -> bool:
    return any(op in ("$first", "$push", "$addToSet") for op, _ in outputs.values())


def accumulated(outputs: dict[str, tuple[str, Any]], scope: Scope) -> list[Column]:
    """An aggregate for each output, named in the order of names."""
    made = []
    for name in sorted(outputs):
        op, e = outputs[name]
        if op == "$sum" and isinstance(e, int | float) and not isinstance(e, bool):
            total = F.count(F.lit(1)) * F.lit(e)
            made.append((total.cast("long") if isinstance(e, int) else total).alias(name))
            continue
        v = compile_expression(e, scope)
        if op == "$sum":
            total = F.sum(_strict(v, op))
            made.append((total.cast("long") if v.integral else total).alias(name))
        elif op == "$avg":
            made.append(F.avg(_strict(v, op)).alias(name))
        elif op == "$first":
            made.append(F.min_by(F.struct(v.col.alias("v")), F.col(ROW_ID)).getField("v").alias(name))
        else:
            listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ROW_ID).alias("i"), v.col.alias("v")))), lambda x: x["v"])
            made.append((listed if op == "$push" else F.array_distinct(listed)).alias(name))
    return made


def group(df: DataFrame, key: Column, outputs: dict[str, tuple[str, Any]], context: Context) -> DataFrame:
    """(_id, outputs by name). Partial aggregation happens before the shuffle."""
    made = accumulated(outputs, Scope(df.schema, context.variables))
    kept = apart(df)
    grouped = df.groupBy(key.alias("_id"), *kept)
    return grouped.agg(*made) if made else df.select(key.alias("_id"), *kept).distinct()


@stage("$group")
def group_stage(spec: Any, frame: Frame, context: Context) -> Frame:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise InvalidStage("$group needs an _id")
    outputs = {k: _accumulator(k, v) for k, v in spec.items() if k != "_id"}
    if any("." in k or k.startswith("$") for k in outputs):
        raise InvalidStage("$group: outputs have plain names")
    df = frame.numbered() if _needs_order(outputs) else frame.df
    v = compile_expression(spec["_id"], Scope(df.schema, context.variables))
    key = F.lit(None).cast("string") if v.null else v.col
    return Frame(group(df, key, outputs, context), _by_id(v))


def _by_id(v: Val) -> tuple[Column, ...]:
    return () if v.null or isinstance(v.type, T.MapType | T.VariantType) else (F.col("_id"),)


@stage("$sortByCount")
def sort_by_count(spec: Any, frame: Frame, context: Context) -> Frame:
    if not (isinstance(spec, str) and spec.startswith("$") or isinstance(spec, dict) and spec):
        raise InvalidStage("$sortByCount takes an expression")
    v = compile_expression(spec, frame.scope(context))
    key = F.lit(None).cast("string") if v.null else v.col
    counted = frame.df.groupBy(key.alias("_id"), *apart(frame.df)).agg(F.count(F.lit(1)).alias("count"))
    order = (F.col("count").desc(), *_by_id(v))
    return Frame(counted, order) if owned(frame.df) else Frame(counted.orderBy(*order))


@stage("$bucket")
def bucket(spec: Any, frame: Frame, context: Context) -> Frame:
    if not isinstance(spec, dict) or not {"groupBy", "boundaries"} <= set(spec) <= {"groupBy", "boundaries", "default", "output"}:
        raise InvalidStage("$bucket takes groupBy, boundaries, default and output")
    bounds = [_constant(b) for b in spec["boundaries"]] if isinstance(spec["boundaries"], list) else []
    if len(bounds) < 2 or len({rank(b.type) for b in bounds}) > 1 or any(not a.const < b.const for a, b in zip(bounds, bounds[1:], strict=False)):
        raise InvalidStage("$bucket: boundaries rise and have one type")
    outputs = _outputs(spec)
    other = _constant(spec["default"]) if "default" in spec else None
    if other is not None and rank(other.type) == rank(bounds[0].type) and bounds[0].const <= other.const < bounds[-1].const:
        raise InvalidStage("$bucket: default lies outside the boundaries")
    df = frame.numbered() if _needs_order(outputs) else frame.df
    v = compile_expression(spec["groupBy"], Scope(df.schema, context.variables))
    # keys are places in the list, so that the default may be of another type
    place = None
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        within = ~order(v, low)[1] & order(v, high)[1]
        place = F.when(within, i) if place is None else place.when(within, i)
    place = place.otherwise(F.lit(-1) if other is not None else F.raise_error(F.lit("$bucket: a value lies in no bucket and there is no default")).cast("int"))
    grouped = group(df, place, outputs, context)
    from docweave.values import cast, common

    kinds = [b.type for b in bounds] + ([other.type] if other is not None else [])
    try:
        kind = common(kinds)
    except Exception:
        kind = T.StringType()
    named = F.element_at(F.array(*[cast(b, kind) for b in bounds]), F.greatest(F.col("_id"), F.lit(0)) + 1)
    if other is not None:
        named = F.when(F.col("_id") < 0, cast(other, kind)).otherwise(named)
    out = grouped.select(named.alias("_id"), *[quoted(c) for c in grouped.columns if c != "_id"])
    return Frame(out, (F.col("_id"),))


def _constant(e: Any) -> Val:
    return literal(e["$literal"] if isinstance(e, dict) and set(e) == {"$literal"} else e)


def _outputs(spec: dict) -> dict[str, tuple[str, Any]]:
    if "output" not in spec:
        return {"count": ("$sum", 1)}
    if not isinstance(spec["output"], dict):
        raise InvalidStage("output takes accumulators")
    return {k: _accumulator(k, v) for k, v in spec["output"].items()}


@stage("$bucketAuto")
def bucket_auto(spec: Any, frame: Frame, context: Context) -> Frame:
    """Buckets of equal counts along the sorted values; ranks come from a sort by ranges, so no task holds all rows."""
    if not isinstance(spec, dict) or not {"groupBy", "buckets"} <= set(spec) <= {"groupBy", "buckets", "output"}:
        raise InvalidStage("$bucketAuto takes groupBy, buckets and output")
    if owned(frame.df):
        raise UnsupportedStage("$bucketAuto in a correlated pipeline")
    n = spec["buckets"]
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise InvalidStage("$bucketAuto: buckets is a positive integer")
    outputs = _outputs(spec)
    df = frame.numbered()
    v = compile_expression(spec["groupBy"], Scope(df.schema, context.variables))
    key, place = "__key", "__place"
    keyed = df.withColumn(key, v.col if not v.null else F.lit(None).cast("string"))
    ordered, total = ranked(keyed, [F.col(key).asc_nulls_first(), F.col(ROW_ID)], place)
    small, extra = divmod(total, n)
    # the first `extra` buckets hold one row more
    edge = extra * (small + 1)
    bucket_of = F.when(F.col(place) < edge, F.floor(F.col(place) / max(1, small + 1))).otherwise(extra + F.floor((F.col(place) - edge) / max(1, small)))
    numbered = ordered.withColumn("__bucket", bucket_of.cast("long"))
    made = accumulated(outputs, Scope(numbered.schema, context.variables))
    grouped = numbered.groupBy("__bucket").agg(F.min_by(F.struct(F.col(key).alias("v")), F.col(place))["v"].alias("__min"), F.max_by(F.struct(F.col(key).alias("v")), F.col(place))["v"].alias("__max"), *made)
    # a row for each bucket: the window below is small
    after = F.lead(F.struct("__min")).over(_over("__bucket"))
    top = F.when(after.isNotNull(), after["__min"]).otherwise(F.col("__max"))
    out = grouped.select(F.struct(F.col("__min").alias("min"), top.alias("max")).alias("_id"), *[quoted(c) for c in grouped.columns if not c.startswith("__")])
    return Frame(out, (F.col("_id"),))


def _over(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(column)


@stage("$facet")
def facet(spec: Any, frame: Frame, context: Context) -> Frame:
    """One document with an array for each pipeline, all over the same rows."""
    if not isinstance(spec, dict) or not spec:
        raise InvalidStage("$facet takes pipelines")
    if owned(frame.df):
        raise UnsupportedStage("$facet in a correlated pipeline")
    out: DataFrame | None = None
    for name, pipeline in spec.items():
        if not name or name.startswith("$") or "." in name:
            raise InvalidStage("$facet: outputs have plain names")
        if not isinstance(pipeline, list) or any(not isinstance(s, dict) or set(s) & ({"$facet", "$documents", "$changeStream", "$geoNear"} | SINKS) for s in pipeline):
            raise InvalidStage("$facet: a pipeline holds no facet, source or sink")
        made = run_pipeline(pipeline, frame, context.inside("$facet"))
        rows = made.numbered()
        kind = T.ArrayType(T.StructType([f for f in visible(rows).schema]))
        listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ROW_ID).alias("i"), whole(rows).alias("v")))), lambda x: x["v"])
        one = rows.agg(F.coalesce(listed, F.array().cast(kind)).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row on each side
    return Frame(out)


