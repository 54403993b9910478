"""Stages over ordered values and places: densify, fill, geoNear."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidStage
from docweave.functions.base import META, ROW_ID, Scope, compile_expression
from docweave.functions.dates import MICROS, MONTHS
from docweave.operators.base import stage
from docweave.operators.windows import _Windows, linear, sort_spec
from docweave.plans.filter import compile_filter
from docweave.plans.frame import Context, Frame, sort_columns
from docweave.plans.projection import columns, fields_of, put
from docweave.values import DOUBLE, LONG, Val, cast, common, is_stamp, literal

#: Steps of a grid that one row expands to at once.
_CHUNK = 1 << 16


def _plain(path: Any, what: str) -> str:
    if not isinstance(path, str) or not path or path.startswith("$") or "" in path.split("."):
        raise InvalidStage(f"{what} takes field names")
    return path


@stage("$densify")
def densify(spec: Any, frame: Frame, context: Context) -> Frame:
    """Rows for the steps that a partition lacks, counted from its lower bound; new rows hold only the partition's keys and the field."""
    if not isinstance(spec, dict) or not {"field", "range"} <= set(spec) <= {"field", "partitionByFields", "range"}:
        raise InvalidStage("$densify takes field, partitionByFields and range")
    field = _plain(spec["field"], "$densify")
    parts = [_plain(p, "$densify") for p in spec.get("partitionByFields", [])]
    if any(p == field or field.startswith(p + ".") or p.startswith(field + ".") for p in parts):
        raise InvalidStage("$densify: the field is no partition key")
    r = spec["range"]
    if not isinstance(r, dict) or not {"step", "bounds"} <= set(r) <= {"step", "bounds", "unit"}:
        raise InvalidStage("$densify: range takes step, bounds and unit")
    step, unit, bounds = r["step"], r.get("unit"), r["bounds"]
    if isinstance(step, bool) or not isinstance(step, int | float) or step <= 0:
        raise InvalidStage("$densify: step is a positive number")
    if unit is not None and (unit not in (*MICROS, *MONTHS) or step != int(step)):
        raise InvalidStage("$densify: unknown unit, or a broken number of units")
    explicit = isinstance(bounds, list)
    if explicit:
        wanted = dt.date if unit else int | float
        if len(bounds) != 2 or not all(isinstance(b, wanted) and not isinstance(b, bool) for b in bounds) or bounds[0] > bounds[1]:
            raise InvalidStage("$densify: bounds are two rising values of the field's type")
    elif bounds not in ("full", "partition") or (bounds == "partition" and not parts):
        raise InvalidStage("$densify: bounds are full, partition or two values")
    df = frame.ordered()
    scope = Scope(df.schema, context.variables)
    v = scope.field(field)
    if v.missing or not (v.date if unit else v.numeric):
        if v.missing or v.null:
            return Frame(df)
        raise InvalidStage("$densify: the field has another type than the range")
    keys = [scope.field(p) for p in parts]
    used = [(f"__k{i}", k) for i, k in enumerate(keys) if not k.missing]
    value = v.col.cast("timestamp") if unit else v.col.cast("double")
    base = df.select(value.alias("__v"), *[k.col.alias(n) for n, k in used])
    low, high = (literal(b).col.cast("timestamp" if unit else "double") for b in bounds) if explicit else (F.min("__v"), F.max("__v"))
    grouped = base.groupBy(*[n for n, _ in used]).agg(low.alias("__low"), high.alias("__high")).where("__low is not null and __low < __high")
    grid = _grid(grouped, step, unit)
    seen = base.where("__v is not null").distinct().withColumnsRenamed({n: f"{n}s" for n, _ in used} | {"__v": "__vs"})
    on = F.col("__new") == F.col("__vs")
    for n, _ in used:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}s"))
    fresh = grid.join(seen, on, "left_anti")
    kind = v.type if unit else (v.type if isinstance(v.type, T.LongType) else common([v.type, LONG if float(step).is_integer() and v.integral else DOUBLE]))
    if not unit and v.integral and not float(step).is_integer():
        kind = DOUBLE
    fields: dict[str, Val] = {}
    for (n, k), p in zip(used, [p for p, k in zip(parts, keys, strict=True) if not k.missing], strict=True):
        fields = put(fields, p, Val(F.col(n), k.type))
    fields = put(fields, field, Val(F.col("__new").cast(kind), kind))
    made = fresh.select(*columns(fields))
    from docweave.operators.joins import _union

    out = _union(df.drop(*[c for c in (META, ROW_ID) if c in df.columns]), made)
    order = sort_columns({**{p: 1 for p in parts}, field: 1}, Scope(out.schema))
    return Frame(out, tuple(order))


def _grid(bounds: DataFrame, step: int | float, unit: str | None) -> DataFrame:
    """bounds (__low, __high, keys) with every step __new from __low on, below __high. Long grids come apart in two turns, so no row holds them whole."""
    if unit in MONTHS:
        # steps follow one another: after 31 January and 29 February comes 29 March
        months = int(step) * MONTHS[unit]
        count = F.ceil(F.months_between("__high", "__low") / months).cast("int") + 2
        walked = F.aggregate(F.sequence(F.lit(1), count), F.array("__low"), lambda a, i: F.concat(a, F.array(F.timestamp_add("MONTH", F.lit(months), F.element_at(a, -1)))))
        return bounds.withColumn("__new", F.explode(walked)).where("__new < __high")
    if unit:
        size = int(step) * MICROS[unit]
        count = F.ceil((F.unix_micros("__high") - F.unix_micros("__low")) / size).cast("long")
        place = lambda i: F.timestamp_micros(F.unix_micros("__low") + i * size)
    else:
        count = F.ceil((F.col("__high") - F.col("__low")) / float(step)).cast("long")
        place = lambda i: F.col("__low") + i * F.lit(float(step))
    counted = bounds.withColumn("__n", count)
    chunks = counted.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / _CHUNK))))
    steps = chunks.withColumn("__i", F.explode(F.sequence(F.col("__c") * _CHUNK, F.least((F.col("__c") + 1) * _CHUNK, F.col("__n")) - 1)))
    return steps.withColumn("__new", place(F.col("__i"))).where("__new < __high").drop("__n", "__c", "__i")


@stage("$fill")
def fill(spec: Any, frame: Frame, context: Context) -> Frame:
    if not isinstance(spec, dict) or not {"output"} <= set(spec) <= {"partitionBy", "partitionByFields", "sortBy", "output"} or not isinstance(spec["output"], dict) or not spec["output"]:
        raise InvalidStage("$fill takes partitionBy, partitionByFields, sortBy and output")
    if "partitionBy" in spec and "partitionByFields" in spec:
        raise InvalidStage("$fill takes one kind of partition")
    methods, values = {}, {}
    for name, o in spec["output"].items():
        if not isinstance(o, dict) or len(o) != 1 or not set(o) <= {"method", "value"}:
            raise InvalidStage("$fill: an output has a method or a value")
        if "value" in o:
            values[name] = o["value"]
        elif o["method"] in ("locf", "linear"):
            methods[name] = o["method"]
        else:
            raise InvalidStage("$fill: unknown method")
    sort = sort_spec(spec["sortBy"]) if "sortBy" in spec else {}
    if "linear" in methods.values() and len(sort) != 1:
        raise InvalidStage("$fill: linear needs one sort field")
    df = frame.numbered() if methods else frame.df
    scope = Scope(df.schema, context.variables)
    if "partitionByFields" in spec:
        keys = [scope.field(_plain(p, "$fill")) for p in spec["partitionByFields"]]
    else:
        keys = [compile_expression(spec["partitionBy"], scope)] if spec.get("partitionBy") is not None else []
    work = _Windows(df, scope, [k.col for k in keys if not k.null], sort_columns(sort, scope), sort)
    made: dict[str, Val] = {}
    for name, method in methods.items():
        v = scope.field(name)
        if v.null:
            continue
        if method == "locf":
            made[name] = Val(F.last(v.col, True).over(work.rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)), v.type)
        else:
            made[name] = linear(work, v, next(iter(sort)))
    fields = {k: v for k, v in fields_of(work.df.schema).items() if not k.startswith("__w")}
    for name, v in made.items():
        fields = put(fields, name, v)
    out = work.df.select(*columns(fields))
    for name, e in values.items():
        inner = Scope(out.schema, context.variables)
        old, new = inner.field(name), compile_expression(e, inner)
        kind = common([old.type, new.type])
        out = out.select(*columns(put(fields_of(out.schema), name, Val(F.coalesce(cast(old, kind), cast(new, kind)), kind))))
    return Frame(out.drop(ROW_ID) if methods else out, frame.order if not methods else ())


# places

EARTH = 6378137.0


def _point(value: Any) -> tuple[float, float]:
    if isinstance(value, dict):
        if value.get("type") != "Point":
            raise InvalidStage("$geoNear: near is a point")
        value = value.get("coordinates")
    if not isinstance(value, list) or len(value) != 2 or not all(isinstance(x, int | float) and not isinstance(x, bool) for x in value):
        raise InvalidStage("$geoNear: near is a point")
    return float(value[0]), float(value[1])


def _place(v: Val) -> tuple[Column, Column, Column] | None:
    """x, y and whether a value is a point; None if its type is none."""
    if v.array and isinstance(v.type.elementType, T.NumericType):
        return F.get(v.col, F.lit(0)).cast("double"), F.get(v.col, F.lit(1)).cast("double"), F.coalesce(F.size(v.col) == 2, F.lit(False))
    if isinstance(v.type, T.StructType) and not is_stamp(v.type) and {"type", "coordinates"} <= set(v.type.names):
        inner = _place(Val(v.col["coordinates"], v.type["coordinates"].dataType))
        if inner is not None:
            return inner[0], inner[1], F.coalesce((v.col["type"] == "Point") & inner[2], F.lit(False))
    return None


@stage("$geoNear", source=False)
def geo_near(spec: Any, frame: Frame, context: Context) -> Frame:
    allowed = {"near", "distanceField", "maxDistance", "minDistance", "query", "spherical", "distanceMultiplier", "includeLocs", "key"}
    if not isinstance(spec, dict) or not {"near"} <= set(spec) <= allowed:
        raise InvalidStage("$geoNear: unknown option")
    x, y = _point(spec["near"])
    for k in ("maxDistance", "minDistance", "distanceMultiplier"):
        if k in spec and (isinstance(spec[k], bool) or not isinstance(spec[k], int | float)):
            raise InvalidStage(f"$geoNear: {k} is a number")
    multiplier = float(spec.get("distanceMultiplier", 1.0))
    if multiplier < 0 or not isinstance(spec.get("spherical", False), bool):
        raise InvalidStage("$geoNear: distanceMultiplier is not negative and spherical is a boolean")
    df = frame.df
    if "query" in spec:
        df = df.where(compile_filter(spec["query"], Scope(df.schema, context.variables)))
    scope = Scope(df.schema, context.variables)
    candidates = [spec["key"]] if "key" in spec else [n for n in df.columns if n not in ("_id", META, ROW_ID)]
    found = [(scope.field(n), p) for n in candidates if (p := _place(scope.field(n))) is not None]
    if not found:
        if "key" in spec and not scope.field(spec["key"]).missing:
            raise InvalidStage("$geoNear: the key is no point")
        return Frame(df.where(F.lit(False)))
    # the first field of a row that is a point
    px = py = source = None
    v, (ax, ay, ok) = found[0]
    kind = v.type
    if "key" in spec:
        ok = F.when(v.col.isNotNull() & ~ok, F.raise_error(F.lit("$geoNear: not a point")).cast("boolean")).otherwise(ok)
    px, py, source, is_point = F.when(ok, ax), F.when(ok, ay), F.when(ok, v.col), ok
    for other, (bx, by, good) in found[1:]:
        px, py, is_point = px.when(good, bx), py.when(good, by), is_point | good
        if other.type == kind:
            source = source.when(good, other.col)
    if spec.get("spherical", False):
        lat1, lon1, lat2, lon2 = F.radians(F.lit(y)), F.radians(F.lit(x)), F.radians(py), F.radians(px)
        half = lambda a, b: F.pow(F.sin((b - a) / 2), 2)
        h = half(lat1, lat2) + F.cos(lat1) * F.cos(lat2) * half(lon1, lon2)
        distance = F.lit(EARTH) * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    else:
        distance = F.sqrt((F.lit(x) - px) * (F.lit(x) - px) + (F.lit(y) - py) * (F.lit(y) - py))
    out = df.where(is_point).withColumn("__d", distance).withColumn("__p", source)
    if "minDistance" in spec:
        out = out.where(F.col("__d") >= float(spec["minDistance"]))
    if "maxDistance" in spec:
        out = out.where(F.col("__d") <= float(spec["maxDistance"]))
    shown = Val(F.col("__d") * multiplier, DOUBLE)
    fields = {k: f for k, f in fields_of(out.schema).items() if k not in ("__d", "__p", META)}
    if "distanceField" in spec:
        fields = put(fields, _plain(spec["distanceField"], "$geoNear"), shown)
    if "includeLocs" in spec:
        fields = put(fields, _plain(spec["includeLocs"], "$geoNear"), Val(F.col("__p"), kind))
    meta = F.struct(shown.col.alias("geoNearDistance"), F.col("__p").alias("geoNearPoint"), F.col("__d").alias("order"))
    made = out.select(*columns(fields), meta.alias(META))
    return Frame(made.orderBy(F.col(META)["order"]))
