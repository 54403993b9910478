"""Arrays, sets, objects, and accumulators over the values of one document."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import ExpectedDocument, InvalidArgument
from docweave.functions.base import Scope, arguments, array_of, array_operand, compile_expression, guard, operator, options, reject, single, unwrap, variadic, walk, whole
from docweave.functions.core import bound, variable_name
from docweave.values import BOOL, DOUBLE, INT, LONG, NULL, STRING, Val, cast, common, literal, missing, null, order, truthy


def bind(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


# elements


@operator("$arrayElemAt")
def _elem_at(name: str, e: Any, scope: Scope) -> Val:
    a, i = (compile_expression(x, scope) for x in arguments(name, e, 2))
    if a.null or i.null:
        return null()
    a = array_operand(name, a, scope)
    at = whole(name, "index", i, scope)
    return Val(F.get(a.col, F.when(at < 0, F.size(a.col) + at).otherwise(at)), a.type.elementType)


@operator("$first", "$last")
def _end(name: str, e: Any, scope: Scope) -> Val:
    a = compile_expression(e, scope)
    if a.null:
        return null()
    a = array_operand(name, a, scope)
    return Val(F.get(a.col, F.lit(0) if name == "$first" else F.size(a.col) - 1), a.type.elementType)


@operator("$firstN", "$lastN", "$maxN", "$minN")
def _n_of(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("input", "n"), ("input", "n"))
    a = array_operand(name, compile_expression(e["input"], scope), scope, "error")
    n = whole(name, "n", compile_expression(e["n"], scope), scope, 1)
    if name in ("$maxN", "$minN"):
        real = F.filter(a.col, lambda x: x.isNotNull())
        return Val(F.slice(F.sort_array(real, name == "$minN"), F.lit(1), n), a.type)
    if name == "$firstN":
        return Val(F.slice(a.col, F.lit(1), n), a.type)
    return Val(F.slice(a.col, F.greatest(F.size(a.col) - n, F.lit(0)) + 1, n), a.type)


@operator("$size")
def _size(name: str, e: Any, scope: Scope) -> Val:
    return Val(F.size(array_operand(name, compile_expression(e, scope), scope, "error").col).cast("long"), LONG)


@operator("$isArray")
def _is_array(name: str, e: Any, scope: Scope) -> Val:
    v = compile_expression(e, scope)
    if v.dynamic:
        return Val(F.coalesce(F.schema_of_variant(v.col).startswith("ARRAY"), F.lit(False)), BOOL)
    return Val(v.col.isNotNull() if v.array and not v.literal else F.lit(v.array), BOOL)


@operator("$slice")
def _slice(name: str, e: Any, scope: Scope) -> Val:
    args = arguments(name, e, 2, 3)
    a = array_operand(name, compile_expression(args[0], scope), scope)
    size = F.size(a.col)
    if len(args) == 2:
        n = whole(name, "n", compile_expression(args[1], scope), scope)
        made = F.when(n >= 0, F.slice(a.col, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.slice(a.col, F.greatest(size + n, F.lit(0)) + 1, F.least(-n, size)))
    else:
        at = whole(name, "position", compile_expression(args[1], scope), scope)
        n = whole(name, "n", compile_expression(args[2], scope), scope, 1)
        made = F.slice(a.col, F.when(at < 0, F.greatest(size + at, F.lit(0))).otherwise(at) + 1, n)
    return Val(F.when(a.col.isNotNull(), made), a.type)


@operator("$reverseArray")
def _reverse(name: str, e: Any, scope: Scope) -> Val:
    a = array_operand(name, compile_expression(unwrap(e), scope), scope)
    return Val(F.reverse(a.col), a.type)


@operator("$concatArrays")
def _concat(name: str, e: Any, scope: Scope) -> Val:
    values = [compile_expression(x, scope) for x in variadic(e)]
    if any(v.null for v in values):
        return null()
    values = [array_operand(name, v, scope) for v in values]
    if not values:
        return literal([])
    kind = common([v.type for v in values])
    return Val(F.concat(*[cast(v, kind) for v in values]), kind)


@operator("$range")
def _range(name: str, e: Any, scope: Scope) -> Val:
    args = [compile_expression(x, scope) for x in arguments(name, e, 2, 3)]
    start, end = (whole(name, w, v, scope) for w, v in zip(("start", "end"), args, strict=False))
    step = whole(name, "step", args[2], scope) if len(args) > 2 else F.lit(1)
    some = ((step > 0) & (start < end)) | ((step < 0) & (start > end))
    made = F.when(some, F.sequence(start, F.when(some, end - F.signum(step).cast("int")).otherwise(start), F.when(some, step).otherwise(F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return Val(guard(scope, step == 0, "$range: step must not be 0", made), T.ArrayType(INT))


@operator("$indexOfArray")
def _index_of(name: str, e: Any, scope: Scope) -> Val:
    args = [compile_expression(x, scope) for x in arguments(name, e, 2, 4)]
    if args[0].null:
        return null()
    a = array_operand(name, args[0], scope)
    start = whole(name, "start", args[2], scope, 0) if len(args) > 2 else F.lit(0)
    end = whole(name, "end", args[3], scope, 0) if len(args) > 3 else F.size(a.col)
    hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a.col) - 1, F.lit(0))), lambda i: (i >= start) & (i < end) & (i < F.size(a.col)) & order(Val(F.get(a.col, i), a.type.elementType), args[1])[0])
    return Val(F.when(a.col.isNotNull(), F.coalesce(F.get(hits, F.lit(0)), F.lit(-1)).cast("long")), LONG)


@operator("$map")
def _map(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("input", "as", "in"), ("input", "in"))
    a = array_operand(name, compile_expression(e["input"], scope), scope)
    as_ = variable_name(e.get("as", "this"))
    kind: list[T.DataType] = []

    def body(x: Column) -> Column:
        v = bound(compile_expression(e["in"], scope.bind(**{as_: Val(x, a.type.elementType)})))
        kind.append(v.type)
        return v.col

    return Val(F.transform(a.col, body), T.ArrayType(kind[-1] if kind else NULL))


@operator("$filter")
def _filter(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("input", "as", "cond", "limit"), ("input", "cond"))
    a = array_operand(name, compile_expression(e["input"], scope), scope)
    as_ = variable_name(e.get("as", "this"))
    made = F.filter(a.col, lambda x: truthy(compile_expression(e["cond"], scope.bind(**{as_: Val(x, a.type.elementType)}))))
    if "limit" in e:
        limit = compile_expression(e["limit"], scope)
        if not limit.null:
            made = F.slice(made, F.lit(1), whole(name, "limit", limit, scope, 1))
    return Val(made, a.type)


@operator("$reduce")
def _reduce(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("input", "initialValue", "in"), ("input", "initialValue", "in"))
    a = array_operand(name, compile_expression(e["input"], scope), scope)
    first = compile_expression(e["initialValue"], scope)
    # the accumulator's type is that of the body, which depends on it: widen until both agree
    kind = first.type if not first.null else a.type.elementType
    for _ in range(4):
        seen: list[Val] = []
        acc_type = kind

        def probe(acc: Column, x: Column) -> Column:
            seen.append(compile_expression(e["in"], scope.bind(value=Val(acc, acc_type), this=Val(x, a.type.elementType))))  # noqa: B023
            return F.lit(0)

        F.aggregate(F.array(F.lit(0)), F.lit(0), probe)
        wider = common([kind, seen[-1].type])
        if wider == kind:
            break
        kind = wider
    made = F.aggregate(a.col, cast(first, kind), lambda acc, x: cast(compile_expression(e["in"], scope.bind(value=Val(acc, kind), this=Val(x, a.type.elementType))), kind))
    return Val(made, kind)


def sort_comparator(kind: T.DataType, keys: list[tuple[list[str], int]]):
    """A comparator over elements for array_sort, by paths and directions; no path means the whole element."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for path, way in reversed(keys):
            equal, less = order(walk(Val(a, kind), path), walk(Val(b, kind), path))
            out = F.when(less, F.lit(-way)).when(~equal, F.lit(way)).otherwise(out)
        return out.cast("int")

    return compare


@operator("$sortArray")
def _sort(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("input", "sortBy"), ("input", "sortBy"))
    a = array_operand(name, compile_expression(e["input"], scope), scope)
    by = e["sortBy"]
    if by in (1, -1) and not isinstance(by, bool):
        keys = [([], int(by))]
    elif isinstance(by, dict) and by and all(w in (1, -1) for w in by.values()):
        if not isinstance(a.type.elementType, T.StructType):
            return reject(scope, InvalidArgument("$sortArray: all elements must be documents"))
        keys = [(k.split("."), int(w)) for k, w in by.items()]
    else:
        raise InvalidArgument("$sortArray: sortBy is 1, -1 or a document of those")
    return Val(F.array_sort(a.col, sort_comparator(a.type.elementType, keys)), a.type)


@operator("$zip")
def _zip(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("inputs", "useLongestLength", "defaults"), ("inputs",))
    if not isinstance(e["inputs"], list) or not e["inputs"]:
        raise InvalidArgument("$zip: inputs must be arrays")
    longest = e.get("useLongestLength", False)
    if not isinstance(longest, bool) or ("defaults" in e and not longest):
        raise InvalidArgument("$zip: defaults need useLongestLength: true")
    values = [array_operand(name, compile_expression(x, scope), scope) for x in e["inputs"]]
    if any(v.type.elementType == NULL and v.const is None for v in values):
        return null()
    defaults = [compile_expression(x, scope) for x in e["defaults"]] if "defaults" in e else [null()] * len(values)
    if len(defaults) != len(values):
        raise InvalidArgument("$zip: as many defaults as inputs")
    kind = common([v.type.elementType for v in values] + [d.type for d in defaults])
    sizes = [F.size(v.col) for v in values]
    n = sizes[0] if len(sizes) == 1 else (F.greatest if longest else F.least)(*sizes)
    pick = lambda v, d, i: F.when(i < F.size(v.col), cast(Val(F.get(v.col, i), v.type.elementType), kind)).otherwise(cast(d, kind))
    rows = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n), lambda i: F.array(*[pick(v, d, i) for v, d in zip(values, defaults, strict=True)]))
    some = reduce(lambda a, b: a & b, [v.col.isNotNull() for v in values])
    return Val(F.when(some, rows), T.ArrayType(T.ArrayType(kind)))


# sets


def _set_operands(name: str, e: Any, scope: Scope, nullish: str) -> list[Val] | None:
    values = [compile_expression(x, scope) for x in variadic(e)]
    if nullish == "null" and any(v.null for v in values):
        return None
    values = [array_operand(name, v, scope, nullish) for v in values]
    kind = common([v.type for v in values]) if values else T.ArrayType(NULL)
    return [Val(cast(v, kind), kind) for v in values]


@operator("$setUnion", "$setIntersection", "$setDifference")
def _set(name: str, e: Any, scope: Scope) -> Val:
    if name == "$setDifference":
        arguments(name, e, 2)
    values = _set_operands(name, e, scope, "null")
    if values is None:
        return null()
    if not values:
        return literal([])
    join = {"$setUnion": F.array_union, "$setIntersection": F.array_intersect, "$setDifference": F.array_except}[name]
    if values[0].type.elementType == NULL:
        return values[0]
    return Val(reduce(lambda a, b: join(a, b), [v.col for v in values[1:]], F.array_distinct(values[0].col)), values[0].type)


@operator("$setEquals", "$setIsSubset")
def _set_test(name: str, e: Any, scope: Scope) -> Val:
    arguments(name, e, 2, 2 if name == "$setIsSubset" else 1000)
    values = _set_operands(name, e, scope, "error")
    within = lambda a, b: F.size(F.array_except(a.col, b.col)) == 0
    if values[0].type.elementType == NULL:
        return Val(F.lit(True), BOOL)
    if name == "$setIsSubset":
        return Val(within(*values), BOOL)
    return Val(reduce(lambda a, b: a & b, [within(values[0], v) & within(v, values[0]) for v in values[1:]]), BOOL)


# objects


@operator("$objectToArray")
def _to_pairs(name: str, e: Any, scope: Scope) -> Val:
    v = compile_expression(e, scope)
    if v.null:
        return null()
    if isinstance(v.type, T.MapType):
        kind = T.ArrayType(T.StructType([T.StructField("k", STRING), T.StructField("v", v.type.valueType)]))
        return Val(F.transform(F.map_entries(v.col), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"))), kind)
    if not isinstance(v.type, T.StructType):
        return reject(scope, ExpectedDocument("$objectToArray takes a document"))
    if not len(v.type):
        return literal([])
    kind = common([f.dataType for f in v.type])
    pairs = F.array(*[F.struct(F.lit(f.name).alias("k"), cast(Val(v.col.getField(f.name), f.dataType), kind).alias("v")) for f in v.type])
    # a NULL field is a missing one
    made = F.filter(pairs, lambda p: p["v"].isNotNull())
    return Val(F.when(v.col.isNotNull(), made), T.ArrayType(T.StructType([T.StructField("k", STRING), T.StructField("v", kind)])))


@operator("$arrayToObject")
def _from_pairs(name: str, e: Any, scope: Scope) -> Val:
    # as-is, but [x] of one operand that is no pair is taken as x
    v = compile_expression(unwrap(e) if isinstance(e, list) and len(e) == 1 and isinstance(e[0], str | dict) else e, scope)
    if v.null:
        return null()
    v = array_operand(name, v, scope)
    item = v.type.elementType
    if isinstance(item, T.ArrayType) and isinstance(item.elementType, T.StringType):
        pairs, kind = F.transform(v.col, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))), STRING
    elif isinstance(item, T.StructType) and item.names == ["k", "v"]:
        pairs, kind = F.transform(v.col, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))), item["v"].dataType
    else:
        return reject(scope, InvalidArgument("$arrayToObject takes pairs [k, v] or documents {k, v}"))
    # the later of two equal keys wins
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return Val(F.map_from_entries(last), T.MapType(STRING, kind))


@operator("$mergeObjects")
def _merge(name: str, e: Any, scope: Scope) -> Val:
    values = [v for v in (compile_expression(x, scope) for x in variadic(e)) if not v.null]
    if not values:
        return literal({})
    if any(isinstance(v.type, T.MapType) for v in values):
        if not all(isinstance(v.type, T.MapType) for v in values):
            return reject(scope, InvalidArgument("$mergeObjects: documents of fixed and of free fields do not merge"))
        kind = values[-1].type
        merged = values[0].col
        for v in values[1:]:
            later = F.coalesce(v.col, F.create_map().cast(kind))
            merged = F.map_concat(F.map_filter(F.coalesce(merged, F.create_map().cast(kind)), lambda k, x, later=later: ~F.map_contains_key(later, k)), later)
        return Val(merged, kind)
    if not all(isinstance(v.type, T.StructType) for v in values):
        return reject(scope, ExpectedDocument("$mergeObjects takes documents"))
    names = list(dict.fromkeys(n for v in values for n in v.type.names))
    fields = []
    for n in names:
        own = [Val(v.col.getField(n), v.type[n].dataType) for v in reversed(values) if n in v.type.names]
        kind = common([o.type for o in own])
        fields.append((T.StructField(n, kind), F.coalesce(*[cast(o, kind) for o in own]).alias(n)))
    return Val(F.struct(*[c for _, c in fields]), T.StructType([f for f, _ in fields])) if fields else literal({})


# accumulators over one document


def _samples(name: str, e: Any, scope: Scope) -> Val:
    """The operand's elements if it is one array, else the operands."""
    args = variadic(e)
    values = [compile_expression(x, scope) for x in args]
    if len(values) == 1 and values[0].array:
        return values[0]
    if len(values) == 1 and values[0].null:
        return Val(F.array().cast("array<double>"), T.ArrayType(DOUBLE))
    real = [v for v in values if not v.null]
    numbers = [v for v in real if v.numeric]
    if name in ("$min", "$max"):
        return array_of(real) if real else Val(F.array().cast("array<double>"), T.ArrayType(DOUBLE))
    return array_of(numbers) if numbers else Val(F.array().cast("array<double>"), T.ArrayType(DOUBLE))


def _doubles(a: Val) -> Column:
    """The numbers of an array as doubles; all else is left out."""
    if not isinstance(a.type.elementType, T.NumericType):
        return F.array().cast("array<double>")
    return F.filter(F.coalesce(a.col.cast("array<double>"), F.array().cast("array<double>")), lambda x: x.isNotNull())


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


@operator("$sum", "$avg")
def _sum_avg(name: str, e: Any, scope: Scope) -> Val:
    a = _samples(name, e, scope)
    total = bind(_doubles(a), lambda d: F.struct(_sum(d).alias("s"), F.size(d).alias("n")))
    if name == "$sum":
        integral = isinstance(a.type.elementType, T.IntegralType)
        return Val(total["s"].cast("long") if integral else total["s"], LONG if integral else DOUBLE)
    return Val(F.when(total["n"] > 0, total["s"] / F.greatest(total["n"], F.lit(1))), DOUBLE)


@operator("$min", "$max")
def _extreme(name: str, e: Any, scope: Scope) -> Val:
    a = _samples(name, e, scope)
    real = F.filter(a.col, lambda x: x.isNotNull())
    if isinstance(a.type.elementType, T.DoubleType | T.FloatType):
        # NaN is the least here, whereas Spark ranks it highest
        numbers = F.filter(real, lambda x: ~F.isnan(x))
        has_nan = F.exists(real, F.isnan)
        nan = F.lit(float("nan"))
        if name == "$min":
            return Val(F.when(has_nan, nan).otherwise(F.array_min(numbers)), a.type.elementType)
        return Val(F.coalesce(F.array_max(numbers), F.when(has_nan, nan)), a.type.elementType)
    return Val((F.array_min if name == "$min" else F.array_max)(real), a.type.elementType)


@operator("$stdDevPop", "$stdDevSamp")
def _deviation(name: str, e: Any, scope: Scope) -> Val:
    def spread(d: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

        def step(s: Column, x: Column) -> Column:
            n = s["n"] + 1
            mean = s["mean"] + (x - s["mean"]) / n
            return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - mean)).alias("m2"))

        return F.aggregate(d, start, step)

    s = bind(_doubles(_samples(name, e, scope)), spread)
    if name == "$stdDevPop":
        return Val(F.when(s["n"] > 0, F.sqrt(s["m2"] / F.greatest(s["n"], F.lit(1.0)))), DOUBLE)
    return Val(F.when(s["n"] > 1, F.sqrt(s["m2"] / F.greatest(s["n"] - 1, F.lit(1.0)))), DOUBLE)


def _quantile(sorted_: Column, p: float, method: str) -> Column:
    """Nearest rank, or interpolated between ranks; sorted_ has at least one element."""
    n = F.size(sorted_)
    if method == "continuous":
        at = F.lit(float(p)) * (n - 1)
        low = F.floor(at).cast("int")
        high = F.ceil(at).cast("int")
        return F.get(sorted_, low) + (F.get(sorted_, high) - F.get(sorted_, low)) * (at - low)
    return F.get(sorted_, F.greatest(F.ceil(n * F.lit(float(p))).cast("int") - 1, F.lit(0)))


@operator("$median", "$percentile")
def _quantiles(name: str, e: Any, scope: Scope) -> Val:
    needed = ("input", "method") if name == "$median" else ("input", "p", "method")
    options(name, e, needed, needed)
    if e["method"] not in ("approximate", "discrete", "continuous"):
        raise InvalidArgument(f"{name}: unknown method")
    ps = [0.5] if name == "$median" else e["p"]
    if not isinstance(ps, list) or not ps or not all(isinstance(p, int | float) and not isinstance(p, bool) and 0 <= p <= 1 for p in ps):
        raise InvalidArgument("$percentile: p is an array of numbers between 0 and 1")
    v = compile_expression(e["input"], scope)
    a = v if v.array else array_of([v]) if v.numeric else Val(F.array().cast("array<double>"), T.ArrayType(DOUBLE))
    found = bind(F.array_sort(_doubles(a)), lambda s: F.array(*[F.when(F.size(s) > 0, _quantile(s, p, e["method"])) for p in ps]))
    return Val(found[0], DOUBLE) if name == "$median" else Val(found, T.ArrayType(DOUBLE))


__all__ = ["bind", "missing", "single", "sort_comparator"]
