"""Filter documents as one boolean Column that is never NULL.

Paths enter arrays of documents; a predicate holds if one of the values found does, or one element of a value that is an array.
A NULL column is a missing field. Plain comparisons of columns with constants stay in a form that scans can push down.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidStructure, QueryError, UnsupportedOperator
from docweave.functions.base import Scope, compile_expression
from docweave.functions.core import comparable
from docweave.functions.strings import pattern
from docweave.values import CODES, NULL, Val, alias, literal, order, rank, truthy

#: All operators of filters.
FILTER_OPERATORS = (
    "$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$all", "$exists", "$type", "$size", "$mod", "$regex", "$options", "$elemMatch", "$not", "$and", "$or", "$nor",
    "$expr", "$alwaysTrue", "$alwaysFalse", "$comment", "$sampleRate", "$bitsAllSet", "$bitsAllClear", "$bitsAnySet", "$bitsAnyClear",
)

Leaf = Callable[[Val], Column]


def compile_filter(spec: Any, scope: Scope, top: bool = True) -> Column:
    if not isinstance(spec, dict):
        raise InvalidStructure("a filter is a document")
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, list):
                raise InvalidStructure(f"{key} takes an array")
            inner = [compile_filter(x, scope, False) for x in value]
            if key == "$and":
                parts.append(reduce(lambda a, b: a & b, inner, F.lit(True)))
            else:
                any_ = reduce(lambda a, b: a | b, inner, F.lit(False))
                parts.append(any_ if key == "$or" else ~any_)
        elif key == "$expr":
            parts.append(_expression(value, scope))
        elif key in ("$alwaysTrue", "$alwaysFalse"):
            if value != 1 or isinstance(value, bool):
                raise InvalidStructure(f"{key} takes 1")
            parts.append(F.lit(key == "$alwaysTrue"))
        elif key == "$sampleRate":
            if not isinstance(value, int | float) or isinstance(value, bool) or not 0 <= value <= 1:
                raise InvalidStructure("$sampleRate takes a number between 0 and 1")
            parts.append(F.lit(bool(value)) if value in (0, 1) else F.rand() < float(value))
        elif key == "$comment":
            if not top:
                raise UnsupportedOperator("$comment inside another operator")
        elif key.startswith("$"):
            raise UnsupportedOperator(key)
        else:
            parts.append(_field(key, value, scope))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _expression(e: Any, scope: Scope) -> Column:
    errors: list[Column] = []
    held = truthy(compile_expression(e, Scope(scope.schema, scope.variables, errors, scope.root)))
    return held if not errors else ~reduce(lambda a, b: a | b, errors) & held


def _field(path: str, value: Any, scope: Scope) -> Column:
    if isinstance(value, re.Pattern):
        return _any(path, scope, _regex(value.pattern, _flags(value)))
    if isinstance(value, dict) and any(isinstance(k, str) and k.startswith("$") for k in value):
        if not all(k.startswith("$") for k in value):
            raise InvalidStructure("operators and fields do not mix")
        return reduce(lambda a, b: a & b, [_operator(path, k, v, value, scope) for k, v in value.items() if not (k == "$options" and "$regex" in value)])
    return _any(path, scope, _compare("$eq", value))


def _flags(p: re.Pattern) -> str:
    return "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if p.flags & f)


def _operator(path: str, name: str, value: Any, whole: dict, scope: Scope) -> Column:
    found = lambda leaf: _any(path, scope, leaf)
    if name in ("$eq", "$gt", "$gte", "$lt", "$lte"):
        return found(_compare(name, value))
    if name == "$ne":
        return ~found(_compare("$eq", value))
    if name in ("$in", "$nin"):
        if not isinstance(value, list):
            raise InvalidStructure(f"{name} takes an array")
        held = found(_one_of(value))
        return held if name == "$in" else ~held
    if name == "$all":
        if not isinstance(value, list) or any(isinstance(v, dict) and "$elemMatch" in v for v in value):
            raise InvalidStructure("$all takes an array of values")
        return reduce(lambda a, b: a & b, [found(_compare("$eq", v)) for v in value]) if value else F.lit(False)
    if name == "$exists":
        if not isinstance(value, bool):
            raise InvalidStructure("$exists takes a boolean")
        held = found(lambda v: v.col.isNotNull())
        return held if value else ~held
    if name == "$type":
        return found(_type(value))
    if name == "$size":
        if not isinstance(value, int) or isinstance(value, bool) or value < 0:
            raise InvalidStructure("$size takes a length")
        return found(lambda v: v.col.isNotNull() & (F.size(v.col) == value) if v.array else F.lit(False))
    if name == "$mod":
        if not isinstance(value, list) or len(value) != 2 or not all(isinstance(x, int | float) and not isinstance(x, bool) for x in value) or not int(value[0]):
            raise InvalidStructure("$mod takes [divisor, remainder]")
        return found(_elements(_modulo(int(value[0]), int(value[1]))))
    if name == "$regex":
        if isinstance(value, re.Pattern):
            return found(_regex(value.pattern, whole.get("$options", _flags(value))))
        if not isinstance(value, str) or not isinstance(whole.get("$options", ""), str):
            raise InvalidStructure("$regex takes a pattern")
        return found(_regex(value, whole.get("$options", "")))
    if name == "$options":
        raise InvalidStructure("$options needs $regex")
    if name == "$elemMatch":
        return found(_elem_match(value, scope))
    if name == "$not":
        if isinstance(value, re.Pattern):
            return ~found(_regex(value.pattern, _flags(value)))
        if not isinstance(value, dict) or not value or not all(k.startswith("$") for k in value):
            raise InvalidStructure("$not takes operators or a pattern")
        return ~_field(path, value, scope)
    if name in ("$bitsAllSet", "$bitsAllClear", "$bitsAnySet", "$bitsAnyClear"):
        return found(_elements(_bits(name, _positions(value))))
    raise UnsupportedOperator(name)


# paths


def _any(path: str, scope: Scope, leaf: Leaf) -> Column:
    head, *rest = path.split(".")
    if "" in (head, *rest):
        raise InvalidStructure(f"empty part in path '{path}'")
    start = scope.field(head)
    return F.lit(False) if start.missing else _enter(start, rest, leaf)


def _enter(v: Val, rest: list[str], leaf: Leaf) -> Column:
    if not rest:
        return leaf(v)
    name, *more = rest
    if isinstance(v.type, T.StructType):
        return _enter(Val(v.col.getField(name), v.type[name].dataType), more, leaf) if name in v.type.names else F.lit(False)
    if isinstance(v.type, T.MapType):
        return _enter(Val(F.try_element_at(v.col, F.lit(name)), v.type.valueType), more, leaf)
    if v.dynamic:
        return _enter(Val(F.try_variant_get(v.col, f"$.{name}", "variant"), v.type), more, leaf)
    if v.array:
        return F.coalesce(F.exists(v.col, lambda x: _enter(Val(x, v.type.elementType), rest, leaf)), F.lit(False))
    return F.lit(False)


def _elements(leaf: Leaf) -> Leaf:
    """The value itself, or any element at any depth of an array."""

    def test(v: Val) -> Column:
        if v.array:
            return F.coalesce(F.exists(v.col, lambda x: test(Val(x, v.type.elementType))), F.lit(False))
        return leaf(v)

    return test


# comparison


def _plain(v: Val, c: Val) -> Column | None:
    """The constant in the column's own type, so that the comparison can be pushed down."""
    if not c.literal or c.null or v.dynamic or isinstance(v.type, T.NullType) or rank(v.type) != rank(c.type):
        return None
    if v.type == c.type and isinstance(v.type, T.StringType | T.BooleanType | T.DoubleType | T.TimestampType | T.IntegralType):
        return c.col
    if isinstance(v.type, T.IntegralType) and c.integral:
        bits = {"int": 31, "smallint": 15, "tinyint": 7}.get(v.type.simpleString(), 63)
        if -(2**bits) <= c.const < 2**bits:
            return F.lit(c.const).cast(v.type)
    if isinstance(v.type, T.DoubleType) and c.integral and abs(c.const) <= 2**53:
        return F.lit(float(c.const))
    return None


def _compare(name: str, value: Any) -> Leaf:
    c = literal(value)

    def one(v: Val, explicit: bool) -> Column:
        plain = _plain(v, c)
        if plain is not None and not (isinstance(c.const, float) and c.const != c.const):
            held = {"$eq": v.col == plain, "$gt": v.col > plain, "$gte": v.col >= plain, "$lt": v.col < plain, "$lte": v.col <= plain}[name]
            return v.col.isNotNull() & held
        a, b = comparable(v, c)
        try:
            equal, less = order(a, b)
        except QueryError:
            return F.lit(False)
        held = {"$eq": equal, "$gt": ~(equal | less), "$gte": ~less, "$lt": less, "$lte": equal | less}[name]
        return held if explicit else a.col.isNotNull() & held

    def test(v: Val, explicit: bool = False) -> Column:
        if not v.array:
            return one(v, explicit)
        inner = F.coalesce(F.exists(v.col, lambda x: test(Val(x, v.type.elementType), True)), F.lit(False))
        # an array is equal as a whole too, but ranks by its elements only
        return one(v, explicit) | inner if c.array and name == "$eq" else inner

    return test


def _one_of(values: list) -> Leaf:
    consts = [literal(x) if not isinstance(x, re.Pattern) else None for x in values]

    def test(v: Val) -> Column:
        plain = [_plain(v, c) for c in consts if c is not None]
        if plain and len(plain) == len(values) and all(p is not None for p in plain):
            return v.col.isNotNull() & v.col.isin(*plain)
        # a pattern here is a value, and no typed column holds patterns
        return reduce(lambda a, b: a | b, [_compare("$eq", x)(v) for x in values if not isinstance(x, re.Pattern)], F.lit(False))

    return test


def _type(value: Any) -> Leaf:
    wanted: set[str] = set()
    for x in value if isinstance(value, list) else [value]:
        if x == "number":
            wanted |= {"int", "long", "double", "decimal"}
        elif isinstance(x, str) and x in CODES:
            wanted.add(x)
        elif isinstance(x, int) and not isinstance(x, bool) and x in CODES.values():
            wanted |= {n for n, c in CODES.items() if c == x}
        else:
            raise InvalidStructure(f"$type: unknown type {x!r}")
    if not wanted:
        raise InvalidStructure("$type takes a type")

    def test(v: Val, explicit: bool = False) -> Column:
        if v.dynamic:
            from docweave.functions.base import OPERATORS

            kind = OPERATORS["$type"]("$type", "$$v", Scope(T.StructType([]), {"v": v})).col
            return F.coalesce(kind.isin(*wanted), F.lit(False))
        own = F.lit(alias(v.type) in wanted)
        own = F.when(v.col.isNull(), F.lit("null" in wanted)).otherwise(own) if explicit else v.col.isNotNull() & own
        if v.array:
            return own | F.coalesce(F.exists(v.col, lambda x: test(Val(x, v.type.elementType), True)), F.lit(False))
        return own

    return test


def _modulo(divisor: int, remainder: int) -> Leaf:
    from docweave.functions.arithmetic import truncated

    def test(v: Val) -> Column:
        if not v.numeric:
            return F.lit(False)
        whole = v.col.cast("long") if v.integral else truncated(v.col.cast("double"))
        return v.col.isNotNull() & (whole % divisor == remainder)

    return test


def _regex(rule: str, flags: str) -> Leaf:
    made = pattern("$regex", rule, flags)

    def one(v: Val) -> Column:
        if v.dynamic:
            return F.coalesce(F.rlike(F.try_variant_get(v.col, "$", "string"), F.lit(made)), F.lit(False))
        if not isinstance(v.type, T.StringType):
            return F.lit(False)
        return v.col.isNotNull() & v.col.rlike(made)

    return _elements(one)


def _elem_match(spec: Any, scope: Scope) -> Leaf:
    if not isinstance(spec, dict):
        raise InvalidStructure("$elemMatch takes a document")
    if "$expr" in spec:
        raise InvalidStructure("$elemMatch holds no $expr")
    value_case = bool(spec) and all(k.startswith("$") and k not in ("$and", "$or", "$nor") for k in spec)

    def test(v: Val) -> Column:
        if not v.array:
            return F.lit(False)
        kind = v.type.elementType

        def matches(x: Column) -> Column:
            if value_case:
                inner = Scope(T.StructType([T.StructField("x", kind)]), scope.variables, scope.errors, Val(F.struct(x.alias("x")), T.StructType([T.StructField("x", kind)])))
                return _field("x", spec, inner)
            if not isinstance(kind, T.StructType | T.MapType | T.VariantType):
                return F.lit(False)
            return compile_filter(spec, Scope(scope.schema, scope.variables, scope.errors, Val(x, kind)), False)

        return F.coalesce(F.exists(v.col, matches), F.lit(False))

    return test


# bits


def _positions(value: Any) -> list[int]:
    if isinstance(value, bool):
        raise InvalidStructure("bit tests take a mask or positions")
    if isinstance(value, float) and value == int(value):
        value = int(value)
    if isinstance(value, int):
        if value < 0:
            raise InvalidStructure("a mask is not negative")
        return [i for i in range(64) if value >> i & 1]
    if isinstance(value, bytes):
        return [8 * i + k for i, b in enumerate(value) for k in range(8) if b >> k & 1]
    if isinstance(value, list) and all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in value):
        return sorted(set(value))
    raise InvalidStructure("bit tests take a mask or positions")


def _bits(name: str, positions: list[int]) -> Leaf:
    def bit(v: Val, i: int) -> Column:
        if isinstance(v.type, T.BinaryType):
            byte = F.conv(F.hex(F.substring(v.col, i // 8 + 1, 1)), 16, 10).cast("int")
            return F.coalesce(byte.bitwiseAND(1 << i % 8) != 0, F.lit(False))
        return v.col.cast("long").bitwiseAND(F.lit(1 << i if i < 63 else -(2**63)).cast("long")) != 0  # beyond 63 the sign goes on

    def test(v: Val) -> Column:
        if isinstance(v.type, T.BinaryType):
            each = [bit(v, i) for i in positions]
        elif v.integral:
            each = [bit(v, i) for i in positions]
        elif v.numeric and not isinstance(v.type, T.DecimalType):
            real = v.col.cast("double")
            fits = (real == F.rint(real)) & (F.abs(real) < 2.0**63)
            inner = test(Val(F.when(fits, real).try_cast("long"), T.LongType()))
            return v.col.isNotNull() & fits & F.coalesce(inner, F.lit(False))
        else:
            return F.lit(False)
        clear = name.endswith("Clear")
        each = [~b if clear else b for b in each]
        held = reduce(lambda a, b: a & b, each, F.lit(True)) if "All" in name else reduce(lambda a, b: a | b, each, F.lit(False))
        return v.col.isNotNull() & held

    return test


__all__ = ["FILTER_OPERATORS", "NULL", "compile_filter"]
