"""Arithmetic in double precision, bits, logarithms and trigonometry."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import ExpectedNumeric, InvalidArgument
from docweave.functions.base import Scope, arguments, compile_expression, guard, loose_number, number, operator, reject, single, strict_number, variadic, whole
from docweave.values import DOUBLE, LONG, Val

_LONG_MIN, _LONG_MAX = -(2.0**63), 2.0**63


@operator("$add", "$multiply")
def _fold(name: str, e: Any, scope: Scope) -> Val:
    values = [compile_expression(x, scope) for x in variadic(e)]
    if not values:
        raise InvalidArgument(f"{name} takes at least one operand")
    reals = [strict_number(name, v, scope) for v in values]
    return number(reduce((lambda a, b: a + b) if name == "$add" else (lambda a, b: a * b), reals), all(v.integral for v in values))


@operator("$subtract", "$divide", "$mod")
def _binary(name: str, e: Any, scope: Scope) -> Val:
    a, b = (compile_expression(x, scope) for x in arguments(name, e, 2))
    x, y = strict_number(name, a, scope), strict_number(name, b, scope)
    if name == "$subtract":
        return number(x - y, a.integral and b.integral)
    if name == "$divide":
        return number(guard(scope, y == 0, "$divide by zero", F.try_divide(x, y)), False)
    n, d = (truncated(v) for v in (x, y))
    return Val(guard(scope, d == 0, "$mod by zero", F.try_mod(n, d)), LONG)


def truncated(x: Column) -> Column:
    """A double as a long: toward zero, cut at the ends, NaN as 0."""
    return F.when(F.isnan(x), F.lit(0)).when(x >= _LONG_MAX, F.lit(2**63 - 1)).when(x <= _LONG_MIN, F.lit(-(2**63))).otherwise(x.try_cast("long")).cast("long")


@operator("$abs", "$ceil", "$floor")
def _unary(name: str, e: Any, scope: Scope) -> Val:
    v = compile_expression(e, scope)
    x = strict_number(name, v, scope)
    if name == "$abs":
        return number(F.abs(x), v.integral)
    # as doubles, since a long cannot hold all of them
    whole_part = F.rint(x)
    if name == "$ceil":
        made = F.when(whole_part < x, whole_part + 1).otherwise(whole_part)
    else:
        made = F.when(whole_part > x, whole_part - 1).otherwise(whole_part)
    return number(made, v.integral)


@operator("$round", "$trunc")
def _rounded(name: str, e: Any, scope: Scope) -> Val:
    args = arguments(name, e, 1, 2)
    v = compile_expression(args[0], scope)
    x = strict_number(name, v, scope)
    place = compile_expression(args[1], scope) if len(args) > 1 else None
    p = whole(name, "place", place, scope) if place else F.lit(0)
    if place is not None and place.literal and isinstance(place.const, int) and not -20 <= place.const <= 100:
        raise InvalidArgument(f"{name}: place lies between -20 and 100")
    scale = F.pow(F.lit(10.0), p.cast("double"))
    y = x * scale
    made = y - F.try_mod(y, F.lit(1.0)) if name == "$trunc" else F.round(y, 0)  # half away from zero
    return number(made / scale, v.integral or place is None)


#: name: (function, condition that is an error, what is wrong)
_NULLABLE = {
    "$exp": (F.exp, None),
    "$ln": (F.ln, lambda x: x <= 0),
    "$log10": (F.log10, lambda x: x <= 0),
    "$sqrt": (F.sqrt, lambda x: x < 0),
    "$acos": (F.acos, lambda x: (x < -1) | (x > 1)),
    "$asin": (F.asin, lambda x: (x < -1) | (x > 1)),
    "$atanh": (F.atanh, lambda x: (x < -1) | (x > 1)),
    "$acosh": (F.acosh, lambda x: x < 1),
    "$asinh": (F.asinh, None),
    "$atan": (F.atan, None),
    "$cos": (F.cos, lambda x: F.abs(x) == float("inf")),
    "$sin": (F.sin, lambda x: F.abs(x) == float("inf")),
    "$tan": (F.tan, lambda x: F.abs(x) == float("inf")),
    "$cosh": (F.cosh, None),
    "$sinh": (F.sinh, None),
    "$tanh": (F.tanh, None),
    "$degreesToRadians": (lambda x: x * (math.pi / 180), None),
    "$radiansToDegrees": (lambda x: x * (180 / math.pi), None),
}


@operator(*_NULLABLE)
def _nullable(name: str, e: Any, scope: Scope) -> Val:
    x = loose_number(name, compile_expression(single(name, e), scope), scope)
    function, wrong = _NULLABLE[name]
    return Val(function(x) if wrong is None else guard(scope, wrong(x), f"{name}: value out of its domain", function(x)), DOUBLE)


@operator("$atan2", "$log", "$pow")
def _nullable_pair(name: str, e: Any, scope: Scope) -> Val:
    a, b = (compile_expression(x, scope) for x in arguments(name, e, 2))
    x, y = loose_number(name, a, scope), loose_number(name, b, scope)
    if name == "$atan2":
        return Val(F.atan2(x, y), DOUBLE)
    none = x.isNull() | y.isNull()
    if name == "$log":
        return Val(guard(scope, ~none & ((x <= 0) | (y <= 0) | (y == 1)), "$log: value out of its domain", F.when(~none, F.try_divide(F.ln(x), F.ln(y)))), DOUBLE)
    natural = a.integral and b.literal and b.integral and b.const >= 0
    return number(guard(scope, ~none & (x == 0) & (y < 0), "$pow: 0 to a negative power", F.when(~none, F.pow(x, y))), natural)


@operator("$bitAnd", "$bitOr", "$bitXor", "$bitNot")
def _bits(name: str, e: Any, scope: Scope) -> Val:
    values = [compile_expression(x, scope) for x in ([single(name, e)] if name == "$bitNot" else variadic(e))]
    columns = []
    for v in values:
        if v.null:
            columns.append(F.lit(None).cast("long"))
        elif not v.integral or isinstance(v.type, T.DecimalType):
            return reject(scope, ExpectedNumeric(f"{name} takes integers"))
        else:
            columns.append(v.col.cast("long"))
    if name == "$bitNot":
        return Val(F.bitwise_not(columns[0]), LONG)
    join = {"$bitAnd": lambda a, b: a.bitwiseAND(b), "$bitOr": lambda a, b: a.bitwiseOR(b), "$bitXor": lambda a, b: a.bitwiseXOR(b)}[name]
    return Val(reduce(join, columns, F.lit(-1 if name == "$bitAnd" else 0).cast("long")), LONG)
