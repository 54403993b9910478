"""Types, conversions, sizes and hashes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidArgument
from docweave.functions.base import Scope, compile_expression, guard, operator, options, reject, single, unwrap
from docweave.functions.dates import rfc3339
from docweave.functions.strings import date_text, number_text
from docweave.values import BOOL, DATE, DOUBLE, INT, LONG, STRING, Val, alias, cast, common, is_stamp, null

#: Targets by name and code.
TARGETS = {"double": 1, "string": 2, "objectId": 7, "bool": 8, "date": 9, "int": 16, "long": 18, "decimal": 19}
DECIMAL = T.DecimalType(38, 10)


@operator("$isNumber")
def _is_number(name: str, e: Any, scope: Scope) -> Val:
    v = compile_expression(unwrap(e), scope)
    if v.dynamic:
        return Val(F.coalesce(F.schema_of_variant(v.col).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.lit(False)), BOOL)
    return Val(v.col.isNotNull() if v.numeric else F.lit(False), BOOL)


@operator("$type")
def _type(name: str, e: Any, scope: Scope) -> Val:
    v = compile_expression(unwrap(e), scope)
    if v.null:
        return Val(F.lit("null" if v.literal else "missing"), STRING)
    if v.dynamic:
        kind = F.schema_of_variant(v.col)
        made = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.startswith("DECIMAL"), "double").when(kind == "BIGINT", "long")
        for text, out in (("STRING", "string"), ("BOOLEAN", "bool"), ("DOUBLE", "double"), ("VOID", "null"), ("TIMESTAMP", "date"), ("DATE", "date"), ("BINARY", "binData")):
            made = made.when(kind == text, out)
        return Val(F.when(v.col.isNull(), "missing").otherwise(made), STRING)
    return Val(F.when(v.col.isNull(), "missing").otherwise(alias(v.type)), STRING)


def as_json(v: Val) -> Column:
    """Nested values as JSON; integral doubles have no fraction."""
    if isinstance(v.type, T.ArrayType):
        items = F.transform(v.col, lambda x: F.coalesce(as_json(Val(x, v.type.elementType)), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if isinstance(v.type, T.MapType):
        items = F.transform(F.map_entries(v.col), lambda x: F.concat(_quoted(x["key"]), F.lit(":"), F.coalesce(as_json(Val(x["value"], v.type.valueType)), F.lit("null"))))
        return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))
    if isinstance(v.type, T.StructType) and not is_stamp(v.type):
        # a NULL field is a missing one
        items = F.array(*[F.concat(_quoted(F.lit(f.name)), F.lit(":"), as_json(Val(v.col.getField(f.name), f.dataType))) for f in v.type])
        return F.when(v.col.isNotNull(), F.concat(F.lit("{"), F.array_join(F.filter(items, lambda x: x.isNotNull()) if len(v.type) else F.array().cast("array<string>"), ","), F.lit("}")))
    if isinstance(v.type, T.DoubleType | T.FloatType):
        real = v.col.cast("double")
        return F.when(F.isnan(real) | (F.abs(real) == float("inf")), _quoted(number_text(real))).otherwise(number_text(real))
    if isinstance(v.type, T.NumericType | T.BooleanType):
        return v.col.cast("string")
    if v.null:
        return F.lit(None).cast("string")
    return _quoted(_to_string(v)[0])


def _quoted(text: Column) -> Column:
    """A string in JSON."""
    return F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1"))


def _to_string(v: Val) -> tuple[Column, Column | None]:
    if isinstance(v.type, T.StringType):
        return v.col, None
    if isinstance(v.type, T.DoubleType | T.FloatType):
        return number_text(v.col.cast("double")), None
    if v.date:
        return date_text(v.col), None
    if is_stamp(v.type):
        return F.concat(F.lit("Timestamp("), v.col["time"].cast("string"), F.lit(", "), v.col["increment"].cast("string"), F.lit(")")), None
    if v.array or v.document:
        return as_json(v), None
    if isinstance(v.type, T.BinaryType):
        return F.base64(v.col), None
    if v.dynamic:
        return F.coalesce(F.try_variant_get(v.col, "$", "string"), F.to_json(v.col)), None
    return v.col.cast("string"), None


def _truncated(real: Column, high: float) -> tuple[Column, Column]:
    """A double toward zero as a long, and where that cannot be."""
    bad = F.isnan(real) | (real >= high) | (real <= -high - 1 if high < 1e18 else real < -high)
    return F.when(~bad, real).try_cast("long"), bad


def convert(v: Val, target: str) -> tuple[Column, T.DataType, Column]:
    """v as the target type, that type, and the condition under which it cannot be converted."""
    never, always = F.lit(False), F.lit(True)
    if v.dynamic:
        v = Val(F.try_variant_get(v.col, "$", "string"), STRING)
    text = isinstance(v.type, T.StringType)
    boolean = isinstance(v.type, T.BooleanType)
    real = v.col.cast("double") if v.numeric else None
    if target == "bool":
        if boolean:
            return v.col, BOOL, never
        return (F.isnan(real) | (real != 0) if v.numeric else F.lit(True)), BOOL, never
    if target == "string":
        return _to_string(v)[0], STRING, never
    if target == "objectId":
        fits = F.regexp_like(v.col, F.lit("^[0-9a-fA-F]{24}$")) if text else F.lit(False)
        return F.when(fits, F.lower(v.col)) if text else F.lit(None).cast("string"), STRING, ~fits
    if target == "date":
        if v.date:
            return v.col.cast("timestamp"), DATE, never
        if is_stamp(v.type):
            return F.timestamp_seconds(v.col["time"]), DATE, never
        if text:
            made = rfc3339(v.col)
            return made, DATE, made.isNull()
        if v.numeric:
            millis, bad = (v.col.cast("long"), never) if v.integral else _truncated(real, 2.0**63)
            bad = bad | (F.abs(millis) > 2**62)
            return F.timestamp_millis(F.when(~bad & (F.abs(millis) < 9 * 10**15), millis)), DATE, bad
        return F.lit(None).cast("timestamp"), DATE, always
    kind, spark = {"double": (DOUBLE, "double"), "decimal": (DECIMAL, "decimal(38,10)"), "int": (INT, "int"), "long": (LONG, "long")}[target]
    if boolean:
        return v.col.cast("int").cast(spark), kind, never
    if v.date and target != "int":
        return F.unix_millis(v.col.cast("timestamp")).cast(spark), kind, never
    if text:
        if target in ("int", "long"):
            made = F.when(F.regexp_like(v.col, F.lit(r"^[+-]?\d+$")), v.col).try_cast(spark)
        elif target == "decimal":
            made = F.when(F.regexp_like(v.col, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), v.col).try_cast(spark)
        else:
            named = F.when(v.col.isin("Infinity", "+Infinity"), float("inf")).when(v.col == "-Infinity", float("-inf")).when(v.col.isin("NaN", "+NaN", "-NaN"), float("nan"))
            made = F.coalesce(named, F.when(F.regexp_like(v.col, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), v.col).try_cast("double"))
        return made, kind, made.isNull()
    if v.numeric:
        if target in ("int", "long") and not v.integral:
            made, bad = _truncated(real, 2.0**31 if target == "int" else 2.0**63)
            return made.cast(spark) if target == "long" else made.try_cast("int"), kind, bad
        made = v.col.try_cast(spark)
        return made, kind, made.isNull()
    return F.lit(None).cast(spark), kind, always


@operator("$convert")
def _convert(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("input", "to", "onError", "onNull"), ("input", "to"))
    to = compile_expression(e["to"], scope)
    if to.null:
        return null()
    if not to.literal:
        raise InvalidArgument("$convert: to must be a constant in a typed column")
    target = to.const if isinstance(to.const, str) else {c: n for n, c in TARGETS.items()}.get(to.const)
    if target not in TARGETS:
        raise InvalidArgument(f"$convert: unknown target {to.const!r}")
    return _converted(name, compile_expression(e["input"], scope), target, scope, e)


def _converted(name: str, v: Val, target: str, scope: Scope, e: dict) -> Val:
    on_null = compile_expression(e["onNull"], scope) if "onNull" in e else null()
    if v.null:
        return on_null
    made, kind, bad = convert(v, target)
    bad = v.col.isNotNull() & F.coalesce(bad, F.lit(False))
    if "onError" in e:
        other = compile_expression(e["onError"], scope)
        wide = common([kind, other.type, on_null.type])
        made = F.when(bad, cast(other, wide)).otherwise(cast(Val(made, kind), wide))
    else:
        wide = common([kind, on_null.type])
        made = guard(scope, bad, f"{name}: the value has no form as {target}", cast(Val(made, kind), wide))
    return Val(F.when(v.col.isNull(), cast(on_null, wide)).otherwise(made), wide)


@operator("$toBool", "$toDate", "$toDecimal", "$toDouble", "$toInt", "$toLong", "$toObjectId", "$toString")
def _to(name: str, e: Any, scope: Scope) -> Val:
    target = name[3].lower() + name[4:]
    return _converted(name, compile_expression(unwrap(e), scope), target, scope, {})


# sizes and hashes


def encoded_size(v: Val) -> Column:
    """Bytes of a value without its type and name; NULL where it is missing."""
    if isinstance(v.type, T.StringType):
        return F.octet_length(v.col) + 5
    if isinstance(v.type, T.BinaryType):
        return F.octet_length(v.col) + 5
    if isinstance(v.type, T.BooleanType):
        return F.when(v.col.isNotNull(), 1)
    if isinstance(v.type, T.IntegerType | T.ShortType | T.ByteType):
        return F.when(v.col.isNotNull(), 4)
    if isinstance(v.type, T.DecimalType):
        return F.when(v.col.isNotNull(), 16)
    if isinstance(v.type, T.ArrayType):
        # names of elements are their places in decimal
        sizes = F.transform(v.col, lambda x, i: F.char_length(i.cast("string")) + 2 + F.coalesce(encoded_size(Val(x, v.type.elementType)), F.lit(0)))
        return F.aggregate(sizes, F.lit(5), lambda s, x: s + x)
    if isinstance(v.type, T.MapType):
        sizes = F.transform(F.map_entries(v.col), lambda x: F.octet_length(x["key"]) + 2 + F.coalesce(encoded_size(Val(x["value"], v.type.valueType)), F.lit(0)))
        return F.aggregate(sizes, F.lit(5), lambda s, x: s + x)
    if isinstance(v.type, T.StructType) and not is_stamp(v.type):
        total = F.lit(5)
        for f in v.type:
            total = total + F.coalesce(encoded_size(Val(v.col.getField(f.name), f.dataType)) + len(f.name.encode()) + 2, F.lit(0))
        return F.when(v.col.isNotNull(), total)
    if v.null:
        return F.lit(0) if v.literal else F.lit(None).cast("int")
    return F.when(v.col.isNotNull(), 8)


@operator("$bsonSize")
def _size(name: str, e: Any, scope: Scope) -> Val:
    v = compile_expression(single(name, e), scope)
    if v.null:
        return null()
    if not v.document:
        return reject(scope, InvalidArgument("$bsonSize takes a document"))
    return Val(encoded_size(v).cast("int"), INT)


def _little(x: Column, digits: int) -> Column:
    """An integer's bytes in hexadecimal, least first."""
    high = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.concat(*[F.substring(high, 15 - 2 * k, 2) for k in range(digits // 2)])


#: Type numbers that go into hashes.
_HASH_TYPES = {"null": 5, "number": 10, "string": 15, "object": 20, "array": 25, "binData": 30, "bool": 40, "date": 45, "timestamp": 47, "decimal": 10}


def hashed_hex(v: Val, name: Column | None = None) -> Column:
    """What a value adds to the hash, in hexadecimal: its type, the name it goes by and its payload."""
    from docweave.values import rank

    kind = rank(v.type)
    head = lambda number: F.concat(_little(F.lit(number), 8), F.concat(F.hex(F.encode(name, "utf-8")), F.lit("00")) if name is not None else F.lit(""))
    if kind in ("number", "decimal"):
        real = v.col.cast("double")
        body = _little(v.col.cast("long"), 16) if v.integral else _little(F.when(F.isnan(real), F.lit(0)).when(real == 2.0**63, F.lit(-(2**63))).when(real > 2.0**63, F.lit(2**63 - 1)).when(real < -(2.0**63), F.lit(-(2**63))).otherwise(real.try_cast("long")), 16)
    elif kind == "string":
        body = F.concat(_little(F.octet_length(v.col) + 1, 8), F.hex(F.encode(v.col, "utf-8")), F.lit("00"))
    elif kind == "bool":
        body = F.when(v.col, "01").otherwise("00")
    elif kind == "date":
        body = _little(F.unix_millis(v.col.cast("timestamp")), 16)
    elif kind == "timestamp":
        body = F.concat(_little(v.col["increment"], 8), _little(v.col["time"], 8))
    elif kind == "binData":
        body = F.concat(_little(F.octet_length(v.col), 8), F.lit("00"), F.hex(v.col))
    elif kind == "array":
        body = F.concat(F.array_join(F.transform(v.col, lambda x, i: hashed_hex(Val(x, v.type.elementType), i.cast("string"))), ""), F.lit("0000000000"))
    elif kind == "object" and isinstance(v.type, T.StructType):
        fields = [F.when(v.col.getField(f.name).isNotNull(), hashed_hex(Val(v.col.getField(f.name), f.dataType), F.lit(f.name))).otherwise("") for f in v.type]
        body = F.concat(*fields, F.lit("0000000000"))
    elif kind == "object":
        body = F.concat(F.array_join(F.transform(F.map_entries(v.col), lambda x: hashed_hex(Val(x["value"], v.type.valueType), x["key"])), ""), F.lit("0000000000"))
    else:
        return head(5)
    return F.when(v.col.isNull(), head(5)).otherwise(F.concat(head(_HASH_TYPES[kind]), body))


@operator("$toHashedIndexKey")
def _hashed(name: str, e: Any, scope: Scope) -> Val:
    v = compile_expression(single(name, e) if isinstance(e, list) else e, scope)
    digest = F.md5(F.unhex(F.concat(F.lit("00000000"), hashed_hex(v))))
    # the first 8 bytes, least first, as a signed long
    high = F.concat(*[F.substring(digest, 15 - 2 * k, 2) for k in range(8)])
    top = F.conv(F.substring(high, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(high, 9, 8), 16, 10).cast("long")
    return Val(F.shiftleft(top, 32).bitwiseOR(low), LONG)
