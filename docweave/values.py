"""Typed values: a Column with its Spark type, and the total order, truth and literals of the document model.

SQL NULL stands for a missing field. Where the model folds missing into null (comparisons, sorting, grouping) nothing more is needed.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidArgument

INT, LONG, DOUBLE, STRING, BOOL, DATE, BINARY, NULL = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType(), T.BinaryType(), T.NullType()
TIMESTAMP = T.StructType([T.StructField("time", LONG), T.StructField("increment", LONG)])


@dataclass(frozen=True)
class Timestamp:
    """Seconds and a counter, as change logs stamp their events."""

    time: int
    increment: int = 0


@dataclass(frozen=True)
class Val:
    """A compiled value. const: its Python value where it is a literal; missing: statically absent."""

    col: Column
    type: T.DataType
    const: Any = None
    literal: bool = False
    missing: bool = False

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def integral(self) -> bool:
        return isinstance(self.type, T.IntegralType)

    @property
    def null(self) -> bool:
        return isinstance(self.type, T.NullType)

    @property
    def array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def document(self) -> bool:
        return isinstance(self.type, T.StructType | T.MapType) and not is_stamp(self.type)

    @property
    def date(self) -> bool:
        return isinstance(self.type, T.TimestampType | T.TimestampNTZType | T.DateType)

    @property
    def dynamic(self) -> bool:
        return isinstance(self.type, T.VariantType)


def is_stamp(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == ["time", "increment"]


def missing() -> Val:
    return Val(F.lit(None), NULL, missing=True)


def null() -> Val:
    return Val(F.lit(None), NULL, None, True)


def quoted(name: str) -> Column:
    """A top-level column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


# the total order of types: what comes first is lowest

RANKS = ("null", "bool", "number", "string", "object", "array", "binData", "date", "timestamp", "decimal")


def rank(kind: T.DataType) -> str:
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if is_stamp(kind):
        return "timestamp"
    if isinstance(kind, T.StructType | T.MapType):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.BinaryType):
        return "binData"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "date"
    raise InvalidArgument(f"values of type {kind.simpleString()} have no order")


def common(kinds: list[T.DataType]) -> T.DataType:
    """One type that holds all; numbers widen, null goes with all."""
    real = [k for k in kinds if not isinstance(k, T.NullType)]
    if not real:
        return NULL
    first = real[0]
    if all(k == first for k in real):
        return first
    if all(isinstance(k, T.NumericType) for k in real):
        if all(isinstance(k, T.IntegralType) for k in real):
            return LONG if any(isinstance(k, T.LongType) for k in real) else INT
        return DOUBLE
    if all(isinstance(k, T.ArrayType) for k in real):
        return T.ArrayType(common([k.elementType for k in real]))
    if all(isinstance(k, T.StructType) for k in real):
        names = list(dict.fromkeys(n for k in real for n in k.names))
        return T.StructType([T.StructField(n, common([k[n].dataType for k in real if n in k.names])) for n in names])
    if all(isinstance(k, T.TimestampType | T.TimestampNTZType | T.DateType) for k in real):
        return DATE
    raise InvalidArgument("values of several types in one place need a VARIANT column: " + ", ".join(k.simpleString() for k in real))


def cast(v: Val, kind: T.DataType) -> Column:
    """v as a wider type of the same kind."""
    if v.type == kind:
        return v.col
    if isinstance(kind, T.StructType) and isinstance(v.type, T.StructType) and not is_stamp(kind):
        fields = [cast(Val(v.col.getField(f.name), v.type[f.name].dataType), f.dataType).alias(f.name) if f.name in v.type.names else F.lit(None).cast(f.dataType).alias(f.name) for f in kind]
        return F.when(v.col.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(v.type, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(v.col, lambda x: cast(Val(x, v.type.elementType), kind.elementType))
    return v.col.cast(kind)


def order(a: Val, b: Val) -> tuple[Column, Column]:
    """(a = b, a < b) in the total order, never NULL; missing counts as null, the lowest."""
    ra, rb = rank(a.type), rank(b.type)
    none_a, none_b = a.col.isNull(), b.col.isNull()
    if ra == rb and ra != "null":
        if a.type != b.type:
            try:
                kind = DOUBLE if ra == "number" else common([a.type, b.type])
            except InvalidArgument:
                x, y = F.to_json(a.col), F.to_json(b.col)  # documents and arrays of unlike make-up: by their text
            else:
                x, y = cast(a, kind), cast(b, kind)
        else:
            x, y = a.col, b.col
        if isinstance(a.type, T.MapType):
            x, y = F.map_entries(x), F.map_entries(y)
        return x.eqNullSafe(y), F.coalesce(x < y, none_a & ~none_b)
    below = F.lit(RANKS.index(ra) < RANKS.index(rb))
    return none_a & none_b, F.when(none_a, ~none_b).when(none_b, F.lit(False)).otherwise(below)


def truthy(v: Val) -> Column:
    """false, null, 0 and NaN are not; never NULL."""
    if v.null:
        return F.lit(False)
    if isinstance(v.type, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if v.numeric:
        real = v.col.cast("double")
        return F.coalesce((real != 0) & ~F.isnan(real), F.lit(False))
    return v.col.isNotNull()


def alias(kind: T.DataType) -> str:
    """The name that $type gives a value."""
    if is_stamp(kind):
        return "timestamp"
    for t, name in ((T.IntegerType, "int"), (T.ShortType, "int"), (T.ByteType, "int"), (T.LongType, "long"), (T.DecimalType, "decimal"), (T.DoubleType, "double"), (T.FloatType, "double")):
        if isinstance(kind, t):
            return name
    return {"bool": "bool", "string": "string", "object": "object", "array": "array", "binData": "binData", "date": "date", "null": "null"}[rank(kind)]


#: Type codes by name.
CODES = {
    "double": 1, "string": 2, "object": 3, "array": 4, "binData": 5, "undefined": 6, "objectId": 7, "bool": 8, "date": 9, "null": 10, "regex": 11,
    "dbPointer": 12, "javascript": 13, "symbol": 14, "javascriptWithScope": 15, "int": 16, "timestamp": 17, "long": 18, "decimal": 19, "minKey": -1, "maxKey": 127,
}


def literal(value: Any) -> Val:
    """A Python value as a constant."""
    if value is None:
        return null()
    if isinstance(value, bool):
        return Val(F.lit(value), BOOL, value, True)
    if isinstance(value, int):
        kind = INT if -(2**31) <= value < 2**31 else LONG
        if not -(2**63) <= value < 2**63:
            raise InvalidArgument("integers have 64 bits")
        return Val(F.lit(value).cast(kind), kind, value, True)
    if isinstance(value, float):
        return Val(F.lit(value), DOUBLE, value, True)
    if isinstance(value, str):
        return Val(F.lit(value), STRING, value, True)
    if isinstance(value, bytes | bytearray):
        return Val(F.lit(bytes(value)), BINARY, bytes(value), True)
    if isinstance(value, Decimal):
        kind = T.DecimalType(38, max(0, -value.as_tuple().exponent))
        return Val(F.lit(str(value)).cast(kind), kind, value, True)
    if isinstance(value, Timestamp):
        return Val(F.struct(F.lit(value.time).cast("long").alias("time"), F.lit(value.increment).cast("long").alias("increment")), TIMESTAMP, value, True)
    if isinstance(value, dt.datetime):
        at = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        micros = (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
        return Val(F.timestamp_micros(F.lit(micros)), DATE, value, True)
    if isinstance(value, dt.date):
        return literal(dt.datetime(value.year, value.month, value.day))
    if isinstance(value, list | tuple):
        items = [literal(x) for x in value]
        kind = common([x.type for x in items])
        if not items:
            return Val(F.array(), T.ArrayType(NULL), list(value), True)
        return Val(F.array(*[cast(x, kind) for x in items]), T.ArrayType(kind), list(value), True)
    if isinstance(value, dict):
        fields = {k: literal(v) for k, v in value.items()}
        if not fields:
            return Val(F.from_json(F.lit("{}"), T.StructType([])), T.StructType([]), value, True)
        return Val(F.struct(*[v.col.alias(k) for k, v in fields.items()]), T.StructType([T.StructField(k, v.type) for k, v in fields.items()]), value, True)
    if isinstance(value, re.Pattern):
        raise InvalidArgument("patterns are no values")
    raise InvalidArgument(f"no literal for {type(value).__name__}")
