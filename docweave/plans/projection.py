"""Field selections: inclusion, exclusion and computed fields; setting and removing dotted paths."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidStage, MixedProjection
from docweave.functions.base import Scope, compile_expression, hidden
from docweave.functions.core import with_field
from docweave.values import Val, literal, quoted

Fields = dict[str, Val]


def fields_of(schema: T.StructType) -> Fields:
    return {f.name: Val(quoted(f.name), f.dataType) for f in schema}


def columns(fields: Fields) -> list[Column]:
    return [v.col.alias(name) for name, v in fields.items()]


def _flag(value: Any) -> bool | None:
    """Whether a value includes or excludes; None if it is an expression. 1.0 is an expression."""
    return bool(value) if isinstance(value, bool | int) else None


def _parts(path: str) -> list[str]:
    parts = path.split(".")
    if "" in parts:
        raise InvalidStage(f"empty part in path '{path}'")
    return parts


def project(spec: Any, scope: Scope) -> Fields:
    if not isinstance(spec, dict) or not spec:
        raise InvalidStage("$project takes a document with fields")
    flags = {k: _flag(v) for k, v in spec.items()}
    others = {k: f for k, f in flags.items() if k != "_id"}
    included = any(f is not False for f in others.values())
    if included and any(f is False for f in others.values()):
        raise MixedProjection("a projection includes or excludes, not both")
    if not others:
        included = bool(flags.get("_id"))
    own = fields_of(scope.schema)
    unseen = {k: v for k, v in own.items() if hidden(k)}
    if not included:
        for path, flag in flags.items():
            if flag is False:
                own = remove(own, path)
        return own
    out: Fields = {}
    if flags.get("_id", True) is not False and "_id" in own:
        out["_id"] = own["_id"]
    kept: dict = {}
    for path, flag in others.items():
        if flag:
            at = kept
            for part in _parts(path):
                at = at.setdefault(part, {})
            out[_parts(path)[0]] = None
        else:
            v = compile_expression(spec[path], scope)
            if not v.missing:
                out[path] = v
    for name in [n for n, v in out.items() if v is None]:
        found = _prune(own[name], kept[name]) if name in own else None
        if found is None:
            del out[name]
        else:
            out[name] = found
    return out | unseen


def _prune(v: Val, kept: dict) -> Val | None:
    """A value with only the given nested fields; arrays are not entered."""
    if not kept:
        return v
    if not isinstance(v.type, T.StructType):
        return None
    inner = {n: p for n, k in kept.items() if n in v.type.names and (p := _prune(Val(v.col.getField(n), v.type[n].dataType), k)) is not None}
    if not inner:
        return None
    return Val(F.when(v.col.isNotNull(), F.struct(*columns(inner))), T.StructType([T.StructField(n, p.type) for n, p in inner.items()]))


def put(fields: Fields, path: str, value: Val) -> Fields:
    """fields with a dotted path set: documents on the way are made, scalars on the way are replaced."""
    head, *rest = _parts(path)
    return {**fields, head: _put(fields.get(head), rest, value)}


def _put(v: Val | None, rest: list[str], value: Val) -> Val:
    if not rest:
        return value
    name, *more = rest
    if v is None or not isinstance(v.type, T.StructType):
        inner = _put(None, more, value)
        return Val(F.struct(inner.col.alias(name)), T.StructType([T.StructField(name, inner.type)]))
    old = Val(v.col.getField(name), v.type[name].dataType) if name in v.type.names else None
    made = with_field(v, name, _put(old, more, value))
    # a missing document on the way is made as well
    bare = _put(None, more, value)
    empty = F.struct(*[(bare.col if f.name == name and bare.type == f.dataType else F.lit(None).cast(f.dataType)).alias(f.name) for f in made.type])
    return Val(F.when(v.col.isNotNull(), made.col).otherwise(empty), made.type)


def remove(fields: Fields, path: str) -> Fields:
    head, *rest = _parts(path)
    if head not in fields:
        return fields
    if not rest:
        return {k: v for k, v in fields.items() if k != head}
    return {**fields, head: _remove(fields[head], rest)}


def _remove(v: Val, rest: list[str]) -> Val:
    name, *more = rest
    if not isinstance(v.type, T.StructType) or name not in v.type.names:
        return v
    if not more:
        return with_field(v, name, None)
    return with_field(v, name, _remove(Val(v.col.getField(name), v.type[name].dataType), more))


def nothing() -> Val:
    return literal(None)
