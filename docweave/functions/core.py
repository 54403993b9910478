"""Literals, control flow, variables, fields, comparison and truth."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import ExpectedDocument, InvalidArgument
from docweave.functions.base import META, Scope, arguments, array_operand, branch, compile_expression, guard, operator, options, reject, unwrap, walk
from docweave.values import BOOL, DOUBLE, INT, Val, cast, common, literal, missing, null, order, truthy


@operator("$literal", "$const")
def _literal(name: str, e: Any, scope: Scope) -> Val:
    return literal(e)


@operator("$expr")
def _expr(name: str, e: Any, scope: Scope) -> Val:
    return compile_expression(e, scope)


def choose(cases: list[tuple[Column, Val]], other: Val | None, on_none: Column | None = None) -> Val:
    """The value of the first case that holds."""
    kind = common([v.type for _, v in cases] + ([other.type] if other else []))
    out: Column | None = None
    for when, v in cases:
        out = F.when(when, cast(v, kind)) if out is None else out.when(when, cast(v, kind))
    if other is not None:
        out = out.otherwise(cast(other, kind))
    elif on_none is not None:
        out = out.otherwise(on_none)
    return Val(out, kind)


@operator("$cond")
def _cond(name: str, e: Any, scope: Scope) -> Val:
    if isinstance(e, dict):
        options(name, e, ("if", "then", "else"), ("if", "then", "else"))
        parts = [e["if"], e["then"], e["else"]]
    else:
        parts = arguments(name, e, 3)
    test = truthy(compile_expression(parts[0], scope))
    yes = branch(scope, test, lambda s: compile_expression(parts[1], s))
    no = branch(scope, ~test, lambda s: compile_expression(parts[2], s))
    if yes.missing and no.missing:
        return missing()
    return choose([(test, yes)], no)


@operator("$switch")
def _switch(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("branches", "default"), ("branches",))
    if not isinstance(e["branches"], list) or not e["branches"]:
        raise InvalidArgument("$switch needs branches")
    cases, before = [], F.lit(False)
    for b in e["branches"]:
        options(name, b, ("case", "then"), ("case", "then"))
        test = truthy(branch(scope, ~before, lambda s, b=b: compile_expression(b["case"], s)))
        cases.append((test, branch(scope, ~before & test, lambda s, b=b: compile_expression(b["then"], s))))
        before = before | test
    if "default" in e:
        return choose(cases, branch(scope, ~before, lambda s: compile_expression(e["default"], s)))
    found = choose(cases, None)
    return Val(guard(scope, ~before, "$switch: no branch holds and there is no default", found.col), found.type)


@operator("$ifNull")
def _if_null(name: str, e: Any, scope: Scope) -> Val:
    if not isinstance(e, list) or len(e) < 2:
        raise InvalidArgument("$ifNull takes at least two operands")
    values = [compile_expression(x, scope) for x in e]
    kind = common([v.type for v in values])
    return Val(F.coalesce(*[cast(v, kind) for v in values]), kind)


def variable_name(name: str) -> str:
    if not name or not name[0].islower() or not all(c.isalnum() or c == "_" for c in name):
        raise InvalidArgument(f"'{name}' is no name for a variable")
    return name


def bound(v: Val) -> Val:
    """A missing value is bound as null."""
    return null() if v.missing else v


@operator("$let")
def _let(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("vars", "in"), ("vars", "in"))
    if not isinstance(e["vars"], dict):
        raise InvalidArgument("$let: vars must be a document")
    new = {variable_name(k) if k != "CURRENT" else k: bound(compile_expression(v, scope)) for k, v in e["vars"].items()}
    return compile_expression(e["in"], scope.bind(**new))


@operator("$getField")
def _get_field(name: str, e: Any, scope: Scope) -> Val:
    if isinstance(e, dict) and not any(k.startswith("$") for k in e):
        options(name, e, ("field", "input"), ("field",))
        key, source = e["field"], compile_expression(e.get("input", "$$CURRENT"), scope)
    else:
        key, source = e, scope.document()
    key = compile_expression(key, scope)
    if not isinstance(key.type, T.StringType):
        return reject(scope, InvalidArgument("$getField: field must be a string"))
    if source.null:
        return null()
    if key.literal:
        return walk(source, [key.const]) if source.document or source.dynamic else missing()
    if isinstance(source.type, T.MapType):
        return Val(F.try_element_at(source.col, key.col), source.type.valueType)
    if not isinstance(source.type, T.StructType):
        return missing()
    fields = [Val(source.col.getField(f.name), f.dataType) for f in source.type]
    kind = common([f.type for f in fields])
    return choose([(key.col == f.name, Val(cast(v, kind), kind)) for f, v in zip(source.type, fields, strict=True)], None) if fields else missing()


def with_field(source: Val, name: str, value: Val | None) -> Val:
    """A struct with one field set, or without it."""
    kept = [f for f in source.type if f.name != name]
    at = source.type.names.index(name) if name in source.type.names else len(kept)
    fields = [(f, source.col.getField(f.name)) for f in kept]
    if value is not None:
        fields.insert(at, (T.StructField(name, value.type), value.col))
    if not fields:
        return literal({})
    built = F.struct(*[c.alias(f.name) for f, c in fields])
    return Val(F.when(source.col.isNotNull(), built), T.StructType([f for f, _ in fields]))


@operator("$setField", "$unsetField")
def _set_field(name: str, e: Any, scope: Scope) -> Val:
    options(name, e, ("field", "input", "value"), ("field", "input") + (("value",) if name == "$setField" else ()))
    key = compile_expression(e["field"], scope)
    if not key.literal or not isinstance(key.const, str):
        raise InvalidArgument(f"{name}: field must be a constant string")
    source = compile_expression(e["input"], scope)
    if source.null:
        return null()
    gone = name == "$unsetField" or e["value"] == "$$REMOVE"
    value = None if gone else compile_expression(e["value"], scope)
    if value is not None and value.missing:
        value = None
    if isinstance(source.type, T.MapType):
        kept = F.map_filter(source.col, lambda k, v: k != F.lit(key.const))
        return Val(kept if value is None else F.map_concat(kept, F.create_map(F.lit(key.const), cast(value, source.type.valueType))), source.type)
    if not isinstance(source.type, T.StructType):
        return reject(scope, ExpectedDocument(f"{name}: input must be a document"))
    return with_field(source, key.const, value)


#: What $meta may be asked for. Only the two of $geoNear are ever there.
META_NAMES = ("geoNearDistance", "geoNearPoint", "indexKey", "recordId", "sortKey", "randVal", "textScore")


@operator("$meta")
def _meta(name: str, e: Any, scope: Scope) -> Val:
    if not isinstance(e, str) or e.split(".")[0] not in META_NAMES:
        raise InvalidArgument("$meta: unknown name")
    if META not in scope.schema.names:
        return missing()
    return walk(Val(F.col(META), scope.schema[META].dataType), e.split("."))


@operator("$rand")
def _rand(name: str, e: Any, scope: Scope) -> Val:
    if e not in ({}, []):
        raise InvalidArgument("$rand takes no operands")
    return Val(F.rand(), DOUBLE)


# comparison


@operator("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$cmp")
def _compare(name: str, e: Any, scope: Scope) -> Val:
    a, b = (compile_expression(x, scope) for x in arguments(name, e, 2))
    equal, less = order(*comparable(a, b))
    made = {"$eq": equal, "$ne": ~equal, "$gt": ~(equal | less), "$gte": ~less, "$lt": less, "$lte": equal | less}
    if name == "$cmp":
        return Val(F.when(equal, 0).when(less, -1).otherwise(1).cast("int"), INT)
    return Val(made[name], BOOL)


def comparable(a: Val, b: Val) -> tuple[Val, Val]:
    """A VARIANT takes the type of what it is compared with; values of other types in it count as missing."""
    if a.dynamic and b.dynamic:
        return Val(F.to_json(a.col), T.StringType()), Val(F.to_json(b.col), T.StringType())
    if a.dynamic:
        return (b if b.null else Val(F.try_variant_get(a.col, "$", b.type.simpleString()), b.type)), b
    if b.dynamic:
        y, x = comparable(b, a)
        return x, y
    return a, b


@operator("$and", "$or")
def _both(name: str, e: Any, scope: Scope) -> Val:
    if not isinstance(e, list):
        raise InvalidArgument(f"{name} takes an array")
    found = F.lit(name == "$and")
    for x in e:
        going = found if name == "$and" else ~found
        test = truthy(branch(scope, going, lambda s, x=x: compile_expression(x, s)))
        # CASE keeps later operands, and their errors, out once the result is known
        found = F.when(found, test).otherwise(F.lit(False)) if name == "$and" else F.when(found, F.lit(True)).otherwise(test)
    return Val(found, BOOL)


@operator("$not")
def _not(name: str, e: Any, scope: Scope) -> Val:
    (x,) = arguments(name, e, 1)
    return Val(~truthy(compile_expression(x, scope)), BOOL)


@operator("$in")
def _in(name: str, e: Any, scope: Scope) -> Val:
    needle, hay = (compile_expression(x, scope) for x in arguments(name, e, 2))
    hay = array_operand(name, hay, scope, "error")
    return Val(F.exists(hay.col, lambda x: order(Val(x, hay.type.elementType), needle)[0]), BOOL)


@operator("$allElementsTrue", "$anyElementTrue")
def _elements(name: str, e: Any, scope: Scope) -> Val:
    a = array_operand(name, compile_expression(unwrap(e), scope), scope, "error")
    each = F.forall if name == "$allElementsTrue" else F.exists
    return Val(each(a.col, lambda x: truthy(Val(x, a.type.elementType))), BOOL)
