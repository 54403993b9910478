"""The scope that expressions compile in, the registry of operators, and what operators share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import ExpectedNumeric, InvalidArgument, UnsupportedOperator
from docweave.values import BOOL, DOUBLE, LONG, NULL, STRING, Val, literal, missing, null, quoted, rank

#: Name of a hidden struct column, which no document shows: what $geoNear notes for $meta.
META, ROW_ID = "__meta", "__rid"
#: In correlated pipelines: the number of the outer row, and its variables.
OWNER, LET = "__owner", "__let"


def hidden(name: str) -> bool:
    return name in (META, ROW_ID, OWNER) or name.startswith(LET)


@dataclass(frozen=True)
class Scope:
    """schema: of the present document; variables: by name; errors: in filters, the conditions under which evaluation fails (else it raises)."""

    schema: T.StructType
    variables: dict[str, Val] = field(default_factory=dict)
    errors: list | None = None
    root: Val | None = None

    def bind(self, **new: Val) -> Scope:
        return replace(self, variables={**self.variables, **new})

    def document(self) -> Val:
        """The whole document as one value."""
        if self.root is not None:
            return self.root
        shown = [f for f in self.schema if not hidden(f.name)]
        if not shown:
            return literal({})
        return Val(F.struct(*[quoted(f.name).alias(f.name) for f in shown]), T.StructType(shown))

    def field(self, path: str) -> Val:
        head, *rest = path.split(".")
        if "" in (head, *rest):
            raise InvalidArgument(f"empty part in path '{path}'")
        if self.root is not None:
            return walk(self.root, [head, *rest])
        if head not in self.schema.names or hidden(head):
            return missing()
        return walk(Val(quoted(head), self.schema[head].dataType), rest)


def walk(v: Val, parts: list[str]) -> Val:
    """The field at a path of names. Arrays are not entered."""
    for name in parts:
        if isinstance(v.type, T.StructType):
            if name not in v.type.names:
                return missing()
            v = Val(v.col.getField(name), v.type[name].dataType)
        elif isinstance(v.type, T.MapType):
            v = Val(F.try_element_at(v.col, F.lit(name)), v.type.valueType)
        elif v.dynamic:
            v = Val(F.try_variant_get(v.col, f"$['{name}']" if "'" not in name else f'$["{name}"]', "variant"), v.type)
        else:
            return missing()
    return v


Compiler = Callable[[Any, Scope], Val]
OPERATORS: dict[str, Callable[[str, Any, Scope], Val]] = {}


def operator(*names: str):
    def note(function):
        for name in names:
            OPERATORS[name] = function
        return function

    return note


#: Variables that every scope has.
PREDEFINED = ("ROOT", "CURRENT", "DESCEND", "KEEP", "PRUNE")


def compile_expression(e: Any, scope: Scope) -> Val:
    """An expression document as a typed Column."""
    if isinstance(e, str) and e.startswith("$$"):
        name, *rest = e[2:].split(".")
        if name in scope.variables:
            return walk(scope.variables[name], rest)
        if name in ("ROOT", "CURRENT"):
            return walk(scope.document(), rest) if rest or scope.root is not None or name == "ROOT" else scope.document()
        if name in ("DESCEND", "KEEP", "PRUNE") and not rest:
            return literal(name.lower())
        raise InvalidArgument(f"use of undefined variable: {name}")
    if isinstance(e, str) and e.startswith("$"):
        return scope.field(e[1:])
    if isinstance(e, dict):
        names = [k for k in e if isinstance(k, str) and k.startswith("$")]
        if names:
            if len(e) != 1:
                raise InvalidArgument("an operator stands alone in its document")
            name = names[0]
            if name not in OPERATORS:
                raise UnsupportedOperator(name)
            return OPERATORS[name](name, e[name], scope)
        fields = {k: compile_expression(v, scope) for k, v in e.items()}
        fields = {k: v for k, v in fields.items() if not v.missing}
        if not fields:
            return literal({})
        return Val(F.struct(*[v.col.alias(k) for k, v in fields.items()]), T.StructType([T.StructField(k, v.type) for k, v in fields.items()]))
    if isinstance(e, list | tuple):
        return array_of([compile_expression(x, scope) for x in e])
    return literal(e)


def array_of(items: list[Val]) -> Val:
    """An array of values; what is missing becomes null."""
    from docweave.values import cast, common

    if not items:
        return literal([])
    kind = common([x.type for x in items])
    return Val(F.array(*[cast(x, kind) for x in items]), T.ArrayType(kind))


# errors


def guard(scope: Scope, bad: Column, message: str, value: Column) -> Column:
    """value, but where bad holds: an error, or in filters a failed evaluation."""
    if scope.errors is not None:
        scope.errors.append(F.coalesce(bad, F.lit(False)))
        return F.when(~F.coalesce(bad, F.lit(False)), value)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message))).otherwise(value)


def branch(scope: Scope, when: Column, compile_: Callable[[Scope], Val]) -> Val:
    """Compile a part whose errors only count where `when` holds."""
    if scope.errors is None:
        return compile_(scope)
    inner: list = []
    v = compile_(replace(scope, errors=inner))
    scope.errors.extend(when & e for e in inner)
    return v


def reject(scope: Scope, error: Exception) -> Val:
    """A value that can never be had: rejected now, or in filters a failed evaluation."""
    if scope.errors is None:
        raise error
    scope.errors.append(F.lit(True))
    return null()


# operands


def arguments(name: str, e: Any, least: int, most: int | None = None) -> list:
    """Operands of an operator of fixed arity, which come in an array."""
    most = least if most is None else most
    if not isinstance(e, list | tuple) or not least <= len(e) <= most:
        raise InvalidArgument(f"{name} takes an array of {least}{'' if most == least else f' to {most}'} operands")
    return list(e)


def variadic(e: Any) -> list:
    return list(e) if isinstance(e, list | tuple) else [e]


def unwrap(e: Any) -> Any:
    """x or [x]."""
    return e[0] if isinstance(e, list | tuple) and len(e) == 1 else e


def single(name: str, e: Any) -> Any:
    """x or [x], but no longer array."""
    if isinstance(e, list | tuple):
        if len(e) != 1:
            raise InvalidArgument(f"{name} takes one operand")
        return e[0]
    return e


def options(name: str, e: Any, allowed: tuple[str, ...], needed: tuple[str, ...] = ()) -> dict:
    if not isinstance(e, dict):
        raise InvalidArgument(f"{name} takes a document")
    for k in e:
        if k not in allowed:
            raise InvalidArgument(f"{name} has no option '{k}'")
    for k in needed:
        if k not in e:
            raise InvalidArgument(f"{name} needs '{k}'")
    return e


def strict_number(name: str, v: Val, scope: Scope) -> Column:
    """A DOUBLE; null and missing are errors."""
    if v.dynamic:
        real = F.try_variant_get(v.col, "$", "double")
    elif v.numeric:
        real = v.col.cast("double")
    else:
        reject(scope, ExpectedNumeric(f"{name} expects a numeric value"))
        return F.lit(None).cast("double")
    if scope.errors is None:  # one copy of the operand, however deep expressions nest
        return F.coalesce(real, F.raise_error(F.lit(f"{name}: expected numeric value")).cast("double"))
    return guard(scope, real.isNull(), f"{name}: expected numeric value", real)


def loose_number(name: str, v: Val, scope: Scope) -> Column:
    """A DOUBLE; null stays null, other types are errors."""
    if v.null:
        return F.lit(None).cast("double")
    if v.dynamic:
        return F.try_variant_get(v.col, "$", "double")
    if not v.numeric:
        reject(scope, ExpectedNumeric(f"{name} expects a numeric value"))
        return F.lit(None).cast("double")
    return v.col.cast("double")


def number(col: Column, integral: bool) -> Val:
    """A result in DOUBLE, narrowed where it is known to be integral."""
    return Val(col.cast("long"), LONG) if integral else Val(col, DOUBLE)


def text_of(name: str, v: Val, scope: Scope, null_as: Column | None = None) -> Column:
    """A string operand; null stays null unless null_as is given."""
    if v.null:
        return F.lit(None).cast("string") if null_as is None else null_as
    if v.dynamic:
        col = F.try_variant_get(v.col, "$", "string")
    elif isinstance(v.type, T.StringType):
        col = v.col
    else:
        reject(scope, InvalidArgument(f"{name} expects a string"))
        return F.lit(None).cast("string")
    return col if null_as is None else F.coalesce(col, null_as)


def array_operand(name: str, v: Val, scope: Scope, nullish: str = "null") -> Val:
    """An array operand; nullish: 'null' lets null through, 'error' does not."""
    if v.array:
        return v if nullish == "null" else Val(guard(scope, v.col.isNull(), f"{name} expects an array", v.col), v.type)
    if v.null and nullish == "null":
        return Val(F.lit(None).cast(T.ArrayType(NULL)), T.ArrayType(NULL))
    reject(scope, InvalidArgument(f"{name} expects an array"))
    return Val(F.lit(None).cast(T.ArrayType(NULL)), T.ArrayType(NULL))


def whole(name: str, what: str, v: Val, scope: Scope, least: int | None = None) -> Column:
    """An integral operand as INT; anything else is an error."""
    if not v.numeric:
        reject(scope, InvalidArgument(f"{name}: {what} must be an integer"))
        return F.lit(None).cast("int")
    if v.literal and v.integral:
        if least is not None and v.const < least:
            reject(scope, InvalidArgument(f"{name}: {what} must be at least {least}"))
        return F.lit(v.const).cast("int")
    real = v.col.cast("double")
    bad = real.isNull() | (real != F.rint(real)) | (F.abs(real) > 2147483647.0)
    if least is not None:
        bad = bad | (real < least)
    return guard(scope, bad, f"{name}: {what} must be an integer", F.when(~bad, real).cast("int"))


def constant(name: str, what: str, e: Any, kind: type | tuple) -> Any:
    if not isinstance(e, kind) or isinstance(e, bool) and kind is not bool:
        raise InvalidArgument(f"{name}: {what} must be a constant")
    return e


__all__ = ["BOOL", "LET", "META", "OPERATORS", "OWNER", "ROW_ID", "hidden", "STRING", "Scope", "arguments", "array_of", "array_operand", "branch", "compile_expression", "constant", "guard", "loose_number", "number", "operator", "options", "rank", "reject", "single", "strict_number", "text_of", "unwrap", "variadic", "walk", "whole"]
