"""Stages that change documents one by one: project, set, unset, replace, redact."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import ExpectedDocument, InvalidStage
from docweave.functions.base import Scope, compile_expression, hidden
from docweave.operators.base import stage
from docweave.plans.frame import Context, Frame, document_columns, whole
from docweave.plans.projection import columns, fields_of, project, put, remove
from docweave.values import Val, is_stamp, null, quoted


@stage("$project")
def project_stage(spec: Any, frame: Frame, context: Context) -> Frame:
    return Frame(_ordered_input(frame).select(*columns(project(spec, frame.scope(context)))))


def _ordered_input(frame: Frame):
    """Fields that an order rests on may go, so it is applied before."""
    return frame.ordered()


@stage("$set", "$addFields")
def set_stage(spec: Any, frame: Frame, context: Context) -> Frame:
    """Fields are set one after another; later ones see earlier ones. What is missing becomes null."""
    if not isinstance(spec, dict) or not spec:
        raise InvalidStage("$set takes fields")
    df = _ordered_input(frame)
    for path, e in spec.items():
        v = compile_expression(e, Scope(df.schema, context.variables))
        df = df.select(*columns(put(fields_of(df.schema), path, null() if v.missing else v)))
    return Frame(df)


@stage("$unset")
def unset(spec: Any, frame: Frame, context: Context) -> Frame:
    paths = spec if isinstance(spec, list) else [spec]
    if not paths or not all(isinstance(p, str) and p and not p.startswith("$") for p in paths):
        raise InvalidStage("$unset takes a path or paths")
    fields = fields_of(frame.schema)
    for p in paths:
        fields = remove(fields, p)
    return Frame(_ordered_input(frame).select(*columns(fields)))


@stage("$replaceRoot", "$replaceWith")
def replace_root(spec: Any, frame: Frame, context: Context) -> Frame:
    return _replace(spec, frame, context)


def _replace(spec: Any, frame: Frame, context: Context) -> Frame:
    if isinstance(spec, dict) and set(spec) == {"newRoot"}:
        spec = spec["newRoot"]
    v = compile_expression(spec, frame.scope(context))
    if not isinstance(v.type, T.StructType) or is_stamp(v.type):
        raise ExpectedDocument("the new root must be a document")
    df = _ordered_input(frame)
    checked = df.withColumn("__root", F.coalesce(v.col, F.raise_error(F.lit("the new root must be a document")).cast(v.type)))
    return Frame(checked.select(*[F.col("__root").getField(n).alias(n) for n in v.type.names], *[c for c in df.columns if hidden(c)]))


@stage("$redact")
def redact(spec: Any, frame: Frame, context: Context) -> Frame:
    """Keep, prune or descend, decided anew for each document on the way down; the descent ends with the schema."""
    df = _ordered_input(frame)
    names = document_columns(df)
    kind = T.StructType([df.schema[n] for n in names])
    made = _redact(Val(whole(df), kind), spec, context, 0)
    out = df.withColumn("__kept", made).where(F.col("__kept").isNotNull())
    return Frame(out.select(*[F.col("__kept").getField(n).alias(n) for n in names], *[quoted(c) for c in df.columns if hidden(c)]))


def _redact(v: Val, spec: Any, context: Context, depth: int) -> Column:
    """The document as it is left, NULL if it goes."""
    scope = Scope(v.type, context.variables, None, v)
    choice = compile_expression(spec, scope)
    if not isinstance(choice.type, T.StringType):
        raise InvalidStage("$redact gives $$DESCEND, $$PRUNE or $$KEEP")
    inner = F.struct(*[_inside(Val(v.col.getField(f.name), f.dataType), spec, context, depth + 1).alias(f.name) for f in v.type]) if len(v.type) else v.col
    wrong = F.raise_error(F.lit("$redact gives $$DESCEND, $$PRUNE or $$KEEP")).cast(v.type)
    return F.when(v.col.isNull(), F.lit(None)).when(choice.col == "descend", inner).when(choice.col == "keep", v.col).when(choice.col == "prune", F.lit(None)).otherwise(wrong)


def _inside(v: Val, spec: Any, context: Context, depth: int) -> Column:
    if isinstance(v.type, T.StructType) and not is_stamp(v.type):
        return _redact(v, spec, context, depth)
    if v.array and isinstance(v.type.elementType, T.StructType | T.ArrayType):
        item = v.type.elementType
        if isinstance(item, T.StructType):
            # pruned elements leave; elements that were null stay
            kept = F.transform(v.col, lambda x: F.struct(x.isNull().alias("was"), _inside(Val(x, item), spec, context, depth).alias("now")))
            return F.transform(F.filter(kept, lambda x: x["was"] | x["now"].isNotNull()), lambda x: x["now"])
        return F.transform(v.col, lambda x: _inside(Val(x, item), spec, context, depth))
    return v.col
