"""Updates: modifiers, replacements and pipelines over the rows that match."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.errors import InvalidUpdate
from docweave.plans.frame import Context, Frame, document_columns, whole
from docweave.plans.projection import columns, fields_of, put, remove
from docweave.values import Val, cast, common, literal

if TYPE_CHECKING:
    from docweave.sources.database import Database

_HELPERS = ("__hit", "__n")


@dataclass
class Update:
    modifiers: list[tuple[str, str, Any]] = field(default_factory=list)
    replacement: dict | None = None
    pipeline: list | None = None

    @staticmethod
    def parse(change: Any) -> Update:
        if isinstance(change, list):
            allowed = ("$set", "$addFields", "$unset", "$project", "$replaceRoot", "$replaceWith")
            if not change or any(not isinstance(s, dict) or len(s) != 1 or next(iter(s)) not in allowed for s in change):
                raise InvalidUpdate("an update pipeline sets, unsets, projects and replaces")
            return Update(pipeline=change)
        if not isinstance(change, dict):
            raise InvalidUpdate("an update is a document or a pipeline")
        operators = [k for k in change if k.startswith("$")]
        if not operators:
            return Update(replacement=change)
        if len(operators) != len(change):
            raise InvalidUpdate("operators and fields do not mix")
        out = Update()
        for op, fields in change.items():
            if op not in ("$set", "$unset", "$inc") or not isinstance(fields, dict):
                raise InvalidUpdate(f"{op} is no update operator here")
            for path, value in fields.items():
                if path == "_id":
                    raise InvalidUpdate("_id does not change")
                if op == "$inc" and (isinstance(value, bool) or not isinstance(value, int | float)):
                    raise InvalidUpdate("$inc takes numbers")
                out.modifiers.append((op, path, value))
        return out


def changed_fields(df: DataFrame, spec: Update, database: Database) -> dict[str, Val]:
    """The fields of every row as the update would leave them."""
    schema = df.drop(*_HELPERS).schema
    fields = fields_of(schema)
    if spec.replacement is not None:
        made = {k: literal(v) for k, v in spec.replacement.items() if k != "_id"}
        return ({"_id": fields["_id"]} if "_id" in fields else {}) | made
    if spec.pipeline is not None:
        raise AssertionError("pipelines run over whole frames")
    for op, path, value in spec.modifiers:
        if op == "$unset":
            fields = remove(fields, path)
            continue
        old = _at(fields, path)
        if op == "$set":
            fields = put(fields, path, literal(value))
            continue
        if old is None or old.null:
            fields = put(fields, path, literal(value))
            continue
        if not old.numeric:
            raise InvalidUpdate("$inc takes numeric fields")
        by = literal(value)
        kind = common([old.type, by.type])
        real = F.coalesce(old.col.cast("double"), F.lit(0.0)) + float(value)
        fields = put(fields, path, Val(real.cast(kind), kind))
    return fields


def _at(fields: dict[str, Val], path: str) -> Val | None:
    from docweave.functions.base import walk

    head, *rest = path.split(".")
    if head not in fields:
        return None
    v = walk(fields[head], rest)
    return None if v.missing else v


def updated(marked: DataFrame, spec: Update, database: Database) -> DataFrame:
    """All rows, those with __hit changed; helper columns stay."""
    if spec.pipeline is not None:
        from docweave.operators import run_pipeline
        from docweave.operators.joins import _union

        hit = run_pipeline(spec.pipeline, Frame(marked.where("__hit").withColumnRenamed("__n", "__rid").drop("__hit")), Context(database)).df
        # the row number rides along as the hidden row id; where a stage dropped it the order of rows is free
        hit = hit.withColumnRenamed("__rid", "__n") if "__rid" in hit.columns else hit.withColumn("__n", F.lit(None).cast("long"))
        return _union(marked.where("not __hit"), hit.withColumn("__hit", F.lit(True)))
    old, new = fields_of(marked.drop(*_HELPERS).schema), changed_fields(marked, spec, database)
    out: dict[str, Val] = {}
    for name in dict.fromkeys([*old, *new]):
        kind = common([v.type for v in (old.get(name), new.get(name)) if v is not None])
        was = cast(old[name], kind) if name in old else F.lit(None).cast(kind)
        now = cast(new[name], kind) if name in new else F.lit(None).cast(kind)
        out[name] = Val(F.when(F.col("__hit"), now).otherwise(was), kind)
    return marked.select(*columns(out), *_HELPERS)


def described(before: DataFrame, after: DataFrame) -> DataFrame:
    """documentKey, images before and after, and updateDescription of the rows that differ."""
    b = before.select(F.col("__n").alias("n"), F.to_json(whole(before.drop("__n"))).alias("fullDocumentBeforeChange"))
    names = document_columns(after.drop("__n"))
    key = F.to_json(F.struct("_id")) if "_id" in names else F.lit(None).cast("string")
    a = after.select(F.col("__n").alias("m"), key.alias("documentKey"), F.to_json(whole(after.drop("__n"))).alias("fullDocument"))
    pairs = b.join(a, F.col("n").eqNullSafe(F.col("m"))).where("fullDocumentBeforeChange <> fullDocument")
    parts = lambda c: F.from_json(c, "map<string,string>")
    old, new = parts(F.col("fullDocumentBeforeChange")), parts(F.col("fullDocument"))
    set_ = F.map_filter(new, lambda k, v: ~v.eqNullSafe(F.try_element_at(old, k)))
    gone = F.filter(F.map_keys(old), lambda k: ~F.map_contains_key(new, k))
    return pairs.select("documentKey", "fullDocumentBeforeChange", "fullDocument", F.to_json(F.struct(set_.alias("updatedFields"), gone.alias("removedFields"))).alias("updateDescription"))


def upsert_row(filter_: dict, spec: Update, database: Database) -> DataFrame:
    """The document that an upsert makes: plain equalities of the filter, then the update."""
    from docweave.operators.rows import literal_rows

    seed: dict[str, Any] = {}
    for k, v in filter_.items():
        if k.startswith("$"):
            continue
        if isinstance(v, dict) and set(v) == {"$eq"}:
            seed[k] = v["$eq"]
        elif not (isinstance(v, dict) and any(x.startswith("$") for x in v)):
            seed[k] = v
    base = database.spark.range(1).select(F.lit(True).alias("__hit"), F.lit(0).cast("long").alias("__n"))
    fields: dict[str, Val] = {}
    for path, value in seed.items():
        fields = put(fields, path, literal(value))
    row = base.select(*columns(fields), *_HELPERS)
    if spec.replacement is not None:
        kept = {"_id": seed["_id"]} if "_id" in seed else {}
        return literal_rows([{k: {"$literal": v} for k, v in {**kept, **spec.replacement}.items()}], Context(database))
    return updated(row, spec, database).drop(*_HELPERS)


