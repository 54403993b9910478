"""Stages that write: out and merge. They run at once and hand on no rows."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.errors import InvalidArgument, InvalidStage
from docweave.functions.base import ROW_ID, Scope
from docweave.operators.base import stage
from docweave.plans.frame import Context, Frame, document_columns, settle, visible
from docweave.plans.projection import columns
from docweave.values import Val, cast, common, quoted


class MergeError(InvalidArgument):
    """Raised after all other rows were merged. code: 11000 for duplicates, 13113 for rows without a match."""

    def __init__(self, message: str, code: int):
        super().__init__(message)
        self.code = code


def _target(into: Any, context: Context):
    if isinstance(into, str) and into:
        return context.database, into
    if isinstance(into, dict) and set(into) == {"db", "coll"} and all(isinstance(v, str) for v in into.values()):
        return context.database.sibling(into["db"]), into["coll"]
    raise InvalidStage("a target is a name, or db and coll")


def _identified(df: DataFrame) -> DataFrame:
    from docweave.sources.database import new_id

    if "_id" not in df.columns:
        return df.select(new_id().alias("_id"), "*")
    return df.withColumn("_id", F.coalesce(F.col("_id"), new_id().cast(df.schema["_id"].dataType)))


@stage("$out", sink=True)
def out(spec: Any, frame: Frame, context: Context) -> Frame:
    """Replace a collection: a new version is written beside the old one and then takes its place."""
    if isinstance(spec, dict) and "timeseries" in spec:
        raise InvalidStage("$out writes no time series")
    database, name = _target(spec, context)
    database.write(name, _identified(visible(frame.df)))
    return Frame(context.database.spark.range(0).select())


#: What may be asked for together.
_LEGAL = {("replace", "insert"), ("replace", "discard"), ("replace", "fail"), ("merge", "insert"), ("merge", "discard"), ("merge", "fail"), ("keepExisting", "insert"), ("fail", "insert")}


@stage("$merge", sink=True)
def merge(spec: Any, frame: Frame, context: Context) -> Frame:
    options = {"into": spec} if isinstance(spec, str) else spec
    if not isinstance(options, dict) or not {"into"} <= set(options) <= {"into", "on", "whenMatched", "whenNotMatched"}:
        raise InvalidStage("$merge takes into, on, whenMatched and whenNotMatched")
    into = options["into"]
    database, name = _target({"db": context.database.name, **into} if isinstance(into, dict) else into, context)
    on = options.get("on", "_id")
    on = [on] if isinstance(on, str) else on
    if not isinstance(on, list) or not on or not all(isinstance(k, str) for k in on):
        raise InvalidStage("$merge: on takes field names")
    matched, other = options.get("whenMatched", "merge"), options.get("whenNotMatched", "insert")
    if isinstance(matched, list) or (matched, other) not in _LEGAL:
        raise InvalidStage("$merge: whenMatched and whenNotMatched do not go together")
    rows = visible(frame.numbered().withColumnRenamed(ROW_ID, "__n"))
    if "_id" in on:
        rows = _identified(rows)
    found, error = merged(database.frame(name), settle(rows), on, matched, other)
    database.write(name, found)
    if error:
        raise error
    return Frame(context.database.spark.range(0).select())


def merged(target: DataFrame, rows: DataFrame, on: list[str], matched: str, other: str) -> tuple[DataFrame, MergeError | None]:
    """The target after an upsert of rows (numbered by __n), and what was wrong. Rows with equal keys are taken one after another."""
    if target.columns == ["_id"] and "_id" in rows.columns and not target.limit(1).count():
        target = target.select(F.col("_id").cast(rows.schema["_id"].dataType).alias("_id"))
    names = list(dict.fromkeys([*document_columns(target), *[c for c in rows.columns if c != "__n"]]))
    kinds = {n: common([d.schema[n].dataType for d in (target, rows) if n in d.columns]) for n in names}
    scope_t, scope_s = Scope(target.schema), Scope(rows.schema)

    def keys(scope: Scope, prefix: str):
        out = []
        for i, k in enumerate(on):
            v, w = scope_t.field(k), scope_s.field(k)
            kind = common([v.type, w.type])
            own = scope.field(k)
            out.append((cast(own, kind) if not own.missing else F.lit(None).cast(kind)).alias(f"{prefix}{i}"))
        return out

    fit = lambda df, p: [(cast(Val(quoted(n), df.schema[n].dataType), kinds[n]) if n in df.columns else F.lit(None).cast(kinds[n])).alias(f"{p}{i}") for i, n in enumerate(names)]
    t = target.select(*keys(scope_t, "__tk"), *fit(target, "__t"), F.lit(True).alias("__there"))
    # each key's rows folded in order: replacements keep the last, merges the last of each field, the rest the first
    s = rows.select(*keys(scope_s, "__sk"), *fit(rows, "__s"), "__n")
    sk = [f"__sk{i}" for i in range(len(on))]
    if matched == "merge":
        fold = [F.max_by(F.col(f"__s{i}"), F.when(F.col(f"__s{i}").isNotNull(), F.col("__n"))).alias(f"__s{i}") for i in range(len(names))]
    else:
        pick = F.max_by if matched == "replace" else F.min_by
        fold = [pick(F.struct(f"__s{i}"), F.col("__n")).getField(f"__s{i}").alias(f"__s{i}") for i in range(len(names))]
    s = s.groupBy(*sk).agg(*fold, F.count("*").alias("__times"))
    condition = reduce(lambda a, b: a & b, [F.col(f"__tk{i}").eqNullSafe(F.col(f"__sk{i}")) for i in range(len(on))])
    joined = settle(t.join(s, condition, "full_outer"))
    there, given = F.col("__there").isNotNull(), F.col("__times").isNotNull()
    doubled = t.groupBy(*[f"__tk{i}" for i in range(len(on))]).count().where("count > 1").select(*[F.col(f"__tk{i}").alias(f"__sk{i}") for i in range(len(on))])
    error: MergeError | None = None
    twice = joined.where(there & given).join(settle(doubled), [F.col(f"__tk{i}").eqNullSafe(doubled[f"__sk{i}"]) for i in range(len(on))], "left_semi")
    many = twice.limit(1).count() > 0
    if many:
        error = MergeError("the target holds several documents with the same key", 11000)
    elif matched == "fail" and joined.where((there & given) | (F.col("__times") > 1)).limit(1).count():
        error = MergeError("a document of the target matches", 11000)
    elif other == "fail" and joined.where(~there & given).limit(1).count():
        error = MergeError("no document of the target matches", 13113)
    out: dict[str, Val] = {}
    for i, n in enumerate(names):
        old, new = F.col(f"__t{i}"), F.col(f"__s{i}")
        both = {"replace": new, "merge": F.coalesce(new, old), "keepExisting": old, "fail": old}[matched]
        if n == "_id" and "_id" not in rows.columns:
            both = old
        out[n] = Val(F.when(there & given, both).when(there, old).otherwise(new), kinds[n])
    if many:  # rows that several documents match change none of them
        joined = joined.join(doubled.select(*[F.col(f"__sk{i}").alias(f"__dk{i}") for i in range(len(on))], F.lit(True).alias("__many")), reduce(lambda a, b: a & b, [F.col(f"__tk{i}").eqNullSafe(F.col(f"__dk{i}")) for i in range(len(on))]), "left")
        out = {n: Val(F.when(F.col("__many").isNotNull(), F.col(f"__t{i}")).otherwise(out[n].col), v.type) for i, (n, v) in enumerate(out.items())}
    kept = joined.where(there) if other != "insert" else joined
    return _identified(kept.select(*columns(out))) if "_id" in names else kept.select(*columns(out)), error
