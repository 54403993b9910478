"""Stages that bring collections together: lookup, graphLookup, unionWith."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidArgument, InvalidStage, UnsupportedStage
from docweave.functions.base import LET, OWNER, ROW_ID, Scope, compile_expression
from docweave.functions.core import bound, variable_name
from docweave.operators.base import run_pipeline, stage
from docweave.plans.filter import compile_filter
from docweave.plans.frame import Context, Frame, settle, visible, whole
from docweave.plans.projection import columns, fields_of, put
from docweave.values import Val, cast, common, quoted


def _foreign(source: Any, context: Context) -> Frame:
    if isinstance(source, dict):
        if set(source) != {"db", "coll"}:
            raise InvalidStage("from takes a name, or db and coll")
        return Frame(context.database.sibling(source["db"]).frame(source["coll"]))
    return Frame(context.database.frame(source))


def _set(df: DataFrame, path: str, value: Val, drop: tuple[str, ...] = ()) -> DataFrame:
    fields = {k: v for k, v in fields_of(df.schema).items() if k not in drop}
    return df.select(*columns(put(fields, path, value)))


def _elements(v: Val) -> Column:
    """What an array is joined on: its distinct elements, none if it is empty, null if it is null or missing."""
    return F.coalesce(F.array_distinct(v.col), F.array(F.lit(None).cast(v.type.elementType)))


def _keys(v: Val) -> tuple[Val, bool]:
    """The value that is joined on, and whether it is one of an array's elements."""
    return (Val(v.col, v.type.elementType), True) if v.array else (v, False)


@stage("$lookup")
def lookup(spec: Any, frame: Frame, context: Context) -> Frame:
    if not isinstance(spec, dict) or not isinstance(spec.get("as"), str):
        raise InvalidStage("$lookup needs as")
    allowed = {"from", "localField", "foreignField", "as", "let", "pipeline", "__join", "__fields"}
    if set(spec) - allowed:
        raise InvalidStage("$lookup: unknown option")
    both = "localField" in spec and "foreignField" in spec
    if ("localField" in spec) != ("foreignField" in spec):
        raise InvalidStage("$lookup: localField and foreignField come together")
    if "pipeline" not in spec and (not both or "let" in spec or "from" not in spec):
        raise InvalidStage("$lookup needs fields or a pipeline")
    if "from" not in spec:
        if not spec["pipeline"] or "$documents" not in spec["pipeline"][0]:
            raise InvalidStage("$lookup without from needs a pipeline that begins with $documents")
    if "pipeline" in spec:
        return _lookup_pipeline(spec, frame, context, both)
    foreign = _foreign(spec["from"], context)
    if "__fields" in spec:  # later stages read no others
        kept = {*spec["__fields"], spec["foreignField"].split(".")[0]}
        names = [c for c in foreign.df.columns if c in kept] or foreign.df.columns[:1]
        foreign = Frame(foreign.df.select(*map(quoted, names)))
    return _lookup_equal(frame, foreign.df, spec["localField"], spec["foreignField"], spec["as"], context, spec.get("__join"))


def _aligned(local: Val, foreign: Val) -> tuple[Column, Column] | None:
    """Both keys in one type; None if values of such types are never equal."""
    if local.null or foreign.null:
        return None
    try:
        kind = common([local.type, foreign.type])
    except InvalidArgument:
        return None
    return cast(local, kind), cast(foreign, kind)


def _lookup_equal(frame: Frame, foreign: DataFrame, local_field: str, foreign_field: str, as_: str, context: Context, join: str | None) -> Frame:
    df, foreign = frame.df, visible(foreign)
    item = T.StructType(list(foreign.schema))
    local = Scope(df.schema, context.variables).field(local_field)
    other = Scope(foreign.schema, {}).field(foreign_field)
    (own, own_many), (far, far_many) = _keys(local), _keys(other)
    renamed = foreign.select(whole(foreign).alias("__doc"), (far.col if not other.missing else F.lit(None)).alias("__far"))
    if far_many:
        renamed = renamed.withColumn("__far", F.explode(_elements(Val(F.col("__far"), other.type))))
    if other.missing:
        far = Val(F.col("__far"), own.type)
        renamed = renamed.withColumn("__far", F.lit(None).cast(own.type if not own.null else T.StringType()))
    if local.missing:
        own = Val(F.lit(None).cast(far.type if not far.null else T.StringType()), far.type)
    far = Val(F.col("__far"), far.type)
    pair = _aligned(Val(F.col("__own"), own.type if not own.null else T.StringType()), far if not far.null else Val(F.col("__far"), T.StringType()))
    never = pair is None
    on = F.lit(False) if never else pair[0].eqNullSafe(pair[1])  # missing meets null
    how = "inner" if join == "some" else "left"  # some: rows that find something
    if join and join != "some" and not own_many and not far_many:
        keyed = df.withColumn("__own", own.col)
        if join == "anti":
            out = keyed.join(renamed, on, "left_anti").drop("__own")
            return Frame(_set(out, as_, Val(F.array().cast(T.ArrayType(item)), T.ArrayType(item))), frame.order)
        out = keyed.join(renamed, on, join)
        return Frame(_set(out, as_, Val(F.col("__doc"), item), ("__own", "__doc", "__far")), frame.order)
    if join and join != "some":
        from docweave.operators.rows import unwind

        nested = _lookup_equal(frame, foreign, local_field, foreign_field, as_, context, None)
        if join == "anti":
            return Frame(nested.df.where(F.size(quoted(as_)) == 0), nested.order)
        return unwind({"path": f"${as_}", "preserveNullAndEmptyArrays": join == "left"}, nested, context)
    numbered = renamed.withColumn("__i", F.monotonically_increasing_id())
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__doc").alias("v")))), lambda x: x["v"])
    if not own_many and not far_many:
        grouped = numbered.groupBy("__far").agg(listed.alias("__docs"))
        joined = df.withColumn("__own", own.col).join(grouped, on, how)
    else:
        # any element of one side that equals any of the other: pairs, each counted once
        rows = df.withColumn("__row", F.monotonically_increasing_id())
        rows = settle(rows)
        keys = rows.select("__row", (F.explode(_elements(local)) if own_many else own.col).alias("__own"))
        pairs = keys.join(numbered, on).select("__row", "__i", "__doc").dropDuplicates(["__row", "__i"])
        joined = rows.join(pairs.groupBy("__row").agg(listed.alias("__docs")), "__row", how)
    docs = F.coalesce("__docs", F.array().cast(T.ArrayType(item)))
    helpers = tuple(c for c in joined.columns if c in ("__own", "__far", "__docs", "__row"))
    return Frame(_set(joined, as_, Val(docs, T.ArrayType(item)), helpers), frame.order)


def _lookup_pipeline(spec: dict, frame: Frame, context: Context, both: bool) -> Frame:
    """A correlated pipeline runs once over the pairs of outer and foreign rows, whose owners its stages keep apart; equalities between both
    sides in its first filter become keys of the join. An uncorrelated one runs once, and its one row of results is joined to all rows.

    Variables of enclosing lookups go along in columns of their own, named by depth, if the pipeline names them."""
    let = spec.get("let", {})
    if not isinstance(let, dict) or not isinstance(spec["pipeline"], list):
        raise InvalidStage("$lookup takes let and a pipeline")
    pipeline = spec["pipeline"]
    foreign = _foreign(spec["from"], context) if "from" in spec else None
    carried = [c for c in frame.df.columns if c.startswith(LET)]
    if not let and not both and not (carried and _names(pipeline, set(context.variables))):
        inner = run_pipeline(pipeline, foreign, context.inside("$lookup"))
        rows = visible(inner.df)
        kind = T.ArrayType(T.StructType(list(rows.schema)))
        listed = inner.numbered().agg(_in_order(rows).alias("__docs"))
        joined = frame.df.crossJoin(F.broadcast(listed))  # one row
        return Frame(_set(joined, spec["as"], Val(F.coalesce("__docs", F.array().cast(kind)), kind), ("__docs",)), frame.order)
    rows = settle(frame.df.withColumn("__row", F.monotonically_increasing_id()))
    scope = Scope(rows.schema, context.variables)
    owner = F.col("__row").alias(OWNER)
    outer: dict[str, Val] = {}
    sent = [owner, *carried]
    for i, (name, e) in enumerate(let.items(), len(carried)):
        v = bound(compile_expression(e, scope))
        kind = v.type if not v.null else T.StringType()
        sent.append(v.col.cast(kind).alias(f"{LET}{i}") if v.null else v.col.alias(f"{LET}{i}"))
        outer[variable_name(name)] = Val(F.col(f"{LET}{i}"), kind)
    if foreign is None:  # literal rows come first: they join all owners
        foreign, pipeline = run_pipeline(pipeline[:1], None, context.inside("$lookup")), pipeline[1:]
    far = visible(foreign.df)
    condition = []
    if both:
        local, other = scope.field(spec["localField"]), Scope(far.schema, {}).field(spec["foreignField"])
        if local.null:
            local = Val(F.lit(None).cast(other.type if not other.null else T.StringType()), other.type if not other.null else T.StringType())
        if other.missing:
            other = Val(F.lit(None).cast(local.type), local.type)
        own = f"{LET}_own{len(carried)}"
        sent.append(local.col.alias(own))
        condition.append(_any_equal(Val(F.col(own), local.type), other))
    condition += _equalities(pipeline, {**context.variables, **outer}, Scope(far.schema, {}))
    pairs = rows.select(*sent).join(far, reduce(lambda a, b: a & b, condition) if condition else F.lit(True))
    inner = run_pipeline(pipeline, Frame(pairs, foreign.order), context.inside("$lookup", outer))
    if OWNER not in inner.df.columns:
        raise UnsupportedStage("a stage of this correlated pipeline does not keep owners apart")
    found = visible(inner.df)
    kind = T.ArrayType(T.StructType(list(found.schema)))
    numbered = inner.numbered()
    listed = numbered.groupBy(F.col(OWNER).alias("__row")).agg(_in_order(found).alias("__docs"))
    joined = rows.join(listed, "__row", "left")
    made = _set(joined, spec["as"], Val(F.coalesce("__docs", F.array().cast(kind)), kind), ("__docs", "__row"))
    return Frame(_counted(made, pipeline, spec["as"], kind), frame.order)


def _names(part: Any, variables: set[str]) -> bool:
    """Whether a part of a pipeline names one of the variables."""
    if isinstance(part, str):
        return part.startswith("$$") and part[2:].split(".")[0] in variables
    if isinstance(part, dict):
        return any(_names(v, variables) for v in part.values())
    return isinstance(part, list | tuple) and any(_names(v, variables) for v in part)


def _counted(df: DataFrame, pipeline: list, as_: str, kind: T.ArrayType) -> DataFrame:
    """A pipeline that ends in $count gives a row with 0 where nothing came."""
    if not pipeline or "$count" not in pipeline[-1]:
        return df
    zero = F.array(F.struct(F.lit(0).cast("long").alias(pipeline[-1]["$count"])))
    v = Scope(df.schema, {}).field(as_)
    return _set(df, as_, Val(F.when(F.size(v.col) == 0, zero).otherwise(v.col), kind))


def _equalities(pipeline: list, outer: dict[str, Val], far: Scope) -> list[Column]:
    """What the first filter asks for between a field and a variable: the filter stays, the join only needs not try all pairs."""
    if not pipeline or not isinstance(pipeline[0], dict) or "$match" not in pipeline[0] or not isinstance(pipeline[0]["$match"], dict):
        return []
    e = pipeline[0]["$match"].get("$expr")
    parts = e["$and"] if isinstance(e, dict) and isinstance(e.get("$and"), list) else [e]
    out = []
    for p in parts:
        if not (isinstance(p, dict) and isinstance(p.get("$eq"), list) and len(p["$eq"]) == 2):
            continue
        a, b = p["$eq"]
        for x, y in ((a, b), (b, a)):
            if isinstance(x, str) and isinstance(y, str) and y.startswith("$$") and y[2:] in outer and x.startswith("$") and not x.startswith("$$"):
                own = far.field(x[1:])
                pair = None if own.missing or own.dynamic else _aligned(outer[y[2:]], own)
                if pair is not None:
                    out.append(pair[0].eqNullSafe(pair[1]))
    return out


def _in_order(rows: DataFrame) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(ROW_ID).alias("i"), whole(rows).alias("v")))), lambda x: x["v"])


def _any_equal(a: Val, b: Val) -> Column:
    """Whether an element or value of one side equals one of the other; null equals null."""
    (own, own_many), (far, far_many) = _keys(a), _keys(b)
    try:
        kind = common([own.type, far.type])
    except InvalidArgument:
        return F.lit(False)
    if not own_many and not far_many:
        pair = _aligned(a, b)
        return F.lit(False) if pair is None else pair[0].eqNullSafe(pair[1])
    one, other = (_elements(v).cast(T.ArrayType(kind)) if many else F.array(v.col.cast(kind)) for v, many in ((a, own_many), (b, far_many)))
    return F.exists(one, lambda x: F.exists(other, lambda y: x.eqNullSafe(y)))


@stage("$unionWith")
def union_with(spec: Any, frame: Frame, context: Context) -> Frame:
    options = {"coll": spec} if isinstance(spec, str) else spec
    if not isinstance(options, dict) or not set(options) <= {"coll", "pipeline"} or not options:
        raise InvalidStage("$unionWith takes coll and pipeline")
    pipeline = options.get("pipeline", [])
    if "coll" not in options and not (pipeline and "$documents" in pipeline[0]):
        raise InvalidStage("$unionWith without coll needs a pipeline that begins with $documents")
    source = _foreign(options["coll"], context) if "coll" in options else None
    other = run_pipeline(pipeline, source, context.inside("$unionWith")) if pipeline or source is None else source
    return Frame(_union(visible(frame.ordered()), visible(other.ordered())))


def _union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; fields that one lacks are missing there, numbers widen."""
    names = list(dict.fromkeys([*a.columns, *b.columns]))
    kinds = {n: common([d.schema[n].dataType for d in (a, b) if n in d.columns]) for n in names}
    fit = lambda d: d.select(*[(cast(Val(quoted(n), d.schema[n].dataType), kinds[n]) if n in d.columns else F.lit(None).cast(kinds[n])).alias(n) for n in names])
    return fit(a).unionAll(fit(b))


@stage("$graphLookup")
def graph_lookup(spec: Any, frame: Frame, context: Context) -> Frame:
    """Breadth first from all rows at once: one join of the frontier per depth, less what a row has visited. Lineage is cut at each depth."""
    needed = {"from", "startWith", "connectFromField", "connectToField", "as"}
    if not isinstance(spec, dict) or not needed <= set(spec) <= needed | {"maxDepth", "depthField", "restrictSearchWithMatch"}:
        raise InvalidStage("$graphLookup takes from, startWith, connectFromField, connectToField, as, maxDepth, depthField and restrictSearchWithMatch")
    most = spec.get("maxDepth")
    if most is not None and (isinstance(most, bool) or not isinstance(most, int) or most < 0):
        raise InvalidStage("$graphLookup: maxDepth is a length")
    foreign = visible(_foreign(spec["from"], context).df)
    item = T.StructType(list(foreign.schema))
    restrict = spec.get("restrictSearchWithMatch")
    carried = [c for c in frame.df.columns if c.startswith(LET)]
    by_row = bool(carried) and restrict is not None and _names(restrict, set(context.variables))
    if restrict is not None and not by_row:
        foreign = foreign.where(compile_filter(restrict, Scope(foreign.schema, context.variables)))
    scope = Scope(foreign.schema, {})
    to, back = scope.field(spec["connectToField"]), scope.field(spec["connectFromField"])
    rows = settle(frame.numbered().withColumnRenamed(ROW_ID, "__row"))
    first = compile_expression(spec["startWith"], Scope(rows.schema, context.variables))
    kinds = [_keys(v)[0].type for v in (first, back, to) if not v.null]
    kind = common(kinds) if kinds else T.StringType()

    def values(v: Val, nulls: bool) -> Column:
        """The values of a field in order, nulls among them only if asked for."""
        if v.null:
            return F.array(F.lit(None).cast(kind)) if nulls else F.array().cast(T.ArrayType(kind))
        own = F.coalesce(v.col, F.array(F.lit(None).cast(v.type.elementType))) if v.array else F.array(v.col)
        own = own.cast(T.ArrayType(kind))
        return own if nulls else F.filter(own, lambda x: x.isNotNull())

    # a document is known by its content and stands where it comes first; null meets null and missing
    seen = foreign.select(whole(foreign).alias("doc"), F.array_distinct(values(to, True)).alias("keys"), values(back, False).alias("back"), F.monotonically_increasing_id().alias("seq"))
    seen = settle(seen.withColumn("node", F.sha2(F.to_json(F.struct("doc"), {"ignoreNullFields": "false"}), 256)))
    nodes = settle(seen.select("doc", "node", "back", "seq", F.explode("keys").alias("to")))
    kept = rows.select(F.col("__row").alias("let_row"), *carried)
    frontier = rows.select(F.col("__row").alias("row"), F.posexplode(values(first, True)).alias("nth", "at")).withColumn("path", F.array(F.col("nth").cast("long"))).drop("nth")
    visited: DataFrame | None = None
    depth = 0
    while True:
        # path: places in the queue that led here, so that a depth comes in the order of its parents, then in that of the collection
        found = frontier.join(nodes, frontier["at"].eqNullSafe(nodes["to"])).withColumn("path", F.concat("path", F.array("seq")))
        if by_row:
            found = found.join(kept, found["row"] == kept["let_row"]).where(compile_filter(restrict, Scope(foreign.schema, context.variables, None, Val(F.col("doc"), item))))
        found = found.groupBy("row", "node").agg(F.min_by(F.struct("doc", "back"), "path").alias("own"), F.min("path").alias("path")).select("row", "node", "own.doc", "own.back", "path")
        if visited is not None:
            found = found.join(visited.select("row", "node"), ["row", "node"], "left_anti")
        found = settle(found.withColumn("depth", F.lit(depth).cast("long")))
        visited = found if visited is None else visited.unionByName(found)
        if most is not None and depth >= most or not found.limit(1).count():
            break
        frontier = found.select("row", "path", F.posexplode("back").alias("nth", "at")).withColumn("path", F.concat("path", F.array(F.col("nth").cast("long")))).drop("nth")
        depth += 1
    name = spec.get("depthField")
    if name is not None:
        fields = [*[F.col("doc").getField(n).alias(n) for n in item.names if n != name], F.col("depth").alias(name)]
        out, item = F.struct(*fields), T.StructType([*[f for f in item if f.name != name], T.StructField(name, T.LongType())])
    else:
        out = F.col("doc")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("depth", "path", out.alias("v")))), lambda x: x["v"])
    joined = rows.join(visited.groupBy(F.col("row").alias("__row")).agg(listed.alias("__docs")), "__row", "left")
    docs = F.coalesce("__docs", F.array().cast(T.ArrayType(item)))
    return Frame(_set(joined, spec["as"], Val(docs, T.ArrayType(item)), ("__docs", "__row")), frame.order)


