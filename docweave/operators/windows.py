"""$setWindowFields."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidStage, UnsupportedOperator
from docweave.functions.base import OWNER, ROW_ID, Scope, compile_expression, options
from docweave.functions.dates import MICROS, MONTHS
from docweave.operators.base import stage
from docweave.operators.rows import direction
from docweave.plans.frame import Context, Frame, sort_columns
from docweave.plans.projection import columns, fields_of, put
from docweave.values import DOUBLE, LONG, Val, cast, common

WINDOW_FUNCTIONS = ("$sum", "$avg", "$min", "$max", "$first", "$last", "$push", "$addToSet", "$count", "$rank", "$denseRank", "$documentNumber", "$shift", "$locf", "$linearFill")
_FRAMED = ("$sum", "$avg", "$min", "$max", "$first", "$last", "$push", "$addToSet", "$count")


def sort_spec(spec: Any) -> dict[str, int]:
    if not isinstance(spec, dict) or not spec:
        raise InvalidStage("sortBy takes fields and directions")
    return {k: direction(w) for k, w in spec.items()}


def _bound(b: Any, whole: bool) -> Any:
    if b in ("unbounded", "current"):
        return b
    if isinstance(b, bool) or not isinstance(b, int if whole else int | float):
        raise InvalidStage("a window bound is unbounded, current or a number")
    return b


@stage("$setWindowFields")
def set_window_fields(spec: Any, frame: Frame, context: Context) -> Frame:
    """All outputs read the rows as they came. Without partitionBy all rows are one partition, which one task sorts."""
    if not isinstance(spec, dict) or not {"output"} <= set(spec) <= {"partitionBy", "sortBy", "output"} or not isinstance(spec["output"], dict) or not spec["output"]:
        raise InvalidStage("$setWindowFields takes partitionBy, sortBy and output")
    sort = sort_spec(spec["sortBy"]) if "sortBy" in spec else {}
    parsed = {name: _parse(name, o, sort) for name, o in spec["output"].items()}
    df = frame.numbered()
    scope = Scope(df.schema, context.variables)
    by: list[Column] = []
    if spec.get("partitionBy") is not None:
        v = compile_expression(spec["partitionBy"], scope)
        if v.array:
            raise InvalidStage("$setWindowFields: arrays are no partition keys")
        if not v.null:
            by = [v.col]
    by += [F.col(OWNER)] if OWNER in df.columns else []
    keys = sort_columns(sort, scope)
    work = _Windows(df, scope, by, keys, sort)
    made = {name: work.output(*p) for name, p in parsed.items()}
    out = work.df
    fields = {k: v for k, v in fields_of(out.schema).items() if not k.startswith("__w")}
    for name, v in made.items():
        fields = put(fields, name, v)
    return Frame(out.select(*columns(fields)).drop(ROW_ID))


def _parse(name: str, o: Any, sort: dict) -> tuple[str, Any, dict | None]:
    if not isinstance(o, dict) or not 1 <= len(o) <= 2 or (len(o) == 2 and "window" not in o):
        raise InvalidStage(f"'{name}' needs one window function")
    ((op, e),) = ((k, v) for k, v in o.items() if k != "window")
    if op not in WINDOW_FUNCTIONS:
        raise UnsupportedOperator(op)
    window = o.get("window")
    if op not in _FRAMED and window is not None:
        raise InvalidStage(f"{op} takes no window")
    if op in ("$rank", "$denseRank", "$documentNumber", "$count") and e != {}:
        raise InvalidStage(f"{op} takes an empty document")
    if op in ("$rank", "$denseRank", "$documentNumber", "$shift", "$linearFill") and not sort:
        raise InvalidStage(f"{op} needs sortBy")
    if op == "$linearFill" and len(sort) != 1:
        raise InvalidStage("$linearFill needs one sort field")
    if window is not None:
        if not isinstance(window, dict) or len(set(window) & {"documents", "range"}) > 1 or not set(window) <= {"documents", "range", "unit"}:
            raise InvalidStage("a window has documents, or range and unit")
        if not window:
            window = None
    if window is not None:
        kind = "documents" if "documents" in window else "range"
        bounds = window.get(kind)
        if not isinstance(bounds, list) or len(bounds) != 2 or kind == "documents" and "unit" in window:
            raise InvalidStage("a window has two bounds")
        low, high = (_bound(b, kind == "documents") for b in bounds)
        if kind == "documents":
            n = {"unbounded": None, "current": 0}
            a, b = n.get(low, low), n.get(high, high)
            if a is not None and b is not None and a > b:
                raise InvalidStage("a window's lower bound lies above its upper")
            if (low != "unbounded" or high != "unbounded") and not sort:
                raise InvalidStage("a bounded window needs sortBy")
        else:
            if len(sort) != 1:
                raise InvalidStage("a range needs one sort field")
            if "unit" in window and window["unit"] not in (*MICROS, *MONTHS):
                raise InvalidStage("unknown unit")
        window = {"kind": kind, "low": low, "high": high, "unit": window.get("unit")}
    return op, e, window


class _Windows:
    """The rows with helper columns __w0, __w1, ... that window functions read."""

    def __init__(self, df: DataFrame, scope: Scope, by: list[Column], keys: list[Column], sort: dict[str, int]):
        self.df, self.scope, self.sort, self.n = df, scope, sort, 0
        self.by_names = [self.helper(c) for c in by]
        self.by = [F.col(n) for n in self.by_names] or [F.lit(0)]
        self.keys = keys
        self.peers = Window.partitionBy(*self.by).orderBy(*keys) if keys else Window.partitionBy(*self.by)
        self.rows = Window.partitionBy(*self.by).orderBy(*keys, F.col(ROW_ID))

    def helper(self, c: Column) -> str:
        name = f"__w{self.n}"
        self.n += 1
        self.df = self.df.withColumn(name, c)
        return name

    def output(self, op: str, e: Any, window: dict | None) -> Val:
        if op in _FRAMED:
            return self.framed(op, e, window)
        if op == "$documentNumber":
            return Val(F.row_number().over(self.rows).cast("long"), LONG)
        if op in ("$rank", "$denseRank"):
            return Val((F.rank() if op == "$rank" else F.dense_rank()).over(self.peers).cast("long"), LONG)
        if op == "$shift":
            options(op, e, ("output", "by", "default"), ("output", "by"))
            if isinstance(e["by"], bool) or not isinstance(e["by"], int):
                raise InvalidStage("$shift: by is an integer")
            v = compile_expression(e["output"], self.scope)
            moved = F.lead(F.struct(v.col.alias("v")), e["by"]).over(self.rows) if e["by"] >= 0 else F.lag(F.struct(v.col.alias("v")), -e["by"]).over(self.rows)
            other = compile_expression(e.get("default"), self.scope)
            kind = common([v.type, other.type])
            return Val(F.when(moved.isNotNull(), cast(Val(moved["v"], v.type), kind)).otherwise(cast(other, kind)), kind)
        v = compile_expression(e, self.scope)
        past = self.rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if op == "$locf":
            return Val(F.last(v.col, True).over(past), v.type)
        return linear(self, v, next(iter(self.sort)))

    # frames

    def framed(self, op: str, e: Any, window: dict | None) -> Val:
        v = None if op == "$count" else compile_expression(e, self.scope)
        if window and window["kind"] == "range":
            return self.ranged(op, v, window)
        if window:
            n = {"unbounded": (Window.unboundedPreceding, Window.unboundedFollowing), "current": (0, 0)}
            low = n[window["low"]][0] if window["low"] in n else window["low"]
            high = n[window["high"]][1] if window["high"] in n else window["high"]
            over = self.rows.rowsBetween(low, high)
        elif self.sort:
            over = self.rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        else:
            over = self.rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return _aggregate(op, v, lambda c: c.over(over), False)

    def ranged(self, op: str, v: Val | None, window: dict) -> Val:
        """Bounds go by value, whichever way the rows are sorted; in a falling order first and last change places."""
        (path, way), unit = next(iter(self.sort.items())), window["unit"]
        key = self.scope.field(path)
        falling = way < 0
        wrong = F.raise_error(F.lit("a range window needs a number, or with a unit a date, in every row"))
        if unit is None:
            if not key.numeric:
                raise InvalidStage("a range without unit needs numbers")
            k, kind = F.coalesce(key.col.cast("double"), wrong.cast("double")), "double"
        else:
            if not key.date:
                raise InvalidStage("a range with a unit needs dates")
            k = F.coalesce(key.col.cast("timestamp"), wrong.cast("timestamp"))
            kind = "months" if unit in MONTHS else "micros"
            k = F.unix_micros(k) if kind == "micros" else k
        name = self.helper(k)

        def edge(b: Any, lower: bool) -> str:
            if b == "unbounded":
                return "UNBOUNDED PRECEDING" if lower else "UNBOUNDED FOLLOWING"
            if b == "current" or b == 0:
                return "CURRENT ROW"
            if kind == "months":
                if b != int(b):
                    raise InvalidStage("bounds in months are integers")
                size = f"INTERVAL '{abs(int(b)) * MONTHS[unit]}' MONTH"
            elif kind == "micros":
                size = str(abs(int(b * MICROS[unit]))) + "L"
            else:
                size = f"{abs(float(b))!r}D"
            return f"{size} {'PRECEDING' if b < 0 else 'FOLLOWING'}"

        over = f"(PARTITION BY {', '.join(self.by_names) or '0'} ORDER BY {name} RANGE BETWEEN {edge(window['low'], True)} AND {edge(window['high'], False)})"
        if op in ("$first", "$last"):
            op = {"$first": "$last", "$last": "$first"}[op] if falling else op
        held = {}

        def put_over(c: Column) -> Column:
            # the aggregate by its SQL text: bounds in months have no other form
            return F.expr(f"{held['sql']} OVER {over}")

        value = self.helper(v.col) if v is not None else None
        return _aggregate(op, v, put_over, falling, value, held)


def _aggregate(op: str, v: Val | None, over, falling: bool, name: str | None = None, held: dict | None = None) -> Val:
    """An aggregate over a frame: as a Column, or given a column name as SQL text."""
    held = {} if held is None else held

    def made(column: Column, sql: str) -> Column:
        held["sql"] = sql
        return over(column)

    n = name or "x"
    if op == "$count":
        return Val(made(F.count(F.lit(1)), "count(1)").cast("long"), LONG)
    if op in ("$sum", "$avg"):
        if not v.numeric:
            return Val(F.lit(0).cast("long"), LONG) if op == "$sum" else Val(F.lit(None).cast("double"), DOUBLE)
        real = v.col.cast("double")
        if op == "$avg":
            return Val(made(F.avg(real), f"avg(cast({n} AS double))"), DOUBLE)
        total = F.coalesce(made(F.sum(real), f"sum(cast({n} AS double))"), F.lit(0.0))
        return Val(total.cast("long") if v.integral else total, LONG if v.integral else DOUBLE)
    if op in ("$min", "$max"):
        return Val(made((F.min if op == "$min" else F.max)(v.col), f"{op[1:]}({n})"), v.type)
    if op in ("$first", "$last"):
        return Val(made((F.first if op == "$first" else F.last)(v.col), f"{op[1:]}({n})"), v.type)
    listed = made(F.collect_list(v.col), f"collect_list({n})")
    if falling:
        listed = F.reverse(listed)
    return Val(listed if op == "$push" else F.array_distinct(listed), T.ArrayType(v.type))


def linear(work: _Windows, v: Val, path: str) -> Val:
    """Values between two anchors on a line through both; NULL outside."""
    if not v.numeric:
        raise InvalidStage("linear filling needs numbers")
    key = work.scope.field(path)
    if key.date:
        at = F.unix_millis(key.col.cast("timestamp")).cast("double")
    elif key.numeric:
        at = key.col.cast("double")
    else:
        raise InvalidStage("linear filling needs one numeric or date sort field")
    real = v.col.cast("double")
    anchor = F.when(real.isNotNull(), F.struct(at.alias("at"), real.alias("value")))
    before = F.last(anchor, True).over(work.rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(anchor, True).over(work.rows.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    span = after["at"] - before["at"]
    between = before.isNotNull() & after.isNotNull()
    value = before["value"] + (after["value"] - before["value"]) * F.try_divide(at - before["at"], span)
    flat = F.raise_error(F.lit("linear filling between anchors of equal sort values")).cast("double")
    return Val(F.when(real.isNotNull(), real).when(between & (span == 0), flat).when(between, value), DOUBLE)

