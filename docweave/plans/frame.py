"""What stages hand on: rows, and the order they logically stand in."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidArgument
from docweave.functions.base import OWNER, ROW_ID, Scope, hidden, walk
from docweave.values import Val, quoted

if TYPE_CHECKING:
    from docweave.sources.database import Database


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a master on one machine, as in tests, may leave it unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise InvalidArgument("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docweave-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Context:
    """Where a pipeline runs: its collections, the variables of enclosing pipelines, and what its stages may not hold."""

    database: Database
    collection: str | None = None
    variables: dict[str, Val] = field(default_factory=dict)
    nested: str | None = None  # the stage that the pipeline stands in

    def inside(self, stage: str, variables: dict[str, Val] | None = None) -> Context:
        return replace(self, nested=stage, variables={**self.variables, **(variables or {})})


@dataclass(frozen=True)
class Frame:
    """order: columns that the rows stand in order by, if that differs from the order that the plan gives."""

    df: DataFrame
    order: tuple[Column, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def scope(self, context: Context) -> Scope:
        return Scope(self.schema, context.variables)

    def ordered(self) -> DataFrame:
        """Rows in their logical order, for stages that count on it."""
        return self.df.orderBy(*self.order) if self.order else self.df

    def numbered(self) -> DataFrame:
        """Rows with a number that grows along their logical order; made only for stages that need one, since it keeps filters from moving."""
        df = self.ordered()
        return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def document_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not hidden(c)]


def visible(df: DataFrame) -> DataFrame:
    """df without hidden columns."""
    gone = [c for c in df.columns if hidden(c)]
    return df.drop(*gone) if gone else df


def owned(df: DataFrame) -> bool:
    """Whether rows belong to rows of an outer pipeline, apart from each other."""
    return OWNER in df.columns


def apart(df: DataFrame) -> list[str]:
    """The columns that keep the rows of different owners apart, and go on with them."""
    return [c for c in df.columns if c == OWNER or c.startswith("__let")]


def whole(df: DataFrame) -> Column:
    """A row as one struct."""
    return F.struct(*[quoted(c).alias(c) for c in document_columns(df)])


def sort_key(scope: Scope, path: str) -> Val:
    head = path.split(".")[0]
    v = scope.field(path) if head not in scope.variables else walk(scope.variables[head], path.split(".")[1:])
    return v


def sort_columns(spec: dict[str, int], scope: Scope) -> list[Column]:
    """Missing counts as null, the lowest."""
    out = []
    for path, way in spec.items():
        v = sort_key(scope, path)
        if not v.missing:
            out.append(v.col.asc_nulls_first() if way > 0 else v.col.desc_nulls_last())
    return out


def ranked(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """df with the place of each row, from 0, in a total order, and the number of rows. Sorted by ranges, so no task holds all rows.

    The sorted rows are settled first: a second run of the sort could draw other ranges.
    """
    low = (1 << 33) - 1
    sorted_ = settle(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    counts = sorted_.groupBy(F.shiftright(name, 33).alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    starts, total = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        starts[r["part"]] = total
        total += r["n"]
    if not starts:
        return sorted_, 0
    start = F.element_at(F.create_map(*[F.lit(v) for p, s in starts.items() for v in (p, s)]), F.shiftright(name, 33))
    return sorted_.withColumn(name, (start + F.col(name).bitwiseAND(low)).cast("long")), total
