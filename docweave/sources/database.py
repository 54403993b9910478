"""Databases of collections, with the commands on them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docweave.errors import InvalidArgument, InvalidStage
from docweave.functions.base import Scope
from docweave.operators import run_pipeline
from docweave.operators.rows import direction
from docweave.plans.filter import compile_filter
from docweave.plans.frame import Context, Frame, settle, shared_folder, sort_columns, visible
from docweave.plans.projection import columns, project
from docweave.plans.update import Update, described, updated, upsert_row
from docweave.sources.changes import ChangeLog
from docweave.sources.store import Store
from docweave.values import Val, cast, common, quoted

#: Keys of an insert that are broadcast; more are shuffled.
BROADCAST_KEYS = 100_000


class DuplicateKey(InvalidArgument):
    """Two documents with the same unique key."""

    code = 11000


class FailPointEnabled(InvalidArgument):
    """A command that a fail point was set for."""

    code = 8

    def __init__(self, command: str, code: int | None, labels: list[str]):
        super().__init__(f"a fail point is set for {command}")
        self.code, self.labels = code if code is not None else self.code, labels


class Database:
    """Collections by name: DataFrames that were registered, and collections stored under a folder, which can be written."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, folder: str | None = None, name: str = "test", siblings: dict[str, Database] | None = None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.name = spark, name
        self.tables = dict(tables or {})
        self._folder = folder
        self.siblings = siblings if siblings is not None else {}
        self.siblings[name] = self
        self.indexes: dict[str, dict[str, dict]] = {}
        self._store: Store | None = None
        self._fail: dict | None = None

    def __getitem__(self, name: str) -> Collection:
        return Collection(self, name)

    collection = __getitem__

    def sibling(self, name: str) -> Database:
        if name not in self.siblings:
            raise InvalidArgument(f"no database {name}")
        return self.siblings[name]

    @property
    def store(self) -> Store:
        if self._store is None:
            self._store = Store(self.spark, f"{self._folder or shared_folder(self.spark) + '/db-' + uuid.uuid4().hex}/{self.name}")
        return self._store

    @property
    def changes(self) -> ChangeLog:
        return ChangeLog(self)

    def frame(self, name: str) -> DataFrame:
        if not isinstance(name, str) or not name:
            raise InvalidStage("a collection has a name")
        if name in self.tables:
            return self.tables[name]
        found = self.store.read(name)
        # a collection that is not there is empty
        return found if found is not None else self.spark.range(0).select(F.lit(None).cast("string").alias("_id"))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        made = self.store.write(name, visible(df))
        self.tables.pop(name, None)
        return made

    # commands on the database

    def configure_fail_point(self, point: str, mode: str | dict, data: dict | None = None) -> dict:
        """Make named commands fail: always, a number of times, or no longer. For tests of what calls them."""
        if point != "failCommand":
            raise InvalidArgument(f"no fail point {point}")
        times = mode.get("times") if isinstance(mode, dict) and set(mode) == {"times"} else {"off": 0, "alwaysOn": -1}.get(mode) if isinstance(mode, str) else None
        if not isinstance(times, int) or isinstance(times, bool):
            raise InvalidArgument("a fail point's mode is off, alwaysOn or a number of times")
        if times <= 0 and mode != "alwaysOn":
            self._fail = None
            return {"ok": 1.0}
        commands, code, labels = (data or {}).get("failCommands"), (data or {}).get("errorCode"), (data or {}).get("errorLabels", [])
        if any(not isinstance(names, list) or not all(isinstance(n, str) for n in names) for names in (commands, labels)):
            raise InvalidArgument("failCommands and errorLabels are lists of names")
        if code is not None and (isinstance(code, bool) or not isinstance(code, int) or not -(1 << 31) <= code < 1 << 31):
            raise InvalidArgument("errorCode is an integer of 32 bits")
        self._fail = {"left": times, "commands": {c.lower() for c in commands}, "code": code, "labels": labels}
        return {"ok": 1.0}

    def entered(self, command: str) -> None:
        """A command begins: it fails where a fail point with an error is set for it."""
        fail = self._fail
        if fail is None or command.lower() not in fail["commands"]:
            return
        if fail["left"] > 0:
            fail["left"] -= 1
            if not fail["left"]:
                self._fail = None
        if fail["code"] is not None or fail["labels"]:
            raise FailPointEnabled(command, fail["code"], fail["labels"])

    def aggregate(self, pipeline: list) -> DataFrame:
        """A pipeline without a collection: its first stage makes the rows."""
        return visible(run_pipeline(pipeline, None, Context(self)).df)

    def create(self, name: str) -> None:
        if name in self.list_collections():
            raise InvalidArgument(f"collection {name} exists")
        self.write(name, self.spark.range(0).select(F.lit(None).cast("string").alias("_id")))

    def drop(self, name: str) -> bool:
        there = name in self.list_collections()
        self.tables.pop(name, None)
        self.indexes.pop(name, None)
        self.store.remove(name)
        if there:
            self.changes.note(name, "drop")
        return there

    def drop_database(self) -> None:
        for name in self.list_collections():
            self.drop(name)
        self.changes.note(None, "dropDatabase")

    def rename(self, name: str, to: str, drop_target: bool = False) -> None:
        if name not in self.list_collections():
            raise InvalidArgument(f"no collection {name}")
        if to in self.list_collections():
            if not drop_target:
                raise InvalidArgument(f"collection {to} exists")
            self.drop(to)
        if name in self.tables:
            self.tables[to] = self.tables.pop(name)
        else:
            self.store.rename(name, to)
        if name in self.indexes:
            self.indexes[to] = self.indexes.pop(name)
        self.changes.note(name, "rename", expanded=False, extra={"to": {"db": self.name, "coll": to}})

    def list_collections(self) -> list[str]:
        return sorted({*self.tables, *self.store.collections()})

    def list_databases(self) -> list[str]:
        return sorted(self.siblings)

    @staticmethod
    def ping() -> dict:
        return {"ok": 1.0}

    @staticmethod
    def hello() -> dict:
        """What a client asks first."""
        return {"isWritablePrimary": True, "maxBsonObjectSize": 16 << 20, "maxMessageSizeBytes": 48_000_000, "maxWriteBatchSize": 100_000, "ok": 1.0}

    @staticmethod
    def kill_all_sessions(users: list | None = None) -> dict:
        """There are no sessions to end."""
        return {"ok": 1.0}

    @staticmethod
    def get_parameter(asked: str | int = "*", **names: Any) -> dict:
        """All parameters for "*"; for 1 those that are named with a value that is true."""
        held = {"authenticationMechanisms": [], "requireApiVersion": False}
        if asked == "*":
            return {**held, "ok": 1.0}
        return {**{k: v for k, v in held.items() if asked == 1 and names.get(k)}, "ok": 1.0}

    def build_info(self) -> dict:
        return {"engine": "spark", "version": self.spark.version, "ok": 1.0}


class Cursor:
    """Batches of a lazy result, fetched partition by partition."""

    def __init__(self, df: DataFrame, batch: int = 101):
        self._rows: Iterator[Row] = df.toLocalIterator(prefetchPartitions=True)
        self.batch, self.open = batch, True

    def get_more(self, n: int | None = None) -> list[dict]:
        out = []
        for _ in range(n or self.batch):
            row = next(self._rows, None) if self.open else None
            if row is None:
                self.open = False
                break
            out.append(row.asDict(True))
        return out

    def kill(self) -> None:
        self.open, self._rows = False, iter(())


class Collection:
    def __init__(self, database: Database, name: str):
        self.database, self.name = database, name

    @property
    def df(self) -> DataFrame:
        return self.database.frame(self.name)

    def _where(self, spec: dict | None) -> DataFrame:
        df = self.df
        return df if not spec else df.where(compile_filter(spec, Scope(df.schema)))

    # reads

    def find(self, filter: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        self.database.entered("find")
        df = self._where(filter)
        if sort:
            keys = sort_columns({k: direction(w) for k, w in sort.items()}, Scope(df.schema))
            df = df.orderBy(*keys) if keys else df
        if skip:
            df = df.offset(skip)
        if limit:
            df = df.limit(abs(limit))
        if projection:
            df = df.select(*columns(project(projection, Scope(df.schema))))
        return visible(df)

    def aggregate(self, pipeline: list, variables: dict[str, Any] | None = None) -> DataFrame:
        self.database.entered("aggregate")
        from docweave.values import literal

        let = {k: literal(v) for k, v in (variables or {}).items()}
        return visible(run_pipeline(pipeline, Frame(self.df), Context(self.database, self.name, let)).ordered())

    def cursor(self, pipeline: list, batch: int = 101) -> Cursor:
        return Cursor(self.aggregate(pipeline), batch)

    def count(self, filter: dict | None = None, skip: int = 0, limit: int = 0) -> int:
        self.database.entered("count")
        df = self._where(filter)
        if skip:
            df = df.offset(skip)
        if limit:
            df = df.limit(limit)
        return df.count()

    def distinct(self, key: str, filter: dict | None = None) -> DataFrame:
        """Distinct values of a path; missing counts as null, arrays stay whole."""
        self.database.entered("distinct")
        df = self._where(filter)
        v = Scope(df.schema).field(key)
        return df.select((v.col if not v.null else F.lit(None).cast("string")).alias("value")).distinct()

    def explain(self, pipeline: list | None = None, filter: dict | None = None) -> str:
        df = self.aggregate(pipeline) if pipeline is not None else self._where(filter)
        return df._jdf.queryExecution().explainString(self.database.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # writes: an insert adds a delta where its rows fit the collection's schema; other writes make the next version from the present one

    def insert(self, documents: list[dict] | DataFrame) -> int:
        self.database.entered("insert")
        from docweave.operators.joins import _union
        from docweave.operators.rows import literal_rows

        new = documents if isinstance(documents, DataFrame) else literal_rows([{k: {"$literal": v} for k, v in d.items()} for d in documents], Context(self.database))
        if "_id" not in new.columns:
            new = new.select(new_id().alias("_id"), "*")
        new = settle(new.withColumn("_id", F.coalesce(F.col("_id"), new_id().cast(new.schema["_id"].dataType))))
        n, fitted = new.count(), self._fitted(new)
        if fitted is not None:
            self._check_added(fitted, n)
            self.database.store.add(self.name, fitted)
        else:
            old = self.df
            merged = new if not old.columns or (old.columns == ["_id"] and not old.limit(1).count()) else _union(old, new)
            self._check_unique(merged)
            self.database.write(self.name, merged)
        self.database.changes.rows(self.name, "insert", new)
        return n

    def _fitted(self, new: DataFrame) -> DataFrame | None:
        """new in the schema of the stored collection; None if it brings fields or wider types, or if nothing is stored."""
        old = None if self.name in self.database.tables else self.database.store.read(self.name)
        if old is None or old.columns == ["_id"] or not set(new.columns) <= set(old.columns):
            return None
        kinds = {f.name: common([f.dataType, *([new.schema[f.name].dataType] if f.name in new.columns else [])]) for f in old.schema}
        if any(kinds[f.name].simpleString() != f.dataType.simpleString() for f in old.schema):
            return None
        return new.select(*[(cast(Val(quoted(n), new.schema[n].dataType), k) if n in new.columns else F.lit(None).cast(k)).alias(n) for n, k in kinds.items()])

    def update(self, filter: dict, change: dict | list, multi: bool = False, upsert: bool = False) -> dict:
        self.database.entered("update")
        spec = Update.parse(change)
        if spec.replacement is not None and multi:
            raise InvalidArgument("a replacement changes one document")
        df = settle(self.df.withColumn("__n", F.monotonically_increasing_id()))
        hit = compile_filter(filter, Scope(df.schema))
        if not multi:
            first = df.where(hit).agg(F.min("__n").alias("n")).first()["n"]
            hit = F.col("__n") == F.lit(first) if first is not None else F.lit(False)
        marked = df.withColumn("__hit", hit)
        matched = marked.where("__hit").count()
        if not matched:
            if not upsert:
                return {"matched": 0, "modified": 0, "upserted": 0}
            row = upsert_row(filter, spec, self.database)
            if "_id" not in row.columns:
                row = row.select(new_id().alias("_id"), "*")
            self.insert(row)
            return {"matched": 0, "modified": 0, "upserted": 1}
        after = updated(marked, spec, self.database)
        before = marked.where("__hit").drop("__hit")
        kept = settle(after)
        changed = described(before, kept.where("__hit").drop("__hit"))
        modified = changed.count()
        new = kept.drop("__hit", "__n")
        self._check_unique(new)
        self.database.write(self.name, new)
        self.database.changes.updates(self.name, changed, "replace" if spec.replacement is not None else "update")
        return {"matched": matched, "modified": modified, "upserted": 0}

    def delete(self, filter: dict, limit: int = 0) -> int:
        self.database.entered("delete")
        df = settle(self.df.withColumn("__n", F.monotonically_increasing_id()))
        hit = compile_filter(filter, Scope(df.schema))
        if limit == 1:
            first = df.where(hit).agg(F.min("__n").alias("n")).first()["n"]
            hit = F.col("__n") == F.lit(first) if first is not None else F.lit(False)
        gone = df.where(hit).drop("__n")
        n = gone.count()
        if n:
            self.database.write(self.name, df.where(~hit).drop("__n"))
            self.database.changes.rows(self.name, "delete", gone)
        return n

    # indexes are descriptions here: scans prune by the statistics of their files

    def create_index(self, keys: dict[str, int], name: str | None = None, unique: bool = False) -> str:
        name = name or "_".join(f"{k}_{w}" for k, w in keys.items())
        held = self.database.indexes.setdefault(self.name, {})
        if name in held and held[name]["key"] != keys:
            raise InvalidArgument(f"index {name} exists with other keys")
        if unique:
            self._check_keys(self.df, list(keys), name)
        held[name] = {"v": 2, "key": dict(keys), "name": name, **({"unique": True} if unique else {})}
        return name

    def drop_index(self, name: str) -> None:
        held = self.database.indexes.get(self.name, {})
        if name == "_id_" or name != "*" and name not in held:
            raise InvalidArgument(f"no index {name} to drop")
        if name == "*":
            held.clear()
        else:
            del held[name]

    def list_indexes(self) -> list[dict]:
        return [{"v": 2, "key": {"_id": 1}, "name": "_id_"}, *self.database.indexes.get(self.name, {}).values()]

    def _unique(self, df: DataFrame) -> list[tuple[str, list[str]]]:
        """Unique indexes, and the paths of their keys."""
        held = self.database.indexes.get(self.name, {}).values()
        return ([("_id_", ["_id"])] if "_id" in df.columns else []) + [(i["name"], list(i["key"])) for i in held if i.get("unique")]

    def _check_unique(self, df: DataFrame) -> None:
        for name, paths in self._unique(df):
            self._check_keys(df, paths, name)

    def _check_added(self, new: DataFrame, n: int) -> None:
        """That n new rows repeat no key of each other or of the collection: a semi join that reads the keys only."""
        for name, paths in self._unique(new):
            self._check_keys(new, paths, name)
            added = self._keyed(new, paths, "n")
            alike = reduce(and_, [F.col(f"k{i}").eqNullSafe(F.col(f"n{i}")) for i in range(len(paths))])
            there = self._keyed(self.df, paths).join(F.broadcast(added) if n <= BROADCAST_KEYS else added, alike, "left_semi")
            if there.limit(1).count():
                raise DuplicateKey(f"duplicate key in index {name}")

    def _keyed(self, df: DataFrame, paths: list[str], prefix: str = "k") -> DataFrame:
        """The keys of an index. Missing counts as null, so two documents without the key are alike."""
        keys = [Scope(df.schema).field(p) for p in paths]
        return df.select(*[(k.col if not k.null else F.lit(None).cast("string")).alias(f"{prefix}{i}") for i, k in enumerate(keys)])

    def _check_keys(self, df: DataFrame, paths: list[str], name: str) -> None:
        keys = self._keyed(df, paths)
        if keys.groupBy(*keys.columns).count().where("count > 1").limit(1).count():
            raise DuplicateKey(f"duplicate key in index {name}")


def new_id():
    """24 hexadecimal digits, random."""
    return F.substring(F.md5(F.uuid()), 1, 24)


