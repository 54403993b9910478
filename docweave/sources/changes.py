"""The change log of a database: an append-only folder of events, documents in it as JSON."""

from __future__ import annotations

import json
import time
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.plans.frame import whole
from docweave.values import quoted

if TYPE_CHECKING:
    from docweave.sources.database import Database

LOG = "_changes"
#: seq orders all events and is their token.
SCHEMA = "seq long, clusterTime struct<time: long, increment: long>, wallTime timestamp, database string, collection string, operationType string, documentKey string, fullDocument string, fullDocumentBeforeChange string, updateDescription string, expanded boolean, extraFields string"


class ChangeLog:
    def __init__(self, database: Database):
        self.database = database

    def read(self) -> DataFrame:
        """All events. A table registered as the log stands in for the stored one."""
        if LOG in self.database.tables:
            return self.database.tables[LOG]
        store = self.database.store
        if not store.exists(f"{store.folder}/{LOG}"):
            return self.database.spark.createDataFrame([], SCHEMA)
        return self.database.spark.read.schema(SCHEMA).parquet(f"{store.folder}/{LOG}")

    def _append(self, events: DataFrame) -> None:
        """events with columns of the schema, without seq and times: numbered on from the last."""
        last = self.read().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        now = int(time.time())
        first = max(last, int(time.time() * 1000) << 20)  # each write gets numbers above all before
        names = [part.strip().split(" ")[0] for part in SCHEMA.replace("struct<time: long, increment: long>", "struct").split(",")]
        numbered = events.withColumn("seq", F.lit(first + 1).cast("long") + F.monotonically_increasing_id())
        stamped = numbered.withColumn("clusterTime", F.struct(F.lit(now).cast("long").alias("time"), F.lit(1).cast("long").alias("increment"))).withColumn("wallTime", F.current_timestamp())
        full = [quoted(n) if n in stamped.columns else F.lit(None).alias(n) for n in names]
        typed = stamped.select(*full)
        spark_types = self.database.spark.createDataFrame([], SCHEMA).schema
        self.database.store.append(LOG, typed.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in spark_types]))

    def _event(self, df: DataFrame, collection: str | None, operation: str, expanded: bool = False) -> DataFrame:
        return df.withColumn("database", F.lit(self.database.name)).withColumn("collection", F.lit(collection)).withColumn("operationType", F.lit(operation)).withColumn("expanded", F.lit(expanded))

    def rows(self, collection: str, operation: str, df: DataFrame) -> None:
        key = F.to_json(F.struct("_id")) if "_id" in df.columns else F.lit(None).cast("string")
        document = F.to_json(whole(df))
        image = "fullDocumentBeforeChange" if operation == "delete" else "fullDocument"
        self._append(self._event(df.select(key.alias("documentKey"), document.alias(image)), collection, operation))

    def updates(self, collection: str, changed: DataFrame, operation: str) -> None:
        """changed: documentKey, fullDocumentBeforeChange, fullDocument, updateDescription."""
        self._append(self._event(changed, collection, operation))

    def note(self, collection: str | None, operation: str, expanded: bool = False, extra: dict | None = None) -> None:
        one = self.database.spark.range(1).select(F.lit(json.dumps(extra) if extra else None).cast("string").alias("extraFields"))
        self._append(self._event(one, collection, operation, expanded))
