"""Shared ground of the operators: tables, lineage cuts, and words of UTF-8 batches in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one numpy pass holds; larger batches are cut between rows, a longer single row passes whole.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; only a master on one machine, as in tests, may leave it unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docweave-checkpoints-"))
    return context.getCheckpointDir()


def settle(df: DataFrame, few: bool = False) -> DataFrame:
    """Write df as a table under the shared folder and go on from there, so that lost executors cost no long recomputation.

    few: rows of a few numbers each, such as edges or labels, are written in four files for each core of the cluster at most.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if few else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete tables that settle wrote and that nothing reads any more."""
    for df in settled:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has so few rows; beyond that the join is left to Spark, which splits skewed keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Keys that are dealt over tasks are those with more than this part of all rows, and with so many rows at least.
HOT_PART, HOT_ROWS = 1000, 2000


def hot(counts: DataFrame, key: str) -> DataFrame:
    """The keys of counts (key, n) that no one task should hold, with the number of their deals: fewer than HOT_PART rows, so it is broadcast."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(HOT_ROWS, total // HOT_PART)
    return F.broadcast(counts.where(F.col("n") > most).select(F.col(key).alias("hot_key"), F.ceil(F.col("n") / most).cast("int").alias("deals")))


def dealt_out(df: DataFrame, key: str, keys: DataFrame, *by: str) -> DataFrame:
    """df with the column deal, by which the rows of a hot key differ."""
    deal = F.pmod(F.xxhash64(*by), F.coalesce("deals", F.lit(1))).cast("int")
    return df.join(keys, df[key] == keys["hot_key"], "left").withColumn("deal", deal).drop("hot_key", "deals")


def copied_out(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df, a row of which goes to every deal of its key."""
    deals = F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))
    return df.join(keys, df[key] == keys["hot_key"], "left").withColumn("deal", deals).drop("hot_key", "deals")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of df's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """64 bits of id and text: rows that share both are the same document everywhere."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def replaced(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch with columns added, or replaced where a name is taken."""
    columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | new
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that none holds much more text than limit."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for every start and length, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes all words of a batch at once: differences of one running polynomial sum, scaled back to position 0.

    A word is a run of ASCII letters or digits and of bytes above 127. fold lower-cases A-Z first.
    With runs=True the runs of other printable ASCII are words too.
    """

    def __init__(self, fold: bool = True, runs: bool = False, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        kind = np.zeros(256, np.uint8)
        kind[0x30:0x3A] = kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0x80:] = 1
        if runs:
            kind[0x21:0x7F] = np.where(kind[0x21:0x7F] == 0, 2, 1)
        self.kind = kind
        if fold:
            self.values[0x41:0x5B] = self.values[0x61:0x7B]
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.powers = self.unpowers = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            for name, base in (("powers", self.base), ("unpowers", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start, end and row of every word, in order."""
        if not len(data):
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, none
        kind = self.kind[data]
        new = np.empty(len(data), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        inner = at[1:-1]
        new[inner[inner < len(data)]] = True
        edges = np.flatnonzero(new)
        ends = np.append(edges[1:], len(data))
        real = kind[edges] > 0
        starts, ends = edges[real], ends[real]
        return self.spans(data, starts, ends), starts, ends, np.searchsorted(at, starts, "right") - 1

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], never 0."""
        self._tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], dtype=np.uint64, out=total[1:])
        return np.maximum(mix64((total[ends] - total[starts]) * self.unpowers[starts]), np.uint64(1))
