"""Shards by a k-d tree over document metadata. DataFrame functions only.

A node of the tree that stands for several shards is split along the dimension (size, source, language) in which its documents
spread widest, at the weighted median of their bytes (or the fitting quantile where the shards are odd in number). Medians are found by
distributed histograms, each round refining the bin that holds the cut; only their counts reach the driver, for the TOP highest nodes
at most. What lies below is split inside those nodes by running sums, all of them in parallel.
Copies of a text share a shard, unless they alone outweigh one: then they are dealt into pieces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import row_key, settle, small, spare
from docweave.plans.frame import ranked

#: Bytes that a document takes besides its text.
OVERHEAD = 16
BINS = 1024
#: A group of copies that outweighs a shard is dealt into pieces of so small a part of one.
CRUMB = 0.02
#: Nodes of a level whose cuts the driver looks for; deeper levels are finished inside these nodes.
TOP = 1024
#: Rows that share a counter while slots are numbered.
SLOT_ROWS = 2000
#: Units, of some 60 bytes each, that a task of a level takes.
UNITS_PER_TASK = 200_000
#: A place on an axis has this many bits; the lower ones break ties by hash.
PLACE_BITS, TIE_BITS = 40, 22
#: A unit that straddles the median is left to the right, and smaller ones beyond it make up for it, up to so many times,
#: unless a cut beside it is within this part of a shard's bytes.
SKIPS, TOLERANCE = 4, 0.01


@dataclass
class Node:
    """A node that stands for shards low .. high - 1, and its search for a cut along an axis."""

    low: int
    high: int
    axis: int = 0
    cut: int | None = None  # keys up to the cut go left
    skips: list[int] = field(default_factory=list)  # but these
    goal: float = 0.0  # bytes that the left side is to have
    near: float = 0.0  # how far from it is near enough
    top: int = 0  # the highest key
    first: int = 0  # between first and last lies the key at which the bytes so far pass the goal
    last: int = 0
    before: int = 0  # bytes below first
    below: int = 0  # a cut just below first

    @property
    def middle(self) -> int:
        return (self.low + self.high) // 2

    def narrow(self, bins: list) -> None:
        """Go on within the bin that passes the goal; bins: (weight, low, high) in order."""
        if not bins:  # nothing lies beyond what was skipped
            self.cut = self.below
        for weight, low, high in bins:
            if self.before + weight < self.goal and high < self.last:
                self.before += weight
                self.below = high
                continue
            if low == high:  # one unit passes the goal
                short, over = self.goal - self.before, self.before + weight - self.goal
                if min(abs(short), abs(over)) > self.near and len(self.skips) < SKIPS and high < self.top and over >= 0:
                    self.skips.append(high)
                    self.first, self.last, self.below = high + 1, self.top, high
                    return
                self.cut = high if abs(over) < abs(short) else self.below
            self.first, self.last = low, high
            return


def _placed(units: DataFrame, column: str, place: str) -> tuple[DataFrame, int]:
    """units with the place of the column's value among all its distinct values, from 1 (null: 0), and the number of those."""
    values, n = ranked(units.select(F.col(column).alias("value")).where("value is not null").distinct(), [F.col("value")], "nth")
    return units.join(small(values), units[column] == values["value"], "left").withColumn(place, F.coalesce(F.col("nth") + 1, F.lit(0))).drop("value", "nth"), n


def _axes(units: DataFrame) -> DataFrame:
    """units with k0, k1, ...: the place on each axis in the high bits, a hash in the low ones."""
    units, sources = _placed(units, "source", "place1")
    units, langs = _placed(units, "lang", "place2")
    ends = units.agg(F.min("one").alias("low"), F.max("one").alias("high")).first()
    low, width = (0.0, 0.0) if ends["low"] is None else (math.log2(ends["low"]), math.log2(ends["high"]) - math.log2(ends["low"]))
    tie = F.xxhash64(F.lit(5), "text_hash", "piece").bitwiseAND((1 << TIE_BITS) - 1)
    out = []
    for i, (c, width) in enumerate([(F.log2(F.col("one")) - F.lit(low), width), (F.col("place1").cast("double"), sources), (F.col("place2").cast("double"), langs)]):
        part = F.least(F.greatest(c / F.lit(float(width)), F.lit(0.0)), F.lit(1.0)) if width else F.lit(0.0)
        out.append((F.shiftleft(F.floor(part * float((1 << PLACE_BITS) - 1)).cast("long"), TIE_BITS) + tie).alias(f"k{i}"))
    return units.select("text_hash", "piece", "weight", *out)


def _of_node(values: list) -> Column:
    """The value that belongs to a row's node, NULL if it is settled: a constant array, so the code that Spark makes is the same in each round."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("node"))


def grow(units: DataFrame, shards: int) -> DataFrame:
    """units (text_hash, piece, weight, k0, k1, ...) with their shard. A level of the tree takes one pass for the spreads and a few for the cuts.

    The driver goes down while a level has TOP nodes at most, and _finish does the rest. node numbers the open nodes of the level; a shard s that is settled stands there as -s - 1.
    """
    axes = [c for c in units.columns if c.startswith("k")]
    open_ = [Node(0, shards)] if shards > 1 else []
    # narrow rows: few files for each level
    parts = max(units.sparkSession.sparkContext.defaultParallelism, -(-units.count() // UNITS_PER_TASK))
    placed = units.coalesce(parts).withColumn("node", F.lit(0 if open_ else -1))
    while open_ and len(open_) <= TOP:
        active = placed.where("node >= 0")
        spread = active.groupBy("node").agg(F.sum("weight").alias("weight"), *[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]).collect()  # a row per node
        for node in open_:
            node.cut = 0  # stays where no unit came
        for r in spread:
            node = open_[r["node"]]
            node.cut = None
            node.axis = max(range(len(axes)), key=lambda i, r=r: ((r[f"high_{axes[i]}"] >> TIE_BITS) - (r[f"low_{axes[i]}"] >> TIE_BITS), -i))
            node.first, node.last = r[f"low_{axes[node.axis]}"], r[f"high_{axes[node.axis]}"]
            node.top, node.below = node.last, node.first - 1
            node.goal = r["weight"] * (node.middle - node.low) / (node.high - node.low)
            node.near = TOLERANCE * r["weight"] / (node.high - node.low)
        keyed = active.select("node", "weight", F.element_at(F.array(*axes), _of_node([n.axis + 1 for n in open_])).alias("key"))
        while any(n.cut is None for n in open_):
            first, last = _of_node([n.first if n.cut is None else 1 for n in open_]), _of_node([n.last if n.cut is None else 0 for n in open_])
            step = _of_node([max(1, -(-(n.last - n.first + 1) // BINS)) for n in open_])
            binned = keyed.select("node", "weight", "key", first.alias("first"), last.alias("last"), step.alias("step")).where("key between first and last")
            counted = binned.withColumn("bin", F.expr("(key - first) div step")).groupBy("node", "bin").agg(F.sum("weight").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high")).collect()  # BINS rows per node at most
            found: dict[int, list] = {}
            for r in sorted(counted, key=lambda r: r["bin"]):
                found.setdefault(r["node"], []).append((r["weight"], r["low"], r["high"]))
            for i, node in enumerate(open_):
                if node.cut is None:
                    node.narrow(found.get(i, []))
        sides, following = [], []
        for low, high in [part for n in open_ for part in ((n.low, n.middle), (n.middle, n.high))]:
            sides.append(-low - 1 if high - low == 1 else len(following))
            if high - low > 1:
                following.append(Node(low, high))
        key = F.get(F.array(*axes), _of_node([n.axis for n in open_]))
        skipped = F.array_contains(F.get(F.array(*[F.array(*[F.lit(k) for k in [*n.skips, -1]]) for n in open_]), F.col("node")), key)
        left = (key <= _of_node([n.cut for n in open_])) & ~skipped
        moved = F.when(F.col("node") < 0, F.col("node")).when(left, _of_node(sides[::2])).otherwise(_of_node(sides[1::2]))
        placed = settle(placed.withColumn("node", moved))
        open_ = following
    done = placed.where("node < 0").select("text_hash", "piece", (-F.col("node") - 1).cast("int").alias("shard"))
    return done.unionByName(_finish(placed.where("node >= 0"), axes, open_)) if open_ else done


def _finish(placed: DataFrame, axes: list[str], open_: list[Node]) -> DataFrame:
    """The shards of units in open nodes. Each node is one group, dealt once, that splits level by level at the median of its running weights."""
    nodes = placed.sparkSession.createDataFrame([(i, n.low, n.high) for i, n in enumerate(open_)], "node int, low int, high int")  # 2 * TOP rows at most
    units = placed.join(F.broadcast(nodes), "node")
    for _ in range(max((n.high - n.low - 1).bit_length() for n in open_)):
        own = Window.partitionBy("node", "low")
        spreads = [F.struct((F.shiftright(F.max(a).over(own), TIE_BITS) - F.shiftright(F.min(a).over(own), TIE_BITS)).alias("spread"), F.lit(-i).alias("nth"), F.col(a).alias("key")) for i, a in enumerate(axes)]
        keyed = units.withColumn("key", F.greatest(*spreads)["key"])  # along the widest axis; all units of a node agree on it, the first of equals
        so_far = F.sum("weight").over(own.orderBy("key", "text_hash", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        goal = F.sum("weight").over(own) * (middle - F.col("low")) / (F.col("high") - F.col("low"))
        left = keyed.withColumn("middle", middle).withColumn("left", so_far - F.col("weight") / 2 <= goal)
        one = F.col("high") - F.col("low") == 1
        units = left.withColumn("new_low", F.when(one | F.col("left"), F.col("low")).otherwise(F.col("middle"))).withColumn("high", F.when(~one & F.col("left"), F.col("middle")).otherwise(F.col("high")))
        units = units.withColumn("low", F.col("new_low")).drop("new_low", "key", "middle", "left")
    return units.select("text_hash", "piece", F.col("low").cast("int").alias("shard"))


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, row, size, text_crc32, shard, slot) for every row of docs (doc_id, text; source and lang where it has them).

    Shards are near equal in bytes. Their number is given, or the least whose share of all bytes is target_bytes at most. size: UTF-8 bytes
    of the text (null: none) plus 16. slot numbers the rows of a shard from 0 without gaps. Null source or lang: lowest on its axis; row is
    the hash of doc_id and text. Rows equal in all of these are numbered in any order. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    has = {c.lower() for c in docs.columns}
    column = lambda c: (F.col(c) if c in has else F.lit(None)).cast("string").alias(c)
    rows = settle(docs.select("doc_id", row_key().alias("row"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), column("source"), column("lang")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = shards or max(1, -(-total // (target_bytes or 128 << 20)))
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("weight"))
    share = F.col("weight") * shards / max(total, 1)
    heavy = groups.where(share > 1).select("text_hash", F.ceil(share / CRUMB).cast("int").alias("parts"))  # fewer groups than shards
    dealt = rows.join(small(heavy), "text_hash", "left").withColumn("piece", F.pmod(F.xxhash64("doc_id", "row", "source"), F.coalesce("parts", F.lit(1)))).drop("parts")
    units = dealt.groupBy("text_hash", "piece").agg(F.sum("size").alias("weight"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("size").alias("one"))
    keyed = settle(_axes(settle(units)))
    placed = grow(keyed, shards)
    found = settle(dealt.join(placed, ["text_hash", "piece"]).select("doc_id", "row", "size", "text_crc32", "shard"))
    counters = found.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_ROWS).alias("counters"))
    parted = found.join(small(counters), "shard").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id", "row"), F.col("counters"))).drop("counters")
    sizes = parted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    numbered = parted.withColumn("nth", F.row_number().over(own) - 1).join(starts, ["shard", "part"])
    return numbered.select("doc_id", "row", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """docs with their shard, int; a column of that name is replaced. Rows equal in doc_id and text get the least of their shards."""
    row, shard = spare(docs, "shard_row", "shard_found")
    found = assign(docs, shards, target_bytes).groupBy("row").agg(F.min("shard").alias(shard)).withColumnRenamed("row", row)
    kept = [c for c in docs.columns if c != "shard"]
    return docs.withColumn(row, row_key()).join(found, row).select(*kept, F.col(shard).alias("shard"))
