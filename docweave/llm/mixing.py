"""Mixing sources to target weights by the cube method.

A document's expected copies are its source's target over its source's size; the whole part is certain, the rest an inclusion
probability. The flight phase moves the probabilities of three documents at a time along the direction that keeps both the
words and the documents of their block, until one of them is 0 or 1. Blocks of a bounded number of rows run in parallel;
each leaves two undecided rows at most, which meet again in fewer blocks, until a source has one block. Landing settles its last rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import settle, small, spare

#: Words are separated by blanks and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one flight takes; the number of blocks grows with the table instead.
BLOCK = 4096
#: Times that landing turns over two settled rows at most.
TURNS = 8
FIELDS = "row {}, block_of long, source string, size long, whole int, part double, copies int"


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """sizes (source, source_size) with their targets in words.

    Sources weigh as the weights repeat over them by code point, null last, and share the given part of all sizes. A target stops at
    `most` times its source's size; what exceeds goes to the others by weight until none is above. A share beyond that leaves all at their stop.
    One row per source, so this is a small table that no partition needs to split; the levels at which sources stop come from one sorted pass.
    """
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int")))
    # a source stops once the words per unit of weight reach most * size / weight: sources in that order stop first
    named = named.withColumn("level", F.col("source_size") * most / F.col("weight"))
    ordered = Window.partitionBy(F.lit(1)).orderBy("level", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    # words left for the sources from this one on when all before it have stopped
    left = F.lit(share) * total - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))
    named = named.withColumn("per_weight", left / F.sum("weight").over(onward))
    # the first source that does not stop fixes the level of all after it
    free = F.min(F.when(F.col("per_weight") <= F.col("level"), F.struct("level", "per_weight"))).over(Window.partitionBy(F.lit(1)))
    return named.select("source", "source_size", F.least(F.col("source_size") * most, F.coalesce(F.greatest(free["per_weight"], F.lit(0.0)), F.col("level")) * F.col("weight")).alias("target"))


def flight(size: np.ndarray, part: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """part with all but two entries moved to 0 or 1, keeping sum(part * size) and sum(part); with land, the last two are settled too."""
    part = np.where(part < 1e-9, 0.0, np.where(part > 1 - 1e-9, 1.0, part)).tolist()
    size = size.astype(float).tolist()
    held: list[int] = []
    draws = iter(rng.random(len(part) + 8).tolist())
    for k in range(len(part)):
        if not 0.0 < part[k] < 1.0:
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        way = (size[b] - size[c], size[c] - size[a], size[a] - size[b])  # sums to 0, and so do its products with the sizes
        if way == (0.0, 0.0, 0.0):
            way = (1.0, -1.0, 0.0)
        up = min((1 - part[i]) / w if w > 0 else -part[i] / w for i, w in zip(held, way, strict=True) if w)
        down = min(part[i] / w if w > 0 else (part[i] - 1) / w for i, w in zip(held, way, strict=True) if w)
        step = up if next(draws) * (up + down) < down else -down
        for i, w in zip(held, way, strict=True):
            x = part[i] + step * w
            part[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        held = [i for i in held if 0.0 < part[i] < 1.0]
    if land:
        _land(size, part, held)
    return np.array(part)


def _land(size: list[float], part: list[float], held: list[int]) -> None:
    """Settle the held rows, two at most, then turn over settled rows, two at a time, while that brings the words still nearer to what was meant."""
    picks = [[float(pick >> k & 1) for k in range(len(held))] for pick in range(1 << len(held))]
    off_by = [sum((g - part[i]) * size[i] for g, i in zip(got, held, strict=True)) for got in picks]
    best = min(range(len(picks)), key=lambda k: (abs(off_by[k]), abs(sum(picks[k]))))
    for g, i in zip(picks[best], held, strict=True):
        part[i] = g
    off = off_by[best]
    for _ in range(TURNS):
        # a turn adds or takes the row's words; entry 0 stands for no turn
        turns = np.array([0.0] + [-s if p else s for s, p in zip(size, part, strict=True)])
        order = np.argsort(turns, kind="stable")
        ranked = turns[order]
        near = np.searchsorted(ranked, -off - turns)
        found = (abs(off), 0, 0)
        for shift in (-1, 0):
            other = order[np.clip(near + shift, 0, len(order) - 1)]
            left = np.where((other == np.arange(len(turns))) & (other > 0), np.inf, np.abs(off + turns + turns[other]))
            k = int(left.argmin())
            found = min(found, (float(left[k]), k, int(other[k])))
        if not any(found[1:]):
            break
        for k in found[1:]:
            if k:
                part[k - 1] = 1.0 - part[k - 1]
                off += turns[k]


def _fly(land: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("row", "size", "part")])  # row: an id of any type that has an order, or a hash
        size, part = rows["size"].to_numpy(), rows["part"].to_numpy()
        seed = int(rows["block_of"][0].as_py()) & (2**63 - 1)
        part = flight(size, part, np.random.default_rng([seed, len(size), int(size.sum())]), land)
        settled = (part == 0.0) | (part == 1.0)
        copies = pa.array(np.where(settled, rows["whole"].to_numpy() + part, 0).astype(np.int32), mask=~settled)
        return rows.set_column(rows.schema.names.index("part"), "part", pa.array(part)).set_column(rows.schema.names.index("copies"), "copies", copies)

    return run


def plan(units: DataFrame) -> DataFrame:
    """units (row, source, size long, ratio double) with copies int, decided; every row counts, repeated ones too.

    row only orders and seeds, so that reruns agree. Rows without words have expected copies like any other.
    """
    rows = units.select("row", F.lit(0).cast("long").alias("block_of"), "source", "size", F.floor("ratio").cast("int").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("part"), F.lit(None).cast("int").alias("copies"))
    fields = FIELDS.format(units.schema["row"].dataType.simpleString())
    settled, left = [], rows
    while True:
        counts = settle(left.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n")))
        most = counts.agg(F.max("n")).first()[0]
        if most is None and settled:
            break
        land = (most or 0) <= BLOCK
        blocks = small(counts.select("of", (F.lit(1) if land else F.ceil(F.col("n") / (BLOCK // 2))).cast("long").alias("blocks")))
        dealt = left.join(blocks, F.col("source").eqNullSafe(F.col("of"))).select(left["*"], F.pmod(F.xxhash64("row", "size"), F.col("blocks")).alias("deal"))
        dealt = dealt.withColumn("block_of", F.xxhash64("source", "deal", F.lit(len(settled)))).drop("deal")
        done = settle(dealt.groupBy("block_of").applyInArrow(_fly(land), fields))
        settled.append(done.where("copies is not null"))
        if land:
            break
        left = done.where("copies is null")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("row", "source", "size", "copies")


def _sized(docs: DataFrame, size: Column, weights, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    narrow = settle(docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "source", size.alias("size")))
    goals = settle(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    return narrow, goals


def _with_goals(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = small(goals.withColumnRenamed("source", "goal_of"))
    return narrow.join(goals, narrow["source"].eqNullSafe(goals["goal_of"]), "left").withColumn("ratio", ratio).drop("goal_of")


def taken(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per document: doc_id, size (words), source, source_size, target, copies, and taken = copies * size. Texts do not travel.

    Null text: size 0. Null source: a source of its own, last. Null or repeated doc_id: rows are decided one by one. Ids are of any simple type.
    """
    narrow, goals = _sized(docs, words(F.col("text")), weights, share, most)
    units = _with_goals(narrow, goals)
    planned = plan(units.select(F.col("doc_id").alias("row"), "source", "size", "ratio"))  # the id rides through the plan in place of the hash
    out = _with_goals(planned, goals)
    return out.select(F.col("row").alias("doc_id"), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """docs with every row as often as the mix takes it, zero to `most` times; columns as they were.

    Rows equal in doc_id and text are alike to the plan: their copies are dealt evenly among them.
    """
    key, copies, times, turn = spare(docs, "mix_row", "mix_copies", "mix_times", "mix_turn")
    narrow, goals = _sized(docs, words(F.col("text")), weights, share, most)
    planned = plan(_with_goals(narrow, goals).select("row", "source", "size", "ratio"))
    decided = settle(planned.groupBy("row", "source").agg(F.sum("copies").alias(copies), F.count("*").alias(times)).withColumnRenamed("row", key).withColumnRenamed("source", turn))
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    out = rows.join(decided, (rows[key] == decided[key]) & rows["source"].eqNullSafe(decided[turn])).drop(decided[key]).drop(turn)
    if decided.where(F.col(times) > 1).limit(1).count():
        out = out.withColumn(turn, F.row_number().over(Window.partitionBy(key, "source").orderBy(F.lit(1))))
        out = out.withColumn(copies, F.floor(F.col(copies) / F.col(times)) + (F.col(turn) <= F.pmod(F.col(copies), F.col(times))).cast("long"))
    out = out.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return out.select(*docs.columns)


__all__ = ["flight", "mix", "plan", "taken", "targets", "words"]
