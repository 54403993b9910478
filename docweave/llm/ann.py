"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each shard posts its vectors, with the place of the pivot, in the
inverted file of each of those pivots; a query reads the files of its own nearest pivots, ranks the shard's vectors by the footrule
distance of the truncated permutations, and reranks the nearest part of them by exact cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import settle
from docweave.llm.topk import BLOCK, SHARD, _best, dealt, ids_of, matrix, sample, usable

#: Pivots are a bounded sample of the vectors, this many at most; the index holds every vector.
PIVOTS = 256
#: Nearest pivots that a vector is posted under.
POSTED = 128
#: Part of a shard that is reranked for a query, of any size.
RERANK = 0.2


def permutations(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the smaller pivot. Rows and pivots have length 1."""
    return np.argsort(-(x @ pivots.T), 1, kind="stable")[:, :posted]


class InvertedFiles:
    """For each pivot the rows posted under it, and at which place."""

    def __init__(self, order: np.ndarray, pivots: int):
        rows, posted = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.row, self.place = by // posted, by % posted
        self.start = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.rows, self.posted = rows, posted

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance from one permutation to all rows; a pivot that one of both lacks stands at place `posted`."""
        gain = np.zeros(self.rows, np.int64)
        m = self.posted
        for place, pivot in enumerate(order.tolist()):
            own = slice(self.start[pivot], self.start[pivot + 1])
            # against (m - place) for the query's pivot and (m - its place) for the row's, both here
            gain[self.row[own]] += (m - place) + (m - self.place[own]) - np.abs(place - self.place[own])
        return m * (m + 1) - gain


def nearest(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, posted: int = POSTED, rerank: float = RERANK, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score double): the k found vectors of largest cosine, ties to the smaller id.

    vectors, queries: (id, vector). Vectors null, zero or holding null or non-finite components take no part, nor do pairs of different
    dimension; a vector with the query's own id is no candidate. Repeated query ids ask once, with their least vector; repeated
    candidates all count. Per dimension the pivots are those vectors whose hashes are least.
    """
    context = vectors.sparkSession.sparkContext
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))
    held = settle(clean(vectors))
    asked = settle(clean(queries).where("id is not null").groupBy("id").agg(F.min(F.struct("vector", "dim")).alias("own")).select("id", "own.vector", "own.dim"))
    # a repeated vector would waste a pivot, so each counts once
    sent = context.broadcast({d: _unit(v) for d, v in sample(held, pivots, 11).items()})  # MOST_SENT components at most
    held, asking = dealt(held, asked, shard, block)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, none = ids_of(left)
        q_ids, _ = ids_of(right)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ids) and len(q_ids):
            x, q = matrix(left), matrix(right)
            unit, asked_unit = _unit(x), _unit(q)
            of = sent.value[x.shape[1]]
            m = min(posted, len(of))
            files = InvertedFiles(permutations(unit, of, m), len(of))
            near = min(len(ids), max(k, int(np.ceil(rerank * len(ids)))) + 1)  # one of them may be the query itself
            for i, order_i in enumerate(permutations(asked_unit, of, m)):
                distance = files.footrule(order_i)
                picked = np.argpartition(distance, near - 1)[:near] if near < len(ids) else np.arange(len(ids))
                picked = picked[ids[picked] != q_ids[i]]
                cosine = _cosine(x[picked], q[i])
                if len(picked):
                    score, best = _best(cosine[None, :], ids[picked][None, :], k)
                    out.append((np.full(score.shape[1], q_ids[i]), best[0], score[0]))
        query, vec, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(query), "vec_id": pa.array(vec, mask=(vec == 2**63 - 1) & bool(none.any())), "score": pa.array(score)})

    by = ["dim", "shard", "block"]
    found = held.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with q, from the vectors as they are unless their squares would leave the doubles."""
    dot, norms = (x * q).sum(1), np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
    odd = ~np.isfinite(dot) | ~np.isfinite(norms) | (norms < 1e-290)
    if odd.any():
        dot[odd], norms[odd] = (_unit(x[odd]) * _unit(q[None, :])).sum(1), 1.0
    return dot / norms


__all__ = ["InvertedFiles", "nearest", "permutations"]
