"""Exact top-k search by inner product: ball trees in spatial shards, searched by branch and bound.

Vectors belong to the cell of the nearest of a bounded sample of centres; a cell's vectors are dealt into shards of bounded size. A query
first visits the cell with the highest bound <q, centre> + |q| * radius, and what it finds there gives its kth score; then it visits only
those other cells whose bound reaches that score, and goes on from it. Within a shard it enters a node of the ball tree only if the
node's bound reaches the kth score; children come in the order of their bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import replaced, settle, small

#: Vectors of a shard, queries of a block and vectors of a leaf.
SHARD, BLOCK, LEAF = 8192, 8192, 64
#: Centres for each dimension that has more vectors than a shard, at most; and the number of all their components that is sent to tasks.
CELLS, MOST_SENT = 64, 8 << 20


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def dealt(vectors: DataFrame, queries: DataFrame, shard: int, block: int, by: tuple[str, ...] = ("dim",)):
    """(groups of vectors, groups of queries), both with the columns `by`, shard and block: each vector meets each query that shares `by` in one group.

    vectors (id, vector, *by), queries (id, vector, kth, *by), both settled. A vector goes to as many groups as its `by` has query blocks, of
    many queries each, and a query to as many as it has shards.
    """
    counts = vectors.groupBy(*by).agg(F.count("*").alias("n")).join(queries.groupBy(*by).agg(F.count("*").alias("q")), [*by])
    parts = small(settle(counts.select(*by, F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("q") / block).cast("int").alias("blocks")), few=True))

    def spread(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        joined = df.join(parts, [*by])
        joined = joined.withColumn(names[0], F.pmod(F.xxhash64("id", "vector"), F.col(own)).cast("int"))
        return joined.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*df.columns, "shard", "block")

    return spread(vectors, "shards", "blocks", ("shard", "block")), spread(queries, "blocks", "shards", ("block", "shard"))


def sample(vectors: DataFrame, most: int, seed: int, least: int = 0) -> dict[int, np.ndarray]:
    """For each dimension that more than `least` rows have, the at most `most` distinct vectors whose hashes are least.

    Should dimensions be so many that the samples have over MOST_SENT components, each gets fewer, one at least.
    """
    hashed = vectors.select("dim", F.xxhash64(F.lit(seed), "vector").alias("hash"), "vector")
    counts = hashed.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("distinct"))
    dims = {r["dim"]: r["distinct"] for r in counts.where(F.col("n") > least).collect()}  # a row for each length of vectors
    if not dims:
        return {}
    most = max(1, min(most, MOST_SENT // max(1, sum(dims))))
    # hashes are even, so some eight times as many as are wanted lie below these ends; only they are ranked
    ends = {d: min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, 8 * most / max(1, n)))) for d, n in dims.items()}
    low = hashed.where(F.col("dim").isin(list(dims))).where(F.col("hash") <= F.element_at(F.create_map(*[F.lit(x) for d in ends.items() for x in d]), F.col("dim")))
    order = Window.partitionBy("dim").orderBy("hash")
    found: dict[int, list] = {}
    for r in low.groupBy("dim", "hash").agg(F.first("vector").alias("vector")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).orderBy("dim", "nth").collect():
        found.setdefault(r["dim"], []).append(r["vector"])
    return {d: np.array(v, float) for d, v in found.items()}


def _celled(vectors: DataFrame, centres) -> DataFrame:
    """vectors with the cell of the nearest centre, and their distance from it; 0 and 0.0 where a dimension has no centres."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                if d in centres.value:
                    own = np.flatnonzero(dims == d)
                    x = matrix(pa.Table.from_batches([batch.take(pa.array(own))]))
                    c = centres.value[d]
                    near = ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)
                    cell[own], away[own] = near, np.sqrt(((x - c[near]) ** 2).sum(1))
            yield replaced(batch, {"cell": pa.array(cell), "away": pa.array(away)})

    return vectors.mapInArrow(run, "id long, vector array<double>, dim int, cell int, away double")


def matrix(table: pa.Table) -> np.ndarray:
    vectors = table["vector"].combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def ids_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and whether they are null; a null sorts after all others."""
    ids = table["id"].combine_chunks()
    none = ids.is_null().to_numpy(zero_copy_only=False)
    return ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64), none


class BallTree:
    """Nodes as arrays: rows order[low:high], centre, radius and children (-1: a leaf)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.arange(len(x))
        self.low, self.high, self.left, self.right, centres, radii = [], [], [], [], [], []
        stack = [(0, len(x), -1, False)]
        while stack:
            low, high, parent, is_right = stack.pop()
            node = len(self.low)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            own = x[self.order[low:high]]
            centre = own.mean(0) if high > low else np.zeros(x.shape[1])
            away = np.sqrt(((own - centre) ** 2).sum(1)) if high > low else np.zeros(1)
            self.low.append(low), self.high.append(high), self.left.append(-1), self.right.append(-1)
            centres.append(centre), radii.append(float(away.max()))
            if high - low > leaf and away.max() > 0:
                # split along the line from one far point to the one farthest from it
                a = own[away.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                middle = (high - low) // 2
                self.order[low:high] = self.order[low:high][np.argsort(own @ (b - a), kind="stable")]
                stack += [(low + middle, high, node, True), (low, low + middle, node, False)]
        self.centre, self.radius = np.array(centres), np.array(radii)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row of scores, ties to the smaller id."""
    if score.shape[1] > k:
        kth = -np.partition(-score, k - 1, 1)[:, k - 1 : k]
        width = int((score >= kth).sum(1).max())
        near = np.argsort(-score, 1, kind="stable")[:, :width] if width > 4 * k else np.argpartition(-score, width - 1, 1)[:, :width]
        score, ids = np.take_along_axis(score, near, 1), np.take_along_axis(ids, near, 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no inner product of a query with a vector in a ball exceeds, rounding included."""
    norm = np.sqrt((q**2).sum(1))[:, None]
    bound = q @ centre.T + norm * radius
    return bound + 1e-9 * (np.abs(bound) + norm * np.sqrt((centre**2).sum(1)) + 1.0)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, leaf: int = LEAF, kth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids (n queries by k; -inf where there are fewer) of the rows of x with the highest inner products, and how many products it took.

    kth: scores that k vectors elsewhere reach already; what lies below them need not come up. A row with the query's own id does not count. Products of integers are exact as long as they stay below 2 ** 53.
    """
    width = min(k, len(x))
    score = np.full((len(q), k), -np.inf)
    best = np.full((len(q), k), 2**63 - 1, np.int64)
    if not width or not len(q):
        return score, best, 0
    tree = BallTree(x, leaf)
    bound = _bounds(q, tree.centre, tree.radius)
    kth = np.full(len(q), -np.inf) if kth is None else kth
    products = 0
    stack = [(0, np.arange(len(q)))]
    while stack:
        node, asking = stack.pop()
        asking = asking[bound[asking, node] >= np.maximum(score[asking, -1], kth[asking])]
        if not len(asking):
            continue
        if tree.left[node] < 0:
            rows = tree.order[tree.low[node] : tree.high[node]]
            got = q[asking] @ x[rows].T
            products += got.size
            got[q_ids[asking][:, None] == ids[rows]] = -np.inf
            score[asking], best[asking] = _best(np.concatenate([score[asking], got], 1), np.concatenate([best[asking], np.broadcast_to(ids[rows], got.shape)], 1), k)
        else:
            left, right = tree.left[node], tree.right[node]
            first = bound[asking, left] >= bound[asking, right]
            # each child is entered first by the queries that it promises more; the sharing of kth scores goes on in between
            stack += [(right, asking[first]), (left, asking[~first]), (right, asking[~first]), (left, asking[first])]
    return score, best, products


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score double): the k vectors with the highest inner products, ties to the smaller id.

    vectors, queries: (id, vector) with numeric components. Vectors null or holding null or non-finite components take no part, nor do pairs of
    different dimension; a vector with the query's own id is no candidate. Repeated query ids ask once, with their least vector; repeated
    candidates all count. Candidates without id come last among ties. Empty tables give no rows.
    """
    context = vectors.sparkSession.sparkContext
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    centres = context.broadcast(sample(clean(vectors), cells, 13, least=shard))  # MOST_SENT components at most
    held = settle(_celled(clean(vectors), centres))
    asked = settle(clean(queries).where("id is not null").groupBy("id").agg(F.min(F.struct("vector", "dim")).alias("own")).select("id", "own.vector", "own.dim"))
    # the radius of each cell: a row for each, so they are sent as well
    radii: dict[int, dict[int, float]] = {}
    for r in held.groupBy("dim", "cell").agg(F.max("away").alias("radius")).where(F.col("dim").isin(list(centres.value))).collect():
        radii.setdefault(r["dim"], {})[r["cell"]] = r["radius"]
    balls = context.broadcast({d: (np.array(sorted(own)), centres.value[d][sorted(own)], np.array([own[c] for c in sorted(own)])) for d, own in radii.items()})

    def visits(batches):
        """The cells of each query: the one with the highest bound while kth is null, then all others whose bound reaches it."""
        for batch in batches:
            dims, kth = batch.column("dim").to_numpy(), batch.column("kth").to_numpy(zero_copy_only=False)
            rows, cells = [np.flatnonzero(~np.isin(dims, list(balls.value)) & np.isnan(kth))], []
            cells.append(np.zeros(len(rows[0]), np.int64))
            for d in np.unique(dims).tolist():
                if d in balls.value:
                    own = np.flatnonzero(dims == d)
                    names, centre, radius = balls.value[d]
                    bound = _bounds(matrix(pa.Table.from_batches([batch.take(pa.array(own))])), centre, radius)
                    best = np.arange(len(names)) == bound.argmax(1)[:, None]
                    at, which = np.nonzero(np.where(np.isnan(kth[own])[:, None], best, ~best & (bound >= kth[own][:, None])))
                    rows.append(own[at])
                    cells.append(names[which])
            yield replaced(batch.take(pa.array(np.concatenate(rows))), {"cell": pa.array(np.concatenate(cells).astype(np.int32))})

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = matrix(left), matrix(right)
        ids, none = ids_of(left)
        q_ids, _ = ids_of(right)
        if len(x) and len(q):
            kth = right["kth"].to_numpy()
            score, best, _ = search(x, ids, q, q_ids, k, kth=np.where(np.isnan(kth), -np.inf, kth))
            real = np.isfinite(score)
            return pa.table({"query_id": pa.array(np.repeat(q_ids, real.sum(1))), "vec_id": pa.array(best[real], mask=(best[real] == 2**63 - 1) & bool(none.any())), "score": pa.array(score[real])})
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def visited(asking: DataFrame) -> DataFrame:
        by = ["dim", "cell", "shard", "block"]
        came = settle(asking.mapInArrow(visits, "id long, vector array<double>, dim int, kth double, cell int"))
        here, there = dealt(held.drop("away"), came, shard, block, ("dim", "cell"))
        return here.groupBy(*by).cogroup(there.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score double")

    first = settle(ranked(visited(asked.withColumn("kth", F.lit(float("nan"))))))
    kths = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    again = asked.join(kths, asked["id"] == kths["query_id"], "left").select("id", "vector", "dim", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    return ranked(first.drop("rank").unionByName(visited(again))).select("query_id", "rank", "vec_id", "score")
