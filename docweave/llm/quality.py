"""A quality classifier: random-indexing word vectors, pooled per document, into a two-layer network with calibrated probabilities.

Tokens are words and runs of marks as they stand. Every token has a sparse ternary index vector, drawn for the bucket of its
hash; the context vector of a bucket sums the index vectors of its neighbours in the sample. Both together are a word's vector. Shapes
(case, length, kind of token) have vectors of the same kind, which also cover words that the sample has not. A document's
features are the means of its word and shape vectors and its length. Ids, languages, sources and labels are no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import WordHasher, replaced, settle, slices, utf8

#: Labelled documents that the model is fitted on, at most: those whose hashes are least.
SAMPLE = 6000
BUCKETS, SHAPES, DIM, NONZERO, WINDOW, HIDDEN, EPOCHS = 8192, 64, 64, 6, 2, 32, 60
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


class Tokens:
    """Buckets, shapes and rows of the tokens of a batch."""

    def __init__(self):
        self.hasher = WordHasher(fold=False, runs=True)
        upper = np.zeros(256, np.int64)
        upper[0x41:0x5B] = 1
        upper[0x61:0x7B] = 2
        upper[0x30:0x3A] = 3
        upper[0x80:] = 2
        self.case = upper

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, starts, ends, row = self.hasher.words(data, at)
        first, last = self.case[data[starts]] if len(starts) else starts, self.case[data[ends - 1]] if len(ends) else ends
        length = np.minimum(ends - starts, 8)
        shape = first * 16 + last * 4 + np.searchsorted([2, 4, 8], length, "right")
        return (hashes % np.uint64(BUCKETS)).astype(np.int64), shape, row


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse ternary vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.int64)
    where = rng.random((n, DIM)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out, where, rng.choice([-1, 1], (n, NONZERO)), 1)
    return out


def contexts(code: np.ndarray, row: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each code the sum of the index vectors of its neighbours within WINDOW tokens of the same document."""
    n = len(index)
    out = np.zeros_like(index)
    for step in range(1, WINDOW + 1):
        same = row[step:] == row[:-step]
        pair, count = np.unique(code[:-step][same] * n + code[step:][same], return_counts=True)
        a, b = pair // n, pair % n
        for own, other in ((a, b), (b, a)):
            for d in range(DIM):
                out[:, d] += np.bincount(own, index[other, d] * count, n).astype(np.int64)
    return out


def _length_one(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True)), 1e-9)


@dataclass
class Model:
    """words, shapes: vectors of buckets and shapes; the rest scales features and runs the network."""

    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -500, 500)))


def pool(words: np.ndarray, shapes: np.ndarray, tokens: Tokens, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Features of each text: mean word vector, mean shape vector, logarithm of the number of tokens; zeros where there is no token."""
    code, shape, row = tokens(data, at)
    n = len(at) - 1
    counts = np.bincount(row, minlength=n)
    out = np.zeros((n, 2 * DIM + 1))
    some = np.flatnonzero(counts)
    if len(some):
        first = (np.cumsum(counts) - counts)[some]
        out[some, :DIM] = np.add.reduceat(words[code], first, 0) / counts[some, None]
        by_shape = np.bincount(row * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)[some]
        out[some, DIM : 2 * DIM] = by_shape @ shapes / counts[some, None]
        out[some, -1] = np.log1p(counts[some])
    return out


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Weights of the network by Adam, then the temperature that makes a fifth of the rows, kept out of training, most likely."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 1e-6 if len(x) else np.ones(x.shape[1])
    w = {"w1": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), "b2": np.zeros(1)}
    if len(np.unique(y)) < 2:
        # nothing to tell apart: the smoothed share of label 1 for every text
        share = (y.sum() + 1) / (len(y) + 2)
        return {"mean": mean, "scale": scale, "w1": w["w1"] * 0, "b1": w["b1"], "w2": w["w2"], "b2": float(np.log(share / (1 - share))), "temperature": 1.0}
    z = (x - mean) / scale
    order = rng.permutation(len(z))
    fit, tune = order[len(order) // 5 :], order[: len(order) // 5]
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for part in np.array_split(fit, max(1, len(fit) // 64)):
            step += 1
            hidden = np.maximum(z[part] @ w["w1"] + w["b1"], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w["w2"] + w["b2"], -50, 50)))
            off = (p - y[part]) / len(part)
            back = np.outer(off, w["w2"]) * (hidden > 0)
            slope = {"w1": z[part].T @ back + 1e-4 * w["w1"], "b1": back.sum(0), "w2": hidden.T @ off + 1e-4 * w["w2"], "b2": np.array([off.sum()])}
            for k, g in slope.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] = w[k] - 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logit = np.maximum(z[tune] @ w["w1"] + w["b1"], 0) @ w["w2"] + w["b2"]
    loss = lambda t: np.logaddexp(0, np.where(y[tune] > 0, -1, 1) * logit / t).mean() if len(tune) else 0.0
    temperature = min(np.exp(np.linspace(-1, 2, 61)), key=loss)
    return {"mean": mean, "scale": scale, "w1": w["w1"], "b1": w["b1"], "w2": w["w2"], "b2": float(w["b2"][0]), "temperature": float(temperature)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows that are not held out, those whose hashes of id and text are least.

    Rows with null id, text or label are not learned from; a document with several labels counts as 0 if one of them is 0.
    Without rows of both labels the model gives one smoothed share for all texts.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("of")).agg((F.min(label) > 0).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(1), "of"), "of").limit(sample)  # a bounded sample, so the join below can be broadcast
    joined = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("label", "text", F.xxhash64("of", "text").alias("row"))
    rows = settle(joined.orderBy("row").limit(sample).repartition(8, "row"))
    index, shape_index = index_vectors(BUCKETS, 1), index_vectors(SHAPES, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, word_sum, shape_sum, seen = Tokens(), np.zeros((BUCKETS, DIM), np.int64), np.zeros((SHAPES, DIM), np.int64), False
        for batch in slices(batches, "text"):
            code, shape, row = tokens(*utf8(batch.column("text")))
            word_sum += contexts(code, row, index)
            shape_sum += contexts(shape, row, shape_index)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([word_sum.astype(np.int32).tobytes()]), pa.array([shape_sum.astype(np.int64).tobytes()])], names=["words", "shapes"])

    word_sum, shape_sum = np.zeros((BUCKETS, DIM), np.int64), np.zeros((SHAPES, DIM), np.int64)
    for r in rows.select("text").mapInArrow(count, "words binary, shapes binary").toLocalIterator():  # one table of fixed size from each of 8 tasks
        word_sum += np.frombuffer(r["words"], np.int32).reshape(BUCKETS, DIM)
        shape_sum += np.frombuffer(r["shapes"], np.int64).reshape(SHAPES, DIM)
    words, shapes = (_length_one(_length_one(i) + _length_one(c)).astype(np.float32) for i, c in ((index, word_sum), (shape_index, shape_sum)))
    sent = spark.sparkContext.broadcast((words, shapes))  # 2 MB

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in slices(batches, "text"):
            x = pool(*sent.value, tokens, *utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), pa.array([v.tobytes() for v in x])], names=["row", "label", "x"])

    got = sorted(rows.mapInArrow(featured, "row long, label double, x binary").collect(), key=lambda r: (r["row"], r["label"], bytes(r["x"])))  # 1 KB for each sampled row
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(-1, 2 * DIM + 1)
    return Model(words, shapes, **train(x, np.array([r["label"] for r in got])))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the probability that a text has label 1, from its whole text; null counts as empty. A column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, own = Tokens(), sent.value
        for batch in slices(batches, "text", 1 << 19):
            p = own.probability(pool(own.words, own.shapes, tokens, *utf8(batch.column("text"))))
            yield replaced(batch, {column: pa.array(p)}).select(schema.names)

    schema = T.StructType([f for f in docs.schema if f.name != column] + [T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(run, schema)
