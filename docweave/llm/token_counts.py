"""Token counts that follow edits: pre-tokens in the leaves of a segment tree, sums of characters and tokens above them.

An edit finds its leaves by descending the sums, splits the touched text and a little context anew until a pre-token ends where an
untouched leaf begins, encodes only the pre-tokens found there, and updates the sums on the paths to those leaves.

Trees are kept beside their documents as a column of leaves and their counts (grow), and later edits start from that column (amend), so
that a text is split and encoded as a whole only once. count_tokens does both in one pass for edits that are known at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docweave.llm.bpe import Codec, _codec
from docweave.llm.common import replaced, slices, utf8

#: Pre-tokens of a leaf.
LEAF = 32
#: Characters past its end that the match of a pre-token may have looked at.
LOOK = 3
#: A tree as it is kept: the texts of its leaves, and their tokens. Sums above them come from one addition for each leaf.
TREE = T.StructType([T.StructField("leaves", T.ArrayType(T.StringType())), T.StructField("tokens", T.ArrayType(T.LongType()))])
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("delete", T.LongType()), T.StructField("insert", T.StringType())]))


class Counter:
    """Pre-tokens of single texts and their numbers of tokens."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def split(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(data, np.uint8)
        return self.codec.splitter(flat, np.array([0, len(flat)]))

    def count(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> int:
        if not len(starts):
            return 0
        return len(self.codec.pieces_of(np.frombuffer(data, np.uint8), starts, ends)[0])


class TokenTree:
    """A document's leaves and the sums above them. chars, tokens: arrays in heap order, the leaves in their second half."""

    def __init__(self, leaves: list[bytes], chars: np.ndarray, tokens: np.ndarray):
        self.leaves = leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        for sums, own in ((self.chars, chars), (self.tokens, tokens)):
            sums[self.size : self.size + len(own)] = own
            level = self.size
            while level > 1:
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
                level //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place, and the place of its first one; the last leaf for places at the end."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if place >= before + self.chars[node] and self.chars[node + 1] > 0:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def put(self, leaf: int, text: bytes, tokens: int) -> None:
        """Replace a leaf and renew the sums on its path."""
        self.leaves[leaf] = text
        node = self.size + leaf
        more = len(text.decode("utf-8", "replace")) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def edit(self, counter: Counter, start: int, delete: int, insert: str) -> int:
        """Replace `delete` characters from `start` on, both cut to the text; returns how many pre-tokens were encoded again."""
        total = int(self.chars[1])
        start = min(max(start, 0), total)
        end = min(start + max(delete, 0), total)
        first, before = self.find(max(0, start - LOOK))
        last, last_before = self.find(end)
        last = max(last, first)
        old = b"".join(self.leaves[first : last + 1]).decode("utf-8", "replace")
        body = (old[: start - before] + insert + old[end - before :]).encode("utf-8", "surrogatepass")
        while True:
            # context: whole leaves that hold LOOK characters more, or all that follow
            context, seen, nxt = b"", 0, last + 1
            while nxt < len(self.leaves) and seen <= LOOK:
                context += self.leaves[nxt]
                seen += int(self.chars[self.size + nxt])
                nxt += 1
            starts, ends = counter.split(body + context)
            if not context or len(body) in (0, *ends.tolist()):
                break
            # a pre-token reaches over the boundary: take the next leaf in
            last += 1
            body += self.leaves[last]
        own = ends <= len(body)
        self.put(first, body, counter.count(body + context, starts[own], ends[own]))
        for leaf in range(first + 1, last + 1):
            self.put(leaf, b"", 0)
        return int(own.sum())

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @classmethod
    def kept(cls, leaves: list[str], tokens: list[int]) -> TokenTree:
        return cls([x.encode() for x in leaves], np.array([len(x) for x in leaves], np.int64), np.array(tokens, np.int64))

    def to_keep(self) -> dict:
        """What goes into a column of type TREE; emptied leaves go."""
        own = [(x.decode("utf-8", "replace"), int(n)) for x, n in zip(self.leaves, self.tokens[self.size : self.size + len(self.leaves)], strict=True) if x]
        return {"leaves": [x for x, _ in own] or [""], "tokens": [n for _, n in own] or [0]}


def trees(codec: Codec, data: np.ndarray, at: np.ndarray, leaf: int = LEAF) -> Iterator[TokenTree]:
    """A tree for each text, all pre-tokens of the batch encoded together."""
    starts, ends = codec.splitter(data, at)
    counts = np.concatenate([[0], np.cumsum(codec.pieces_of(data, starts, ends)[1])])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = np.searchsorted(starts, at)
    whole = data.tobytes()
    for k in range(len(at) - 1):
        cuts = np.append(np.arange(edges[k], edges[k + 1], leaf), edges[k + 1])
        if len(cuts) < 2:
            yield TokenTree([b""], np.zeros(1, np.int64), np.zeros(1, np.int64))
            continue
        places = np.append(starts[cuts[:-1]], at[k + 1])
        yield TokenTree([whole[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], np.diff(chars[places]), np.diff(counts[cuts]))


def _edited(tree: TokenTree, counter: Counter, edits: list | None) -> int:
    """Apply edits in order; null edits count as none, null fields as 0 or ""."""
    return sum(tree.edit(counter, e["start"] or 0, e["delete"] or 0, e["insert"] or "") for e in edits or [] if e)


def _schema(df: DataFrame, without: set[str], new: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n for n, _ in new}
    return T.StructType([f for f in df.schema if f.name not in without | names] + [T.StructField(n, t) for n, t in new])


def grow(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens long and token_tree, to be stored; columns of these names are replaced, all others stay. Null texts count as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(_codec(path, pattern))
    schema = _schema(docs, set(), [("n_tokens", T.LongType()), ("token_tree", TREE)])
    kind = to_arrow_type(TREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = list(trees(sent.value, *utf8(batch.column(text))))
            new = {"n_tokens": pa.array([t.total for t in made], pa.int64()), "token_tree": pa.array([t.to_keep() for t in made], kind)}
            yield replaced(batch, new).select(schema.names)

    return docs.mapInArrow(run, schema)


def amend(rows: DataFrame, path: str, pattern: str, edits: str = "edits") -> DataFrame:
    """rows of grow or of an earlier call, with the edits of that column done to token_tree: n_tokens follows, recounted long is added, the edits go.

    A null tree is that of an empty text. Edits are those of count_tokens; texts are the leaves of the tree, one after another.
    """
    sent = rows.sparkSession.sparkContext.broadcast(_codec(path, pattern))
    schema = _schema(rows, {edits}, [("n_tokens", T.LongType()), ("token_tree", TREE), ("recounted", T.LongType())])
    kind = to_arrow_type(TREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            out = []
            for kept, own in zip(batch.column("token_tree").to_pylist(), batch.column(edits).to_pylist(), strict=True):
                tree = TokenTree.kept(kept["leaves"], kept["tokens"]) if kept else TokenTree.kept([""], [0])
                again = _edited(tree, counter, own)
                out.append((tree.total, tree.to_keep(), again))
            new = {"n_tokens": pa.array([o[0] for o in out], pa.int64()), "token_tree": pa.array([o[1] for o in out], kind), "recounted": pa.array([o[2] for o in out], pa.int64())}
            yield replaced(batch, new).select(schema.names)

    return rows.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", edits: str | None = None) -> DataFrame:
    """docs without text and edits, with n_tokens long (of the whole text) and, given a column of edits, n_tokens_edited and recounted longs.

    edits: array<struct<start long, delete long, insert string>>, in order, each on the text that the ones before left, in code points; places
    beyond the text are cut to it. recounted: pre-tokens that were encoded again, over all edits. Null texts count as empty, null edits as none,
    null fields as 0 or "". Columns of the new names are replaced, all others stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_codec(path, pattern))
    new = ["n_tokens"] + (["n_tokens_edited", "recounted"] if edits else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in slices(batches, text):
            asked = batch.column(edits).to_pylist() if edits else [None] * batch.num_rows
            out = []
            for tree, own in zip(trees(sent.value, *utf8(batch.column(text))), asked, strict=True):
                before = tree.total
                again = _edited(tree, counter, own)
                out.append((before, tree.total, again))
            yield replaced(batch, {name: pa.array([o[i] for o in out], pa.int64()) for i, name in enumerate(new)}).select(schema.names)

    schema = T.StructType([f for f in docs.schema if f.name not in {text, edits, *new}] + [T.StructField(n, T.LongType()) for n in new])
    return docs.mapInArrow(run, schema)
