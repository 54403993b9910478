"""Byte-level BPE: encode whole texts by a rank file, decode ids, and digest both.

Pre-tokens that are new to a worker are merged together as padded matrices, one for each length bucket: in a round
every row merges its leftmost minimum-rank pair, so all rows lose one column at once; pairs are looked up in an
open-addressing hash table, only beside the merge, and finished rows leave the matrix. A very long pre-token is a matrix of one row, which
merges that pair at all its places in a round, so that the rounds do not grow with its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.common import WordHasher, ragged, replaced, slices, utf8

NONE = np.int32(2**31 - 1)
#: Rows wider than this merge all places of their minimum-rank pair in a round, where that gives what one after another would.
WIDEST = 128
#: Distinct pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1_500_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines 'base64 rank'; a rank that no line has becomes an empty token."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)]


class HashTable:
    """Open addressing from 64-bit keys (0 is none) to int32 values, all lookups and insertions in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.count = np.zeros(1 << 8, np.uint64), 0
        self.values = np.full(1 << 8, NONE, np.int32)
        self.insert(keys, values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table has not."""
        self.count += len(keys)
        if 4 * self.count > len(self.keys):
            old = self.keys > 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            size = 1 << (8 * self.count).bit_length() - 1
            self.keys, self.values = np.zeros(size, np.uint64), np.full(size, NONE, np.int32)
        slot, last = self._slot(keys), len(self.keys) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.keys[at], self.values[at] = keys[own], values[own]
            left = np.ones(len(keys), bool)
            left[own] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Their values, NONE where the table has none."""
        slot, last = self._slot(keys), len(self.keys) - 1
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        live = np.flatnonzero((found != keys) & (found != 0))
        key, slot = keys[live], (slot[live] + 1) & last
        while len(live):
            found = self.keys[slot]
            hit = found == key
            out[live[hit]] = self.values[slot[hit]]
            on = ~hit & (found != 0)
            live, key, slot = live[on], key[on], (slot[on] + 1) & last
        return out


class Splitter:
    """Starts and ends, in bytes, of the pre-tokens of a batch of texts.

    The pattern below is followed in numpy by classes of code points; any other pattern runs in the regex library, text by text.
    """

    #: Fixed value: the pre-token pattern of the 50k byte-level vocabularies.
    KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 0

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).finditer
        self.known = pattern == self.KNOWN
        if self.known:
            self.kind = np.full(0x110000, self.OTHER, np.uint8)
            for first in range(0, 0x110000, 0x8000):  # surrogates are no text, and stay in OTHER
                if first != 0xD800 - 0xD800 % 0x8000:
                    block = "".join(map(chr, range(first, first + 0x8000)))
                else:
                    block = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(first, first + 0x8000))
                for kind, what in ((self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+"), (self.SPACE, r"\s+")):
                    for m in regex.finditer(what, block):
                        self.kind[first + m.start() : first + m.end()] = kind

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._classes(data, at) if self.known else self._regex(data, at)

    def _regex(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            text = data[a:b].tobytes().decode("utf-8", "replace")
            if len(text) == b - a:
                spans += [(a + m.start(), a + m.end()) for m in self.find(text)]
            else:
                place = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) + a
                spans += [(place[m.start()], place[m.end()]) for m in self.find(text)]
        out = np.array(spans, np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]

    def _classes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if (data < 0x80).all():
            char, code = np.arange(len(data)), data
        else:
            char = np.flatnonzero((data & 0xC0) != 0x80)
            lead = data[char]
            code = lead.astype(np.int32)
            for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
                wide = np.flatnonzero((lead >= least) & (lead < (0x100 if more == 3 else least + (0x20 if more == 1 else 0x10))))
                value = (lead[wide] & mask).astype(np.int32)
                for k in range(1, more + 1):
                    value = (value << 6) | (data[char[wide] + k] & 0x3F)
                code[wide] = value
        kind = self.kind[code]
        n = len(char)
        first = np.zeros(n + 1, bool)  # of a text
        first[np.searchsorted(char, at)] = True
        first[n] = True
        change = np.empty(n + 1, bool)
        change[1:n] = kind[1:] != kind[:-1]
        change[0] = change[n] = True
        change |= first
        start = change[:n].copy()
        # the last of some white space goes with the run after it if it is a blank, and else alone
        tail = np.flatnonzero((kind == self.SPACE) & change[1:] & ~first[1:])
        start[tail] = True
        blank = tail[code[tail] == 0x20]
        start[blank + 1] = False
        # an apostrophe that begins a pre-token, and what is short for a word
        quote = np.flatnonzero(change[:n] & change[1:] & (code == 0x27) & start)
        quote = quote[~first[quote + 1]]
        if len(quote):
            padded = np.concatenate([code, np.zeros(3, code.dtype)])
            limit = np.concatenate([first, np.ones(2, bool)])
            one, two = padded[quote + 1], np.where(limit[quote + 2], 0, padded[quote + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            start[quote[short | long] + 1] = False
            after = np.concatenate([quote[short] + 2, quote[long & ~short] + 3])
            start[after[after < n]] = True
        starts = char[start]
        return starts, np.append(starts[1:], len(data))


class Codec:
    """Tables of a vocabulary, and the pre-tokens that this process has encoded so far."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes, such as {missing[0]}")
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = np.array([(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids], np.int64).reshape(-1, 3)
        self.pairs = HashTable(self._pair(pairs[:, 0], pairs[:, 1]), pairs[:, 2].astype(np.int32))
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        decimals = [b"%d " % i for i in range(len(tokens))]
        self.decimal_length = np.array([len(d) for d in decimals], np.int64)
        self.decimal_start = np.cumsum(self.decimal_length) - self.decimal_length
        self.decimal_flat = np.frombuffer(b"".join(decimals), np.uint8)
        self.splitter, self.hasher = Splitter(pattern), WordHasher(fold=False)
        self.forget()

    def __reduce__(self):
        return Codec, (self.tokens, self.pattern)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.int64) + 1) << 32 | (b.astype(np.int64) + 1)).astype(np.uint64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make, NONE where they make none or one is padding (-1)."""
        return self.pairs.get(self._pair(a, b))

    # encoding of pre-tokens

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces of data, one after another, and how many each has."""
        counts = np.ones(len(starts), np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = []  # piece of each id, ids
        bucket = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for width in np.unique(bucket):
            members = np.flatnonzero(bucket == width)
            if width > WIDEST:
                for k in members:
                    ids = self._merge_wide(data[starts[k] : starts[k] + lengths[k]])
                    made.append((np.full(len(ids), k), ids))
            else:
                self._merge_bucket(data, starts, lengths, members, int(width), made)
        if not made:
            return np.zeros(0, np.int32), counts
        owner, ids = (np.concatenate(x) for x in zip(*made, strict=True))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(starts))

    def _merge_bucket(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, width: int, made: list) -> None:
        n = lengths[owner]
        m = np.full((len(owner), width), -1, np.int32)
        m[np.arange(width) < n[:, None]] = self.single[ragged(data, starts[owner], n)]
        ranks = self.rank(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        while len(owner):
            row, j = np.arange(len(owner)), ranks.argmin(1)
            best = ranks[row, j]
            done = best == NONE
            if done.any():
                real = m[done] >= 0
                made.append((np.repeat(owner[done], real.sum(1)), m[done][real]))
                keep = ~done
                m, ranks, owner, j, best = m[keep], ranks[keep], owner[keep], j[keep], best[keep]
                if not len(owner):
                    return
                width = int((m >= 0).sum(1).max())
                m, ranks, row = m[:, :width], ranks[:, : width - 1], np.arange(len(owner))
            m[row, j] = best
            columns = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, columns + (columns > j[:, None]), 1)
            if m.shape[1] == 1:
                made.append((owner, m[:, 0]))
                return
            columns = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, columns + (columns >= j[:, None]), 1)
            left = np.flatnonzero(j > 0)
            ranks[left, j[left] - 1] = self.rank(m[left, j[left] - 1], m[left, j[left]])
            right = np.flatnonzero(j < ranks.shape[1])
            ranks[right, j[right]] = self.rank(m[right, j[right]], m[right, j[right] + 1])

    def _merge_wide(self, piece: np.ndarray) -> np.ndarray:
        """The same merges for one very long piece. A round takes all disjoint places of the minimum-rank pair from the left, but only the
        first if one of the pairs that come up beside them, then or on the way, would be merged before the others."""
        ids = self.single[piece]
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            begins = np.append(True, np.diff(at) > 1)
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))) % 2 == 0]
            follows = at[at + 2 < len(ids)]
            if len(at) > 1 and (self.rank(np.full(len(follows), best), ids[follows + 2]) <= best).any():
                at = at[:1]
            while True:
                merged = ids.copy()
                merged[at] = best
                merged, spot = np.delete(merged, at + 1), at - np.arange(len(at))
                left, right = spot[spot > 0], spot[spot < len(merged) - 1]
                before, after = self.rank(merged[left - 1], merged[left]), self.rank(merged[right], merged[right + 1])
                if len(at) == 1 or not ((before <= best).any() or (after <= best).any()):
                    break
                at = at[:1]
            ids, ranks = merged, np.delete(ranks, at)
            ranks[left - 1], ranks[right] = before, after
        return ids

    # encoding of texts

    def forget(self) -> None:
        """Remember the tokens themselves only: a pre-token that is a token stands for itself."""
        real = np.flatnonzero(self.length > 0)
        hashes = self.hasher.spans(self.flat, self.start[real], self.start[real] + self.length[real])
        self.codes = HashTable(hashes, np.arange(len(real), dtype=np.int32))
        self.piece_ids, self.used = np.resize(real.astype(np.int32), 1 << 20), len(real)
        self.piece_start, self.piece_length, self.pieces = np.resize(np.arange(len(real)), 1 << 20), np.ones(1 << 20, np.int64), len(real)

    def codes_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each pre-token is remembered under; new ones are encoded, once each."""
        if self.pieces > REMEMBERED:
            self.forget()
        hashes = self.hasher.spans(data, starts, ends)
        codes = self.codes.get(hashes)
        new = np.flatnonzero(codes == NONE)
        if len(new):
            keys, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            own = new[first]
            ids, counts = self.merge(data, starts[own], ends[own] - starts[own])
            for name, more, room in (("piece_ids", ids, self.used), ("piece_start", self.used + np.cumsum(counts) - counts, self.pieces), ("piece_length", counts, self.pieces)):
                kept = getattr(self, name)
                while room + len(more) > len(kept):
                    kept = np.concatenate([kept, np.zeros_like(kept)])
                kept[room : room + len(more)] = more
                setattr(self, name, kept)
            made = np.arange(self.pieces, self.pieces + len(keys), dtype=np.int32)
            self.codes.insert(keys, made)
            self.used, self.pieces = self.used + len(ids), self.pieces + len(keys)
            codes[new] = made[which]
        return codes

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the n + 1 offsets of the texts in them. data, at: bytes of the texts and their n + 1 offsets.

        Pre-tokens are remembered by 64-bit hashes; should two ever share one, the ids do not give the bytes back, and the batch is encoded afresh.
        """
        starts, ends = self.splitter(data, at)
        ids, counts = self.pieces_of(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, at)]

    def pieces_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens that follow one another, and how many each has."""
        codes = self.codes_of(data, starts, ends)
        counts = self.piece_length[codes]
        ids = ragged(self.piece_ids, self.piece_start[codes], counts)
        if len(starts) and not np.array_equal(self.decode(ids), data[starts[0] : ends[-1]]):
            ids, counts = self._afresh(data, starts, ends)
        return ids, counts

    def _afresh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            whole = self.ids.get(data[a:b].tobytes())
            made.append(self.merge(data, np.array([a]), np.array([b - a]))[0] if whole is None else np.array([whole], np.int32))
        return np.concatenate([np.zeros(0, np.int32), *made]), np.array([len(x) for x in made], np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id lies outside the vocabulary")
        return ragged(self.flat, self.start[ids], self.length[ids])

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.decimal_flat, self.decimal_start[ids], self.decimal_length[ids])


def _codec(path: str, pattern: str) -> Codec:
    """The vocabulary is read once, on the driver, and travels with the tasks; rank files hold at most a few MB."""
    tokens = read_ranks(path)
    if sum(map(len, tokens)) > 64 << 20:
        raise ValueError("the rank file is too large to send to every task")
    return Codec(tokens, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with the column ids, array<int>, of each whole text. Null texts count as empty; empty ones give an empty array.

    All other columns stay; a column already called as ids is replaced. Rows are independent: repeats repeat.
    """
    codec = docs.sparkSession.sparkContext.broadcast(_codec(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            flat, at = codec.value.encode(*utf8(batch.column(text)))
            yield replaced(batch, {ids: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))})

    schema = T.StructType([f for f in docs.schema if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda it: (b.select(schema.names) for b in run(it)), schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """rows with the column text, binary: the bytes of their ids. Null ids give null, none give no bytes, an id without a token is an error."""
    codec = rows.sparkSession.sparkContext.broadcast(_codec(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else codec.value.decode(np.array(x, np.int64)).tobytes() for x in batch.column(ids).to_pylist()]
            yield replaced(batch, {text: pa.array(made, pa.binary())}).select(schema.names)

    schema = T.StructType([f for f in rows.schema if f.name != text] + [T.StructField(text, T.BinaryType())])
    return rows.mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids again, and digest both in the same pass, so that no ids travel.

    Adds n_tokens long, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the decoded bytes), and drops the text.
    Null texts count as empty. Columns of these names are replaced, all others stay.
    """
    codec = docs.sparkSession.sparkContext.broadcast(_codec(path, pattern))
    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in slices(batches, text):
            data, at = utf8(batch.column(text))
            ids, at = own.encode(data, at)
            n = at[1:] - at[:-1]
            digests = []
            for flat, lengths, gap in ((own.decimals(ids), own.decimal_length, 1), (own.decode(ids), own.length, 0)):
                ends = np.concatenate([[0], np.cumsum(lengths[ids])])[at]
                view = memoryview(np.ascontiguousarray(flat))
                digests.append([hashlib.sha256(view[a : max(a, b - gap)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            yield replaced(batch, dict(zip([k for k, _ in new], [pa.array(n, pa.int64()), *map(pa.array, digests)], strict=True))).select(schema.names)

    schema = T.StructType([f for f in docs.schema if f.name not in {text, *(k for k, _ in new)}] + [T.StructField(k, t) for k, t in new])
    return docs.mapInArrow(run, schema)


__all__ = ["Codec", "decode", "encode", "encode_decode", "read_ranks"]
