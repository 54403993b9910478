"""Near-duplicate documents by DartMinHash, with exact verification.

Words are lower-cased runs of ASCII letters, digits and all other code points above 127; a document's elements are its distinct
runs of five words (fewer words are one element; none, no element). Darts are thrown into each element's region, weight by rank,
as a hashed Poisson process, so that equal elements get equal darts in all documents; the earliest dart of each of k coordinates
is the signature. Bands of equal values are joined: documents that share one are the candidates.

Candidates are settled exactly, in two steps. First every member of a bucket is compared with its centre, the member that shares
buckets with most others, and what is similar enough joins its class. What a bucket still holds of other classes is then compared
with all its members, but for pairs that a bound rules out: two sets share no element that only one of all candidates has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import WordHasher, discard, mix64, row_key, settle, slices, spare, utf8

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 5: a pair at 0.8 is missed with a chance of 3e-6.
BANDS, ROWS = 32, 5
#: How often elements are counted among the sets that are left, which leaves out what the bound rules out everywhere.
COUNTS = 2
#: Rank below which the first cell of an element's region lies; later cells double.
CELL = 1 / 64
#: Edges of one centre that meet in one task while pairs are verified.
PER_TASK = 2000
_MAX_DARTS = 4096


def _poisson_table(area: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2, ... darts."""
    chance, total, out = np.exp(-area), 0.0, []
    for k in range(_MAX_DARTS):
        total += chance
        out.append(total)
        chance *= area / (k + 1)
        if k > area and chance < 1e-18:
            break
    return np.array(out)


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class DartMinHash:
    """Signatures of weighted sets: for each of k coordinates the earliest dart among those below the elements' weights."""

    def __init__(self, k: int):
        self.k = k
        self.wanted = k * np.log(k) + 2 * k  # darts that leave no coordinate empty, but for rare sets

    def darts(self, element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the element, rank and 64-bit name of all darts under its weight and with a rank below its limit."""
        found = []
        top_w, top_r = float(weight.max(initial=0)), float(limit.max(initial=0))
        low_w, high_w, nu = 0.0, 1.0, 0
        while low_w < top_w:
            low_r, high_r, rho = 0.0, CELL, 0
            while low_r < top_r:
                inside = np.flatnonzero((weight > low_w) & (limit > low_r))
                # a cell of more than 16 expected darts is split, so that counts stay small
                parts = max(1, int(np.ceil((high_w - low_w) * (high_r - low_r) / 16)))
                step = (high_r - low_r) / parts
                table = _poisson_table((high_w - low_w) * step)
                for part in range(parts):
                    start = low_r + part * step
                    own = inside if part == 0 else inside[limit[inside] > start]
                    if not len(own):
                        break
                    seed = mix64(element[own] ^ np.uint64((nu * 64 + rho) * 0x9E3779B97F4A7C15 + part * 0xC2B2AE3D27D4EB4F & 2**64 - 1))
                    count = np.searchsorted(table, _uniform(seed), "right")
                    at = np.repeat(np.arange(len(own)), count)
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                    name = mix64(seed[at] + (nth + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                    rank = start + step * _uniform(name)
                    good = rank < limit[own[at]]
                    if nu or high_w > top_w or (weight[own] < high_w).any():
                        good &= low_w + (high_w - low_w) * _uniform(mix64(name ^ np.uint64(0x5851F42D4C957F2D))) < weight[own[at]]
                    found.append((own[at[good]], rank[good], name[good]))
                low_r, high_r, rho = high_r, high_r * 2, rho + 1
            low_w, high_w, nu = high_w, high_w * 2, nu + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def signatures(self, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """n rows of k names; owner: the set of each element, from 0 to n - 1, none of them empty."""
        total = np.bincount(owner, weight, n)
        factor = np.ones(n)
        out = np.zeros((n, self.k), np.uint64)
        open_sets = np.arange(n)
        chosen = np.arange(len(owner))
        while len(open_sets):
            limit = (self.wanted * factor / np.maximum(total, 1e-300))[owner[chosen]]
            of, rank, name = self.darts(element[chosen], weight[chosen], limit)
            spot = owner[chosen[of]] * self.k + (mix64(name ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(self.k)).astype(np.int64)
            # by coordinate, then rank
            order = np.argsort(spot + rank / (float(limit.max(initial=0)) * (1 + 1e-9)))
            spot = spot[order]
            first = np.ones(len(spot), bool)
            first[1:] = spot[1:] != spot[:-1]
            out.reshape(-1)[spot[first]] = np.maximum(name[order][first], np.uint64(1))
            full = np.zeros(n, np.int64)
            np.add.at(full, spot[first] // self.k, 1)
            open_sets = open_sets[full[open_sets] < self.k]
            again = np.zeros(n, bool)
            again[open_sets] = True
            factor[open_sets] *= 2
            out[open_sets] = 0
            chosen = np.flatnonzero(again[owner])
        return out


def shingles(hasher: WordHasher, data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of the distinct runs of `size` words, sorted by row and hash."""
    word, _, _, row = hasher.words(data, at)
    n = len(at) - 1
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    scale = [np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 2**64)) for k in range(size)]
    length = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    start = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
    owner = np.repeat(np.arange(n), length)
    total = np.zeros(len(start), np.uint64)
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    last = (first + counts)[owner]
    for k in range(size):
        total += np.where(start + k < last, padded[start + k], np.uint64(0)) * scale[k]
    total = mix64(total + np.minimum(counts, size)[owner].astype(np.uint64))
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(new)))
    return owner[new], total[new], times


def _elements(hasher: WordHasher, batch: pa.RecordBatch, size: int, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, element and weight of the darts, then owner and name of what stands in the set.

    A weighted set holds an element as often as it occurs, under names that count it: its plain similarity is the weighted one.
    """
    owner, element, times = shingles(hasher, *utf8(batch.column("text")), size)
    if not weighted:
        return owner, element, np.ones(len(owner)), owner, element
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    named = np.where(nth > 0, mix64(np.repeat(element, times) + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), np.repeat(element, times))
    return owner, element, times.astype(float), np.repeat(owner, times), named


def _signed(batches, size: int, bands: int, rows: int, weighted: bool):
    """(row, id, key) columns with the hash of each row's set of elements, their number, and its bands; empty sets have null."""
    hasher, dart = WordHasher(), DartMinHash(bands * rows)
    salt = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
    for batch in slices(batches, "text", 1 << 20):
        of, element, weight, owner, held = _elements(hasher, batch, size, weighted)
        n = batch.num_rows
        counts = np.bincount(owner, minlength=n)
        some = np.flatnonzero(counts)
        total = np.concatenate([[0], np.cumsum(held, dtype=np.uint64)]).astype(np.uint64)
        mixed = np.concatenate([[0], np.cumsum(mix64(held ^ np.uint64(0x9D39247E33776D41)), dtype=np.uint64)]).astype(np.uint64)
        ends = np.cumsum(counts)
        sums = [t[ends] - t[ends - counts] for t in (total, mixed)]
        name = mix64(sums[0] + mix64(sums[1]) + counts.astype(np.uint64))
        # copies in one batch are signed once
        _, which, back = np.unique(name[some], return_index=True, return_inverse=True)
        picked = np.zeros(n, bool)
        picked[some[which]] = True
        keep = picked[of]
        rank = np.cumsum(picked) - 1
        sign = dart.signatures(rank[of[keep]], element[keep], weight[keep], len(which))
        keys = (mix64(sign.reshape(len(which), bands, rows) * salt)).sum(2, dtype=np.uint64)
        keys = mix64(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)).view(np.int64)
        keys = keys[rank[some[which]][back]]
        empty = counts == 0
        offsets = np.concatenate([[0], np.cumsum(~empty) * bands])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("row"), pa.array(name.view(np.int64), mask=empty), pa.array(counts.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.reshape(-1), pa.int64())),
            ],
            names=["doc_id", "row", "set", "size", "keys"],
        )


def _sets(batches, size: int, weighted: bool):
    """(set, elements) of each row; of rows with one set that meet here, the first."""
    hasher, seen = WordHasher(), set()
    for batch in slices(batches, "text", 1 << 20):
        sets = batch.column("set").to_numpy()
        _, first = np.unique(sets, return_index=True)
        new = np.array([k for k in first if sets[k] not in seen], np.int64)
        seen.update(sets[new].tolist())
        batch = batch.take(pa.array(new))
        _, _, _, owner, held = _elements(hasher, batch, size, weighted)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
        yield pa.RecordBatch.from_arrays([batch.column("set"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(held.view(np.int64)))], names=["set", "elements"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (id, root): root is the smallest id that id is connected with. Only ids with an edge come up.

    Every id hangs on the smallest of its neighbours and itself; jumps that double in length shorten the ways up to one step, and the
    edges go on between the roots, until none is left. Stars take one turn, and each turn at least halves what is connected.
    """
    left = settle(edges.where("a <> b").select("a", "b").distinct(), few=True)
    found: DataFrame | None = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
        moved, last = True, None
        while moved:
            over = up.select(F.col("id").alias("of"), F.col("root").alias("next"))
            up = settle(up.join(over, up["root"] == over["of"]).select("id", "root", "next"), few=True)
            if last is not None:
                discard(last)
            last = up
            moved = up.where("next <> root").limit(1).count() > 0
            up = up.select("id", F.col("next").alias("root"))
        before, ended = found, left
        if found is None:
            found = up
        else:
            over = up.select(F.col("id").alias("of"), F.col("root").alias("next"))
            found = settle(found.join(over, found["root"] == over["of"], "left").select("id", F.coalesce("next", "root").alias("root")), few=True)
        one, other = up.select(F.col("id").alias("a"), F.col("root").alias("ra")), up.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        left = settle(left.join(one, "a").join(other, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), few=True)
        discard(ended)
        if before is not None:
            discard(last, *([before] if hasattr(before, "settled_at") else []))
    return found if found is not None else left.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b, ...) whose sets of elements are similar enough. An end b with many edges is dealt over tasks, its set copied to each."""
    loads = edges.groupBy("b").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("deals")).withColumnRenamed("b", "id")
    spread = edges.join(loads.withColumnRenamed("id", "b"), "b").withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int"))
    centres = sets.join(loads, sets["set"] == loads["id"]).select("id", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("elements").alias("of_b"))
    first = spread.join(centres, (spread["b"] == centres["id"]) & (spread["deal"] == centres["deal"])).select(*[spread[c] for c in edges.columns], "of_b")
    both = first.join(sets, first["a"] == sets["set"])
    common = F.size(F.array_intersect("elements", "of_b"))
    measured = both.select(*edges.columns, common.alias("common"), (F.size("elements") + F.size("of_b")).alias("total"))
    return measured.where(F.col("common") >= similarity * (F.col("total") - F.col("common")) - 1e-9).select(*edges.columns)


def _sized(small: Column, large: Column, similarity: float) -> Column:
    """Two sets of these sizes can be similar enough."""
    return F.least(small, large) >= similarity * F.greatest(small, large) - 1e-9


def _mixed(members: DataFrame, similarity: float) -> DataFrame:
    """members (set, size, reach, root, crowd, keys) that a member of another class in one of their buckets can be similar to, and the keys of those buckets.

    reach: the largest size that a partner can have. The smallest size and the largest reach of a bucket rule members out without pairs.
    """
    flat = members.withColumn("key", F.explode("keys"))
    bounds = flat.groupBy("key").agg(F.min("size").alias("least"), F.max("reach").alias("most"), F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other")
    left = flat.join(bounds, "key").where(F.col("least") <= F.col("reach") + 1e-9).where(F.col("most") + 1e-9 >= F.col("size"))
    return left.groupBy("set").agg(*[F.first(c).alias(c) for c in ("size", "reach", "root", "crowd")], F.collect_list("key").alias("keys"))  # a set has as many keys as bands at most


def classes(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, row, set, class_id, root): a row for each row of docs (doc_id, text).

    class_id is the smallest doc_id among all documents that links of the given similarity or more connect; row is the hash of doc_id and
    text, set that of the elements, root that of the class (both null if there are none). weighted: similarity is that of multisets, an
    element weighing as often as it occurs. Texts with the same elements are copies. Documents without words have no links: their class is
    their own doc_id. Null ids come up, but name a class only where no other id is there (then null). An empty table gives no rows.
    """
    given = docs.select("doc_id", row_key().alias("row"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = settle(given.mapInArrow(lambda it: _signed(it, size, bands, rows, weighted), f"doc_id {id_type}, row long, set long, size int, keys array<long>"))
    # one row for each set of elements: copies meet here, pre-aggregated
    unique = settle(signed.where("set is not null").groupBy("set").agg(F.min("row").alias("row"), F.min("size").alias("size"), F.first("keys").alias("keys")))
    posted = unique.select("set", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    # crowd: how many others a set meets, over all its buckets; in a family of copies that is greatest near what they were copied from
    crowded = posted.join(shared, "key").groupBy("set").agg(F.sum("members").alias("crowd"), F.collect_list("key").alias("keys"))
    open_ = settle(crowded.join(unique.select("set", "row", "size"), "set"))
    wanted = open_.select("row", "set")
    texts = given.join(wanted, "row").select("set", "text")
    sets = settle(texts.mapInArrow(lambda it: _sets(it, size, weighted), "set long, elements array<long>"))

    # every member meets the centre of each of its buckets
    flat = open_.select("set", "size", "crowd", F.explode("keys").alias("key"))
    centres = flat.groupBy("key").agg(F.max(F.struct("crowd", "set", "size")).alias("top"))
    met = flat.join(centres, "key").where(F.col("set") != F.col("top.set")).where(_sized(F.col("size"), F.col("top.size"), similarity))
    edges = settle(met.select(F.col("set").alias("a"), F.col("top.set").alias("b")).distinct(), few=True)
    links = settle(_verified(edges, sets, similarity), few=True)
    discard(edges)
    named = components(links)

    # buckets that still hold members of several classes
    found = open_.join(named, open_["set"] == named["id"], "left").select("set", "size", "crowd", "keys", F.coalesce("root", "set").alias("root"))
    members = settle(_mixed(found.withColumn("reach", F.col("size") / similarity), similarity), few=True)
    for _ in range(COUNTS):
        # an element that no other member has is shared with none: so many elements a set can have in common with another at most
        parts = sets.join(members.select(F.col("set").alias("of")), F.col("set") == F.col("of"), "left_semi").select("set", F.explode("elements").alias("element"))
        own = parts.groupBy("element").agg(F.count("*").alias("n"), F.min("set").alias("of")).where("n = 1").groupBy("of").agg(F.count("*").alias("own"))
        counted = members.join(own, members["set"] == own["of"], "left").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0)))
        # common >= similarity * (size + other size - common)
        fewer = settle(_mixed(counted.withColumn("reach", F.col("common") * (1 + similarity) / similarity - F.col("size")), similarity), few=True)
        discard(members)
        members = fewer
    flat = members.withColumn("key", F.explode("keys"))
    home = flat.groupBy("key").agg(F.max(F.struct("crowd", "set", "root")).alias("top")).select(F.col("key").alias("of"), F.col("top.root").alias("home"))
    placed = flat.join(home, flat["key"] == home["of"]).drop("of")
    stray, other = placed.where("root <> home").alias("s"), placed.alias("o")
    s, o = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"o.{c}"))
    able = (s("root") != o("root")) & ((o("root") == o("home")) | (s("set") < o("set"))) & _sized(s("size"), o("size"), similarity) & (s("size") <= o("reach") + 1e-9) & (o("size") <= s("reach") + 1e-9)
    once = F.array_min(F.array_intersect(s("keys"), o("keys"))) == s("key")  # a pair that shares several buckets is made in one of them
    pairs = settle(stray.join(other, (s("key") == o("key")) & able & once).select(s("set").alias("b"), o("set").alias("a"), s("root").alias("rb"), o("root").alias("ra")), few=True)
    more = settle(_verified(pairs, sets, similarity).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), few=True)
    discard(pairs, members, sets, open_)
    joined = components(more).withColumnRenamed("root", "into").withColumnRenamed("id", "was")
    roots = named.join(joined, named["root"] == joined["was"], "left").select("id", F.coalesce("into", "root").alias("root"))
    alone = joined.join(named, joined["was"] == named["id"], "left_anti").select(F.col("was").alias("id"), F.col("into").alias("root"))
    roots = roots.unionByName(alone).withColumnRenamed("id", "of")

    ids = signed.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least_id"))
    ids = settle(ids.join(roots, ids["set"] == roots["of"], "left").select("set", "least_id", F.coalesce("root", "set").alias("root")), few=True)
    discard(unique)
    found = ids.alias("i").join(ids.groupBy("root").agg(F.min("least_id").alias("class_id")).alias("c"), "root").select("set", "class_id", "root")
    out = signed.select("doc_id", "row", "set").join(found.withColumnRenamed("set", "of"), F.col("set") == F.col("of"), "left")
    return out.select("doc_id", "row", "set", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "root")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without all but one row of each class: that with the smallest doc_id (null last), then the smallest hash of id and text.

    Rows equal in doc_id and text are one document. Documents without words all stay. Columns stay as they are.
    """
    row, lone = spare(docs, "dedup_row", "dedup_lone")
    found = settle(classes(docs.select("doc_id", "text"), **how))
    first = found.where("set is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    stay = first.select(F.col("first.row").alias(row), F.lit(True).alias(lone))
    stay = stay.unionByName(found.where("set is null").select(F.col("row").alias(row), F.lit(False).alias(lone)).distinct())
    kept = docs.withColumn(row, row_key()).join(stay, row)
    twice = found.where("set is not null").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:  # of rows equal in doc_id and text one stays
        kept = kept.withColumn(lone, F.when(F.col(lone), F.lit(-1)).otherwise(F.monotonically_increasing_id())).dropDuplicates([row, lone])
    return kept.select(*docs.columns)
