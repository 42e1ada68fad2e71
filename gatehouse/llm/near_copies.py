"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Two such sets share one of the first shingles of both, in any one order: a set of n has at least 4/5 of n in common with the other, so the first n/5
   and one more are enough.  The order takes the most common shingles last.  Sets meet by equality on these shingles only.
2. Where sets meet, fingerprints of 128 bits are compared tile by tile and propose pairs.  By the angle of two sets, a pair at 0.8 differs in about 19
   bits (standard deviation 4); the radius is more than three deviations wider.
3. The components of the near fingerprints are candidate groups.  Inside a group sets are compared exactly; large groups
   are cut into parts, and every pair of parts is a unit of its own.  Only confirmed links make the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm.arrow import map_in_arrow, quoted, with_columns
from gatehouse.llm.components import components
from gatehouse.llm.forest import Forest
from gatehouse.llm.simhash import SEED
from gatehouse.llm.storage import stored

SHINGLE = 5
SIMILAR = 0.8
RADIUS = 34
# Of these bits, so many at most may lie in the first 64; it is compared first.
HALF = 22
TILE = 512
# Sets a shingle brings together in one unit; beyond, they are cut into parts.
PART = 1 << 15
# Units up to this size are compared many at a time, pair by pair.
SMALL = 24
# Sets a part of a candidate group holds.
GROUP_PART = 256
# The order of the shingles: about so many texts are looked at for the common ones, and so many of these are kept.  It decides how many sets meet in
# vain, never which pairs are found.
SAMPLE, COMMON = 20_000, 1 << 16


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, one without a word has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64, n))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bits(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


class Order(NamedTuple):
    """Common shingles, sorted, and the rank of each: the higher, the more common."""

    common: np.ndarray
    rank: np.ndarray

    def first(self, s: np.ndarray) -> np.ndarray:
        """The shingles of a set of which a similar set has one among its own: those that come first."""
        count = len(s) - int(np.ceil(SIMILAR * len(s) - 1e-9)) + 1
        if count >= len(s):
            return s
        place = _mixed(s) >> np.uint64(1)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
            known = self.common[at] == s
            place[known] = np.uint64(1 << 63) + self.rank[at[known]]
        return s[np.argpartition(place, count - 1)[:count]]


def print_of(text: str | None, order: Order) -> tuple[int, int, int, int, np.ndarray]:
    """``node`` (hash of the set), ``n`` (its size), the two halves of its fingerprint as signed numbers, and its first shingles."""
    s = shingle_set(text)
    node = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))
    return node, len(s), _bits(s), _bits(_mixed(s)), order.first(s).view(np.int64) if len(s) else s.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more, counted exactly."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b) or not len(a):
        return len(a) == len(b)
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def near_prints(side: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of near fingerprints: all pairs of side 0, or those across if there is a side 1.

    Tiles that lie in one tree already are skipped, so copies of one text cost little more than one comparison each.
    """
    order = np.argsort(n, kind="stable")
    lower = order[side[order] == 0]
    upper = order[side[order] == 1]
    across = len(upper) > 0
    upper = upper if across else lower
    trees = Forest(len(n))
    for i in range(0, len(lower), tile):
        a = lower[i:i + tile]
        for j in range(0 if across else i, len(upper), tile):
            b = upper[j:j + tile]
            if n[a[-1]] < SIMILAR * n[b[0]]:
                break
            if n[b[-1]] < SIMILAR * n[a[0]]:
                continue
            root = trees.root[a[0]]
            if (trees.root[a] == root).all() and (trees.root[b] == root).all():
                continue
            x, y = np.nonzero(np.bitwise_count(first[a][:, None] ^ first[b][None, :]) <= HALF)
            x, y = a[x], b[y]
            apart = trees.root[x] != trees.root[y]
            x, y = x[apart], y[apart]
            far = np.bitwise_count(first[x] ^ first[y]).astype(int) + np.bitwise_count(second[x] ^ second[y])
            near = (far <= RADIUS) & (np.minimum(n[x], n[y]) >= SIMILAR * np.maximum(n[x], n[y]))
            trees.join(x[near], y[near])
    return trees.links()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray | list]]:
    """Columns of one unit after another from batches sorted by their first column; a unit may go over the end of a batch."""
    held: list[pa.RecordBatch] = []

    def columns(parts: list) -> list:
        table = pa.Table.from_batches(parts)
        return [c.to_pylist() if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_numpy() for c in table.columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if held and held[-1].column(0)[0].as_py() != keys[0]:
            yield columns(held)
            held = []
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in pairwise(cuts):
            held.append(batch.slice(a, b - a))
            if b < len(keys):
                yield columns(held)
                held = []
    if held:
        yield columns(held)


def _links(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], names=["a", "b"])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of sets that share a shingle; most of them hold one set, so whole batches of units are looked through at once."""
    held: list[np.ndarray] | None = None

    def links(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        unit, side, nodes, n, first, second = c
        cuts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]])) if len(unit) else np.zeros(1, np.int64)
        sizes = np.diff(cuts)
        # Small units: every row with the one so many rows further on, if that is of the same unit.
        at = np.repeat(np.where((sizes > 1) & (sizes <= SMALL), cuts[1:], 0), sizes)
        x, y = [], []
        for step in range(1, SMALL):
            i = np.flatnonzero(np.arange(len(unit)) + step < at)
            if not len(i):
                break
            j = i + step
            near = np.bitwise_count(first[i] ^ first[j]) <= HALF
            i, j = i[near], j[near]
            far = np.bitwise_count(first[i] ^ first[j]).astype(int) + np.bitwise_count(second[i] ^ second[j])
            near = (far <= RADIUS) & (np.minimum(n[i], n[j]) >= SIMILAR * np.maximum(n[i], n[j]))
            x.append(i[near])
            y.append(j[near])
        if x:
            yield _links(nodes, np.concatenate(x), np.concatenate(y))
        for k in np.flatnonzero(sizes > SMALL):
            part = slice(cuts[k], cuts[k + 1])
            yield _links(nodes[part], *near_prints(side[part], n[part], first[part], second[part]))

    for batch in batches:
        if not batch.num_rows:
            continue
        c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        c[4:] = [x.view(np.uint64) for x in c[4:]]
        if held is not None:
            c = [np.concatenate(x) for x in zip(held, c)]
        done = int(np.searchsorted(c[0] == c[0][-1], True))  # the last unit may go on
        yield from links([x[:done] for x in c])
        held = [x[done:] for x in c]
    if held is not None:
        yield from links(held)


def join_similar(sets: list[np.ndarray], side: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of the components of similar sets, all pairs or, if there is a side 1, those across.  A set is compared with the members of a tree until one is
    similar, so a group of copies costs one comparison a set."""
    across, trees, x, y = bool((side == 1).any()), [], [], []
    for i in range(len(sets)):
        own, rest = [i], []
        for tree in trees:
            other = next((j for j in tree if (not across or side[i] != side[j]) and similar(sets[i], sets[j])), None)
            if other is None:
                rest.append(tree)
            else:
                x.append(i)
                y.append(other)
                own = tree + own
        trees = [*rest, own]
    return x, y


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, side, nodes, texts in _units(batches):
        x, y = join_similar([shingle_set(t) for t in texts], side)
        yield _links(nodes, np.array(x, np.int64), np.array(y, np.int64))


def _cut(rows: DataFrame, by: str, part: int, name: str) -> DataFrame:
    """Units of ``by``: with more than ``part`` nodes of one value, each pair of its parts is one.  Adds ``unit`` and ``side``."""
    # Written, so that its true size decides on the join.
    large = stored(rows.groupBy(by).count().where(F.col("count") > part).select(by, F.ceil(F.col("count") / part).cast("int").alias("parts")), name)
    own = rows.join(large, by, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return both.withColumn("unit", F.xxhash64(by, F.least("part", "other"), F.greatest("part", "other"))).withColumn("side", (F.col("part") > F.col("other")).cast("int"))


def candidates(sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between near fingerprints of ``node, n, first, second, shingles`` (one row a node) that share one of these shingles."""
    rows = sets.select(F.explode("shingles").alias("shingle"), "node", "n", "first", "second")
    units = _cut(rows, "shingle", PART, "common-shingles").select("unit", "side", "node", "n", "first", "second")
    return map_in_arrow(units.repartition("unit").sortWithinPartitions("unit"), _propose, "a long, b long").distinct()


def confirmed(texts: DataFrame) -> DataFrame:
    """Links ``a, b`` among ``node, root, text`` (one row a node): similar sets of one group ``root``."""
    units = _cut(texts, "root", GROUP_PART, "large-groups").select("unit", "side", "node", "text")
    return map_in_arrow(units.repartition("unit").sortWithinPartitions("unit"), _confirm, "a long, b long")


def order_of(docs: DataFrame, text: str, rows: int) -> Order:
    """An order of shingles, from a sample of the texts by hash."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["shingle"])

    drawn = docs.select(F.col(quoted(text)).cast("string").alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.lit(max(1, min(1 << 20, (SAMPLE << 20) // max(rows, 1)))))
    counts = map_in_arrow(drawn, distinct, "shingle long").groupBy("shingle").count().where("count > 2")
    top = counts.orderBy(F.col("count").desc(), "shingle").limit(COMMON).collect()
    found = np.array([r[0] for r in reversed(top)], np.int64).view(np.uint64)
    at = np.argsort(found)
    return Order(found[at], at.astype(np.uint64))


def near_copies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key and ``component_id``, the least key reachable over links, its own included.

    Equal keys must have equal texts.  Keys are not null (the stage names rows by a struct).  Texts without a word link to each other only.  Texts of any
    length are compared whole; an empty table gives an empty table.
    """
    order = docs.sparkSession.sparkContext.broadcast(order_of(docs, text, docs.count()))

    def make(texts: list) -> list:
        *numbers, first = zip(*[print_of(t, order.value) for t in texts])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32))
        return [*[pa.array(list(c), t) for c, t in zip(numbers, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(first)))]

    kinds = {"__node": T.LongType(), "__n": T.IntegerType(), "__first": T.LongType(), "__second": T.LongType(), "__shingles": T.ArrayType(T.LongType())}
    q = quoted(key)
    made = with_columns(docs, text, kinds, make, [key])
    prints = stored(made.select(F.col(q).alias("key"), *[F.col(c).alias(c[2:]) for c in kinds]), "near-prints")
    sets = stored(prints.groupBy("node").agg(F.min("key").alias("least"), *[F.first(c).alias(c) for c in ("n", "first", "second", "shingles")]), "near-sets")
    near = stored(components(candidates(sets.where("n > 0"))), "near-groups")
    asked = sets.select("node", "least").join(near, "node")
    texts = docs.select(F.col(q).alias("least"), F.col(quoted(text)).alias("text")).join(asked, "least").dropDuplicates(["node"])
    tree = components(confirmed(stored(texts.select("node", "root", "text"), "near-texts")))
    roots = sets.select("node", "least").join(tree, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # Written, so that the join can split a root that very many nodes have.
    names = stored(roots.groupBy("root").agg(F.min("least").alias("component_id")), "near-names")
    of = roots.join(names, "root").select("node", "component_id")
    return prints.select("key", "node").join(of, "node").select(F.col("key").alias(key), "component_id")
