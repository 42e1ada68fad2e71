"""Hard negatives by exact integer scores: a matrix product in a residue number system, then selection in a window of scores.

Components are whole numbers.  Their residues modulo a few small primes are multiplied as float32 matrices, in which every sum stays below
2^24 and is exact; the signed score follows from its residues by Chinese remaindering.  How many primes a product takes follows from the
lengths of its vectors, so an outlier costs its own block only.

Anchors and rows meet in a grid of units: anchors are dealt to groups, rows to slices, and each unit scores one slice against one
group while it streams.  The first pass finds the positives of each anchor, the second the negatives in the window of each positive; a unit
emits its first few of either only, which one more window merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatehouse.llm.arrow import map_in_arrow, quoted
from gatehouse.llm.embedding_dedup import finite
from gatehouse.llm.storage import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# A negative's score in percent of the positive's.
LOW, HIGH = 30, 90
# Anchors of one group; rows of one slice at most, and units for each core at least.
GROUP = 2048
SLICE = 1 << 16
UNITS_A_CORE = 4
# Scores held at once.
CELLS = 1 << 20
_EXACT = 1 << 24
_PRIMES = [p for p in range(2047, 2, -2) if all(p % q for q in range(3, int(sqrt(p)) + 1, 2))]
# Stands for a missing key, which comes last among equal scores.
NO_KEY = np.iinfo(np.int64).max


def _centred(t: np.ndarray, p: int) -> np.ndarray:
    return t - p * np.rint(t / p)


def _bits(v: np.ndarray) -> float:
    """Binary logarithm of the length of the longest row."""
    top = np.abs(v).max(axis=1, keepdims=True, initial=1.0)
    return float((np.log2(top[:, 0]) + 0.5 * np.log2(np.maximum(((v / top) ** 2).sum(axis=1), 1.0))).max(initial=0.0))


def primes_for(bits: float, length: int) -> tuple[list[int], int]:
    """Primes whose product exceeds 2^bits, and how many components one float32 product may sum up exactly with them."""
    for run in (min(max(length, 1), 1024), 64, 16):
        fits = [p for p in _PRIMES if run * ((p - 1) // 2) ** 2 < _EXACT]
        total = 0.0
        for k, p in enumerate(fits):
            total += log2(p)
            if total > bits:
                return fits[:k + 1], run
    raise OverflowError("components beyond double precision")


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and of ``b``, whole numbers as doubles; those beyond 64 bits become the last number there is."""
    bits = _bits(a) + _bits(b) + 1.01  # a sign, and the rounding of the logarithms
    primes, run = primes_for(bits, a.shape[1])
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        left, right = (_centred(np.fmod(m, p), p).astype(np.float32) for m in (a, b))
        s = sum((left[:, i:i + run] @ right[:, i:i + run].T).astype(np.float64) for i in range(0, a.shape[1], run))
        s = _centred(s, p)
        # Digits in the mixed radix of the primes so far: take their value off, divide by their product.
        value, radix = 0, 1
        for q, digit in zip(primes, digits):
            value = _centred(value + digit * (radix % p), p)
            radix = radix * q % p
        digits.append(_centred((s - value) * pow(radix, -1, p), p) if k else s)
    if bits < 62:
        out, radix = np.zeros(digits[0].shape, np.int64), 1
        for p, digit in zip(primes, digits):
            out += digit.astype(np.int64) * radix
            radix *= p
        return out
    total = sum(digit.astype(np.int64).astype(object) * prod(primes[:k]) for k, digit in enumerate(digits))
    return np.clip(total, -NO_KEY, NO_KEY).astype(np.int64)


class First:
    """The first ``k`` entries of each line by score, highest first, then key; entries of one line that agree in both count once."""

    def __init__(self, lines: int, k: int) -> None:
        self.k = k
        self.least = np.full(lines, -NO_KEY - 1)  # a lower score cannot enter a full line
        self.line, self.score, self.key = (np.empty(0, np.int64) for _ in range(3))

    def add(self, line: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(line):
            return
        line, score, key = (np.concatenate(x) for x in ((self.line, line), (self.score, score), (self.key, key)))
        order = np.lexsort((key, ~score, line))
        line, score, key = line[order], score[order], key[order]
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (score[1:] != score[:-1]) | (key[1:] != key[:-1])])
        line, score, key = line[new], score[new], key[new]
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        last = rank == self.k - 1
        self.least[line[last]] = score[last]
        keep = rank < self.k
        self.line, self.score, self.key = line[keep], score[keep], key[keep]


def window(positive: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score from ``low`` to ``high`` percent of a score, without overflow."""
    a, b = positive // 100, positive % 100
    return low * a + -(-low * b // 100), high * a + high * b // 100


class _Unit:
    """One group of anchors, and what a slice of rows has for it so far."""

    def __init__(self, anchors: pa.Table, k: int, low: int, high: int) -> None:
        self.key = anchors.column(2).to_numpy()
        self.mark = anchors.column(3).combine_chunks()
        self.label = anchors.column(4).to_numpy()
        self.parts = list(_by_length(anchors.column(5).combine_chunks()))
        scores = anchors.column(6).to_pylist()
        self.windows = max((len(s) for s in scores if s is not None), default=0)
        self.first = First(len(self.key) * max(self.windows, 1), k)
        self.ranges = []
        for w in range(self.windows):
            have = np.array([len(s or ()) > w for s in scores])
            lo, hi = window(np.array([s[w] if h else 0 for s, h in zip(scores, have)], np.int64), low, high)
            self.ranges.append((np.where(have, lo, 1), np.where(have, hi, 0)))

    def add(self, rows: pa.RecordBatch) -> None:
        keys, labels = rows.column(2).fill_null(NO_KEY).to_numpy(zero_copy_only=False), rows.column(4).to_numpy()
        for at, v in _by_length(rows.column(5)):
            for of, anchors in self.parts:
                if anchors.shape[1] != v.shape[1]:
                    continue
                step = max(32, CELLS // len(of))
                for i in range(0, len(at), step):
                    self._take(of, keys[at[i:i + step]], labels[at[i:i + step]], inner_products(anchors, v[i:i + step]))

    def _take(self, of: np.ndarray, keys: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        same = self.label[of][:, None] == labels[None, :]
        if not self.windows:  # the first pass
            self._enter(of, keys, scores, same & (self.key[of][:, None] != keys[None, :]), 1, 0)
        for w, ends in enumerate(self.ranges):
            lo, hi = (x[of][:, None] for x in ends)
            self._enter(of, keys, scores, ~same & (scores >= lo) & (scores <= hi), self.windows, w)

    def _enter(self, of: np.ndarray, keys: np.ndarray, scores: np.ndarray, mask: np.ndarray, lines: int, w: int) -> None:
        x, y = np.nonzero(mask & (scores >= self.first.least[of * lines + w][:, None]))
        self.first.add(of[x] * lines + w, scores[x, y], keys[y])

    def result(self) -> pa.RecordBatch:
        f, lines = self.first, max(self.windows, 1)
        at = f.line // lines
        key = pa.array(f.key, mask=f.key == NO_KEY)
        return pa.RecordBatch.from_arrays([pa.array(self.key[at]), self.mark.take(pa.array(at)), pa.array((f.line % lines).astype(np.int32)), pa.array(f.score), key],
                                          names=["anchor", "mark", "w", "score", "key"])


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their components as whole numbers in double precision."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def _select(k: int, low: int, high: int):
    """Batches of ``unit, kind, ...`` sorted so that the anchors of a unit come before its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, unit = None, [], None

        def begun() -> _Unit:
            return unit or _Unit(pa.Table.from_batches(held), k, low, high)

        for batch in batches:
            units, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turns = np.flatnonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            cuts = [0, *turns.tolist(), len(units)] if len(units) else []
            for a, b in zip(cuts, cuts[1:]):
                if units[a] != name:
                    if unit:
                        yield unit.result()
                    name, held, unit = units[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(part)
                elif held:
                    unit = begun()
                    unit.add(part)
        if unit:
            yield unit.result()

    return run


def _scored(rows: DataFrame, anchors: DataFrame, groups: int, slices: int, k: int, low: int, high: int) -> DataFrame:
    """``anchor, mark, w, score, key``: of every unit, the first ``k`` candidates of each anchor, or of each of its windows."""
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    deal = lambda n: F.pmod(F.xxhash64("key", "mark"), F.lit(n)).cast("long")
    fixed = ["key", "mark", "label", "vector"]
    left = anchors.select(deal(groups).alias("g"), spread(slices).alias("s"), F.lit(0).alias("kind"), *fixed, "scores")
    right = rows.select(spread(groups).alias("g"), deal(slices).alias("s"), F.lit(1).alias("kind"), *fixed, F.lit(None).cast("array<long>").alias("scores"))
    units = left.unionByName(right).select((F.col("g") * slices + F.col("s")).alias("unit"), "kind", *fixed, "scores")
    laid = units.repartition("unit").sortWithinPartitions("unit", "kind")
    return map_in_arrow(laid, _select(k, low, high), "anchor long, mark long, w int, score long, key long")


def hard_negatives(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor and positive the first negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``, scores are exact inner products, higher ones come first, ties by the smaller key.  Positives are the
    first ``positives`` other rows of the anchor's label; negatives the first ``negatives`` rows of another label whose score is
    ``low`` to ``high`` percent of the positive's, found over all rows.  Rows without a label, and vectors that are null, empty, or hold a null or
    non-finite component take no part.  Vectors of another length than the anchor's are no candidates.  Of repeated rows one counts: candidates of
    an anchor that agree in key and score are one, and a row with the anchor's key is the anchor.  A null key is no anchor; it is a candidate, last
    among ties.  Scores beyond 64 bits become the largest number there is.  An empty table, or one without anchors, gives an empty table.
    """
    v = F.col(quoted(vector))
    scaled = F.transform(v, lambda x: F.lit(float(scale)) * x.cast("double"))
    rows = vectors.where(F.col(quoted(label)).isNotNull() & finite(v)).select(
        F.col(quoted(key)).cast("long").alias("key"), F.xxhash64(F.col(quoted(label))).alias("label"), scaled.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = rows.where(finite(F.col("vector"))).withColumn("mark", F.xxhash64("label", "vector"))
    asked = rows.where(F.col("asks") & F.col("key").isNotNull()).dropDuplicates(["key", "mark"]).drop("asks")
    anchors = stored(asked, "anchors")
    n, asking = rows.count(), anchors.count()
    groups = max(1, ceil(asking / GROUP))
    slices = max(1, ceil(n / SLICE), ceil(UNITS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism / groups))
    none = F.lit(None).cast("array<long>").alias("scores")
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    best = _scored(rows, anchors.select("*", none), groups, slices, positives, low, high)
    # Entries that agree have one rank.
    rank = F.dense_rank().over(Window.partitionBy("anchor", "mark").orderBy(*order))
    liked = stored(best.withColumn("w", rank - 1).where(F.col("w") < positives).dropDuplicates(["anchor", "mark", "w"]), "positives")
    ranges = liked.groupBy(F.col("anchor").alias("key"), "mark").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "score"))), lambda x: x["score"]).alias("scores"))
    found = _scored(rows, anchors.join(ranges, ["key", "mark"]), groups, slices, negatives, low, high)
    place = F.dense_rank().over(Window.partitionBy("anchor", "mark", "w").orderBy(*order))
    hard = found.withColumn("rank", place).where(F.col("rank") <= negatives).dropDuplicates(["anchor", "mark", "w", "rank"])
    ends = liked.select("anchor", "mark", "w", F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(ends, ["anchor", "mark", "w"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
