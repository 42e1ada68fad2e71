"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by tiled exact comparison.

Two texts link if their fingerprints differ in at most ``radius`` bits.  The comparison is exact: pairs are laid out in
tiles, a tile pair is compared with numpy exclusive-or and bit counts, and tile pairs whose population counts lie further apart than
the radius are skipped (two words that differ in r bits differ by at most r in their population counts).

To keep tiles of one task bounded and the number of tile pairs in proportion, fingerprints meet only where they can link: of
``radius + 1`` blocks of bits, at least one is equal in any two fingerprints within the radius.  A block value that very many
fingerprints share is cut into sub-blocks, and every pair of sub-blocks is one unit of work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm.arrow import map_in_arrow, quoted, with_columns
from gatehouse.llm.components import components
from gatehouse.llm.forest import Forest
from gatehouse.llm.storage import stored

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 1024
# Fingerprints of one block value that one unit of work holds; beyond, the value is cut into sub-blocks.
UNIT = 16384
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the whole text; 0 for null and for texts without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _SLICE):
        part = hashes[i:i + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``simhash`` (the 64 bits as a signed long)."""
    def make(texts: list) -> list:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64), pa.int64())]

    return with_columns(docs, text, {"simhash": T.LongType()}, make, keep)


def near_links(values: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the links among distinct fingerprints: every link lies inside a tree.

    Sorted by population count and cut into tiles; a pair of tiles is compared as a whole or skipped.
    """
    pops = np.bitwise_count(values).astype(np.int16)
    order = np.argsort(pops, kind="stable")
    v, p = values[order], pops[order]
    trees = Forest(len(v))
    for i in range(0, len(v), tile):
        a = v[i:i + tile]
        top = p[min(i + tile, len(v)) - 1]
        for j in range(i, len(v), tile):
            if p[j] - top > radius:
                break
            b = v[j:j + tile]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if i == j:
                x, y = x[x < y], y[x < y]
            trees.join(x + i, y + j)
    x, y = trees.links()
    return order[x], order[y]


def _compare(radius: int, tile: int):
    """Batches of ``unit, value`` sorted by unit -> links ``a, b``; a unit may go over the end of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            a, b = [], []
            for group in np.split(values, cuts) if len(keys) else []:
                if len(group) > 1:
                    x, y = near_links(group.view(np.uint64), radius, tile)
                    a.append(group[x])
                    b.append(group[y])
            join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(join(a)), pa.array(join(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False)])
            done = int(np.searchsorted(keys == keys[-1], True))  # the last unit may go on
            if done:
                yield links(keys[:done], values[:done])
                keys, values = keys[done:], values[done:]
        yield links(keys, values)

    return run


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, unit: int = UNIT) -> DataFrame:
    """Links ``a, b`` between distinct values of the column ``simhash``; their components are those of all links."""
    width = 64 // (radius + 1)
    extra = 64 - width * (radius + 1)
    sizes = [width + (k < extra) for k in range(radius + 1)]
    blocks, at = [], 0
    for k, w in enumerate(sizes):
        value = F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << w) - 1))
        blocks.append((value * (radius + 1) + k))
        at += w
    rows = prints.select("simhash", F.explode(F.array(*blocks)).alias("block"))
    # Block values with more fingerprints than a unit holds, and into how many sub-blocks each is cut.
    large = rows.groupBy("block").count().where(F.col("count") > unit).select("block", F.ceil(F.col("count") / unit).cast("int").alias("parts"))
    cut = rows.join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int")
    pairs = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    name = F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other"))
    # Equal names of two different units would only add comparisons, never lose one.
    units = pairs.select(name.alias("unit"), F.col("simhash").alias("value")).distinct()
    return map_in_arrow(units.repartition("unit").sortWithinPartitions("unit"), _compare(radius, tile), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: the key, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the least key reachable over links, the row's own included.  Texts are compared in whole; null
    and empty texts have fingerprint zero and link like any other.  Repeated rows stay repeated; a row with a null
    key gets the component of its fingerprint and never names it (a component of null keys only has a null name).
    """
    prints = stored(fingerprints(docs, text, shingle, [key]), "simhash")
    q = quoted(key)
    least = stored(prints.groupBy("simhash").agg(F.min(q).alias("least")), "simhash-least")
    tree = components(link_fingerprints(least.select("simhash"), radius))
    roots = least.join(tree, least["simhash"] == tree["node"], "left").select("simhash", "least", F.coalesce("root", "simhash").alias("root"))
    # Written, so that the join can split a root that very many fingerprints have.
    names = stored(roots.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    of = roots.join(names, "root").select("simhash", "component_id")
    return prints.join(of, "simhash").select(F.col(q), F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")
