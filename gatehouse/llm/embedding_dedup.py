"""Near-duplicates among embeddings: sign hashes of random hyperplanes, exact cosine, connected components.

1. Equal vectors of one label are one class from the start: copies never meet each other, however many there are.
2. Each class gets one code a table: the sides of ``bits`` random hyperplanes on which its vector lies.  Two vectors at an angle w agree in a
   bit with probability 1 - w / pi, so the number of tables follows from the cosine and the wanted recall (:func:`tables_for`).
3. Classes of one label with one code of one table are compared by their exact cosine in double precision.  A pair counts in the first table
   that it shares, so every link counts once.  A bucket that holds very many classes is cut into parts, and every pair of parts is a
   unit of its own; parts that an earlier table has compared as a whole are skipped.
4. Components come from large-star and small-star rounds over a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.arrow import map_in_arrow, quoted
from gatehouse.llm.components import components
from gatehouse.llm.forest import Forest
from gatehouse.llm.storage import stored

LINK = 0.98
# Expected share of the pairs at exactly the least cosine that meet in a table; closer pairs meet more often.
RECALL = 0.9999
# Rows of the largest label that a bucket of a table holds on average: the number of bits follows.
BUCKET = 64
LEAST_BITS = 6
# Classes that a part of a bucket holds; beyond, the bucket is cut into parts.
PART = 2048
TILE = 512
SEED = 42


def bits_for(rows: int) -> int:
    return max(LEAST_BITS, ceil(log2(max(rows, 1) / BUCKET)))


def tables_for(bits: int, least: float = LINK, recall: float = RECALL) -> int:
    """Tables after which a pair at cosine ``least`` has shared a code with probability ``recall``."""
    return ceil(log(1 - recall) / log1p(-((1 - acos(least) / pi) ** bits)))


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, fine), F.lit(False))


def unit_vectors(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their vectors at length one, in double precision."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        v = flat[starts[at][:, None] + np.arange(d)]
        v = v / np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        yield at, v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _codes(bits: int, tables: int):
    """Appends ``codes`` (one number a table) to batches whose last column is the vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits)
        for batch in batches:
            codes = np.zeros((batch.num_rows, tables), np.int64)
            for at, v in unit_vectors(batch.column(batch.num_columns - 1)) if batch.num_rows else ():
                planes = np.random.default_rng([SEED, v.shape[1]]).standard_normal((v.shape[1], tables * bits))
                codes[at] = ((v @ planes) > 0).reshape(len(v), tables, bits) @ weights
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    return run


def near_pairs(v: np.ndarray, codes: np.ndarray, side: np.ndarray, weight: np.ndarray, least: float, tile: int = TILE) -> tuple[np.ndarray, Forest]:
    """Links among vectors that share the last code, without those that share an earlier one: for each vector the summed weight of its partners,
    and the trees of the links.  With a side 1, only pairs across count."""
    order = np.lexsort(codes.T)
    across = bool(side.any())
    lower = order[side[order] == 0] if across else order
    upper = order[side[order] == 1] if across else order
    degree, trees = np.zeros(len(v)), Forest(len(v))
    earlier = codes[:, :-1]
    # Codes in which all vectors of a tile agree.
    cut = lambda rows: [(t := rows[i:i + tile], (earlier[t] == earlier[t[0]]).all(axis=0)) for i in range(0, len(rows), tile)]
    left = cut(lower)
    right = cut(upper) if across else left
    for i, (a, pure) in enumerate(left):
        for b, also in right if across else right[i:]:
            if (pure & also & (earlier[a[0]] == earlier[b[0]])).any():
                continue  # all these pairs met in one earlier table
            x, y = np.nonzero(v[a] @ v[b].T >= least)
            if not across and a is b:
                x, y = x[x < y], y[x < y]
            x, y = a[x], b[y]
            for t in range(earlier.shape[1]):
                fresh = earlier[x, t] != earlier[y, t]
                x, y = x[fresh], y[fresh]
            degree += np.bincount(x, weight[y], len(v)) + np.bincount(y, weight[x], len(v))
            trees.join(x, y)
    return degree.astype(np.int64), trees


_NODE = ["unnamed", "id", "hash"]
_LINKS = ", ".join([f"a_{c} {t}, b_{c} {t}" for c, t in zip(_NODE, ("boolean", "long", "long"))]) + ", n long"


def _compare(least: float):
    """Batches sorted by unit, label, length and table -> a row for each class with a link: its node, one of its component, weight of its partners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = lambda batch, i: tuple(batch.column(c)[i].as_py() for c in range(4))

        def links() -> pa.RecordBatch:
            unit = pa.Table.from_batches(held).combine_chunks()
            table, side, weight = (unit.column(c).to_numpy() for c in (3, 4, 5))
            lists = unit.column(9).chunk(0)
            codes = lists.flatten().to_numpy().reshape(len(lists), -1)[:, :int(table[0]) + 1]
            v = np.concatenate([v for _, v in unit_vectors(unit.column(10).chunk(0))])
            n, trees = near_pairs(v, codes, side, weight, least)
            at = np.flatnonzero(n)
            node = [unit.column(c).chunk(0) for c in (6, 7, 8)]
            ends = [c.take(pa.array(i)) for c in node for i in (at, trees.root[at])]
            return pa.RecordBatch.from_arrays([*ends, pa.array(n[at])], names=[f"c{i}" for i in range(7)])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            turns = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            cuts = [0, *turns.tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and key(held[-1], 0) != key(batch, a):
                    yield links()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield links()

    return run


def links(classes: DataFrame, least: float = LINK, part: int = PART) -> DataFrame:
    """Links of ``unnamed, id, hash, size, label, vector, codes`` (one row a class): two nodes and the weight of all partners of the first."""
    bucket = F.xxhash64("label", F.size("vector"), "t", "code")
    rows = classes.select("*", F.posexplode("codes").alias("t", "code")).withColumn("bucket", bucket).drop("code")
    # Buckets with more classes than a part holds, and into how many parts each is cut.  Written, so that its true size decides on the join.
    large = stored(rows.groupBy("bucket").count().where(F.col("count") > part).select("bucket", F.ceil(F.col("count") / part).cast("int").alias("parts")), "large-buckets")
    own = rows.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("hash", "id"), F.col("parts")).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    units = both.select(unit.alias("unit"), F.xxhash64("label").alias("kind"), F.size("vector").alias("length"), F.col("t").cast("int").alias("t"),
                        (F.col("part") > F.col("other")).cast("int").alias("side"), "size", *_NODE, "codes", "vector")
    return map_in_arrow(units.repartition("unit").sortWithinPartitions("unit", "kind", "length", "t"), _compare(least), _LINKS)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LINK, recall: float = RECALL, bits: int | None = None) -> DataFrame:
    """One row for each row of ``vectors``: the key, ``n_links`` (other rows linked directly), ``component_id`` (the least key reachable over
    links, its own included) and ``kept`` (whether the two are equal).

    Rows link if their labels are equal and not null and the cosine of their vectors is ``least`` or more; every link is checked exactly, and a
    pair at that cosine is found with probability ``recall``.  Rows without a label, and vectors that are null, empty, zero, or
    hold a null or non-finite component link with nothing, as do vectors of unlike length; such a row is its own component.  Equal keys are rows of
    their own.  A row with a null key counts as a partner, never names a component, and is not kept.  Other columns of ``vectors`` are ignored;
    an empty table gives an empty table.
    """
    v, of = F.col(quoted(vector)), F.col(quoted(label))
    sound = of.isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)
    # 96 bits of hash name a class.
    name = [F.when(sound, F.xxhash64(of, v)).alias("hash"), F.when(sound, F.hash(v, of)).alias("check")]
    rows = vectors.select(F.col(quoted(key)).cast("long").alias("id"), of.alias("label"), v.alias("vector"), *name)
    valid = rows.where(F.col("hash").isNotNull())
    # Buckets are those of one label: its size decides.  To the driver: one number.
    bits = bits or bits_for(valid.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    groups = valid.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("hash").alias("hash"), F.first("check").alias("check"))
    made = groups.select(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), "hash", "check", "size", "label", "vector")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields)
    classes = stored(map_in_arrow(made, _codes(bits, tables_for(bits, least, recall)), f"{fields}, codes array<bigint>"), "embedding-classes")
    found = stored(links(classes, least), "embedding-links")
    end = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in _NODE])
    # Nodes are ordered by their least key, so the root of a component names it.
    tree = components(found.select(end("a").alias("a"), end("b").alias("b")))
    degrees = found.groupBy(end("a").alias("node")).agg(F.sum("n").alias("n"))
    node = F.struct(*_NODE).alias("node")
    whole = classes.select("hash", "check", "size", node).join(degrees, "node", "left").join(tree, "node", "left")
    root = F.coalesce("root", "node")
    named = whole.select("hash", "check", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.when(~root["unnamed"], root["id"]).alias("component"))
    out = rows.select("id", "hash", "check").join(named, ["hash", "check"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
