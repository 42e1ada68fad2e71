"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm.storage import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Links every neighbour of a node to the least node of its neighbourhood."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # The node itself is re-linked along with its neighbours; `least` has one row a node, so a node with very many
    # neighbours is split by the skew handling of the join.
    moved = pairs.join(least, "a").select(F.col("b").alias("x"), F.col("m"), F.col("a"))
    if keep == "large":
        out = moved.where(F.col("x") > F.col("a")).select(F.col("m").alias("a"), F.col("x").alias("b"))
    else:
        out = moved.select(F.col("m").alias("a"), F.col("x").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link; ``root`` is the least node reachable.

    ``edges`` has two columns ``a, b`` of one orderable type; direction, repeats, self-links and nulls do not matter
    (a null end makes no link).  Alternates large-star and small-star steps, each written to the shared folder, until the links
    no longer change: a logarithmic number of rounds, and no component is ever gathered in one task.  An empty
    table gives an empty table.
    """
    def mark(df: DataFrame) -> tuple:
        # Order-free digest of the links: a bounded result, one row.
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    ordered = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(ordered, "links")
    before = mark(links)
    while before[0]:
        large = stored(_star(_both_ways(links), "large"), "links-large")
        # Small star: a node looks at its smaller neighbours only.
        links = stored(_star(large.select(F.col("b").alias("a"), F.col("a").alias("b")), "small"), "links-small")
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
