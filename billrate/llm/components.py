"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billrate.session import shuffled_if_large, stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node hands its neighbours to the least node it knows.

    The least neighbour is an aggregate and the hand-over a join, so a node with very many
    neighbours is never one group in one task.
    """
    sides = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(sides.groupBy("u").agg(F.min("v").alias("low")), "edge-least")
    low = F.least("u", "low")
    joined = sides.join(shuffled_if_large(least), "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), low.alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), low.alias("v")).unionByName(
            least.select("u", low.alias("v"))
        )
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (u, v): root is its component's least node.

    Each round is written to the shared folder, so no lineage grows and a lost executor
    costs one step.  Ends when a round changes nothing; the rounds grow with the logarithm
    of the longest chain.
    """
    now = stage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(),
        "edges",
    )
    state = _digest(now)
    while state[0]:
        now = stage(_stars(_stars(now, large=True), large=False), "edges")
        after = _digest(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    """Row count and two sums over hashes: equal for equal edge sets."""
    h = F.xxhash64("u", "v")
    row = edges.agg(
        F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x")
    ).first()
    return tuple(row)
