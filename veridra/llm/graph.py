"""Distributed union-find: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import SMALL, cut, let_go

#: Edges a partition: fewer would cost more files than bytes where a session has many partitions.
EDGES = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Columns node and root (the least node of the component) for every node with an edge.

    Each round hangs all larger neighbours of a node to the least node it sees (large star), then joins the
    smaller ones (small star). While the least neighbours of all nodes are few enough they are broadcast, so a hub's
    edges stay where they are; beyond that Spark's skew join splits them. Rounds grow with the logarithm of the longest path. The edges of each round are
    stored in the checkpoint folder, those of the round before deleted, so neither lineage, disk nor driver memory grows; more than max_rounds raise. Null ends, loops and repeated
    edges are ignored; an empty frame gives no rows.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stored, mark = cut(now), None
    for _ in range(max_rounds):
        new = stored.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if new["n"] == 0 or mark == (new["n"], new["x"]):
            break
        mark, parts = (new["n"], new["x"]), new["n"] // EDGES + 1
        now = stored.coalesce(parts)
        both = now.union(now.select(v, u))
        few = F.broadcast if 2 * new["n"] <= SMALL else lambda x: x  # there are no more nodes than ends of edges
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(v > u).join(few(least), "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(least), "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        last, stored = stored, cut(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        let_go(last)
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    pairs = stored.groupBy("u").agg(F.min("v").alias("v"))
    return pairs.select(u.alias("node"), v.alias("root")).union(pairs.select(v.alias("node"), v.alias("root")).distinct())
