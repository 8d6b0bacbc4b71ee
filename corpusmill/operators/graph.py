"""Connected components of an edge table, by alternating large and small stars.

Every round is two minimum aggregations (summed before the shuffle) and two
plain equi-joins that adaptive execution can split at a hub; no neighbour list
is ever gathered. Each round is checkpointed, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import checkpointed


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs.u == least.w).select("u", "v", "m")


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (src, dst), in any direction, repeats and loops allowed -> (node, component).

    component is the least node that can be reached; nodes with no edge to another one are not listed.
    """
    pairs = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = _to_least(large)
        small = stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).distinct()
        before, pairs = state, checkpointed(small)
        state = _state(pairs)
        if state == before:
            break
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
