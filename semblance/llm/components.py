"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.storage import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("hi", "lo")).alias("x"),
        F.sum(F.xxhash64("lo", "hi") % 1_000_003).alias("s"),
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, component)``, the smallest id reachable.

    Nodes without an edge to another node have no row. Each step hangs the neighbours of a node
    below its smallest neighbour: a partial minimum per node and an equi-join, which adaptive
    execution splits, so a hub of any size never meets in one task. The number of steps grows with
    the logarithm of the longest path. NULL ids and loops are ignored; repeated edges count once.
    """
    pairs = stored(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    known = _signature(pairs)
    while known[0]:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(
            F.col("v").alias("hi"), F.least("u", "m").alias("lo")
        )
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").select(
            F.explode(F.array(
                F.struct(F.col("hi"), F.col("m").alias("lo")),
                F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
            )).alias("e")
        ).select("e.*").filter("hi <> lo").distinct()
        pairs = stored(small, "stars")
        now = _signature(pairs)
        if now == known:
            break
        known = now
    nodes = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
