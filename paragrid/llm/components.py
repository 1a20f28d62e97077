"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: two values, whatever the size."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) touches; the root is the component's least node.

    Each round is a fixed number of joins and sums over edges in the shared folder; the driver sees only a
    count and a checksum. A node with very many edges meets a single row in each join, and both sides are
    read from files, so that Spark can split its partition. Self-loops and repeated edges are allowed."""
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        discard(least)
        discard(now)
        smallest = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "smallest")
        rest = large.join(smallest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(rest.unionByName(smallest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        discard(large)
        discard(smallest)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
