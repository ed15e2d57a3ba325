"""Connected components by alternating large-star and small-star steps; edges stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sized


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """A written table of node, root: the smallest node that each node of an edge (u, v: of any type with an order) is connected to.

    Each step replaces a node's links by links to its smallest neighbour. Minima are partial aggregates and written
    before they are joined, a row for each node: small ones are broadcast, and beyond that a hub's rows meet its one row
    in a join of its own stage, which Spark can split. Ends when a round changes nothing.
    """
    pairs = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = materialize(pairs(edges), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = pairs(both.filter("v > u").join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialize(large, "edges")
        discard(least)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(sized(low), "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, now = now, materialize(pairs(small), "edges")
        discard(before, large, low)
        if (new := _state(now)) == state:
            break
        state = new
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = materialize(out, "components")
    discard(now)
    return out
