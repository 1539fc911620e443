"""Connected components of a graph too large for one machine, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SALTS = 16


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) -> (u, v): each node that isn't its component's smallest, and that smallest node.

    Each round writes its edges, larger end first, to the shared folder; rounds grow as the logarithm of a component's size.
    Large star: the larger end of an edge goes to the smallest neighbour of its smaller end. A node with many edges is the
    smaller end of them, so that join is salted: `SALTS` tasks share the edges of such a node. Small star: all smaller
    neighbours of a node go to the smallest of them. Minima are partial aggregates. Loops and repeated edges are ignored; null
    ends are dropped (an edge needs two nodes).
    """
    now = common.table(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        up = now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = now.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
        large = salted.join(up, ["v", "salt"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = common.table(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = common.table(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        common.discard(now)
        common.discard(large)
        before, state, now = state, _state(new), new
        if state == before:
            break
    return now
