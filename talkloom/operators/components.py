"""Connected components by alternating star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.session import cut


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b) the least node of its component.

    Large-star and small-star steps in turn: every step links a node's neighbours to its least neighbour,
    which halves paths and keeps the number of edges. Minima are combined before the shuffle, so hubs cost
    no more than other nodes; each round is written to the shared folder. Self-loops, repeated edges and
    nulls do no harm; no edges give no rows. Steps go on until the edges stay as they are; where ``rounds`` bounds
    them, edges that still change then are an error.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    loops = e.where("a = b").select("a").distinct()
    e = cut(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for step in count():
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state or not now[0]:
            break
        if step == rounds:
            raise RuntimeError(f"components: edges still changed in round {rounds}")
        state = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        linked = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(linked.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    lone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found.unionByName(roots).unionByName(lone).groupBy("node").agg(F.min("component").alias("component"))
