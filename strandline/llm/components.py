"""Connected components by repeated contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node reachable.

    Each round maps every node to the first of its neighbours and itself and joins
    the edges to that map; edges inside a node vanish. First is by number in even
    rounds, which ends stars at once, and by a hash of the round in odd rounds, which
    removes a share of the nodes of any chain, so rounds grow with the logarithm of
    its length. The maps shrink from round to round and are composed from the last
    one back. Both sides of each join are saved tables that Spark shuffles itself, so
    AQE can split a hub's partition. Null ends are no edge.
    """
    edges = saved(edges.where("a is not null and b is not null and a != b").select("a", "b").distinct(), "edges")
    maps = []
    while True:
        even = len(maps) % 2 == 0

        def rank(node: str, even: bool = even) -> Column:
            return F.struct((F.col(node) if even else F.xxhash64(F.lit(len(maps)), node)).alias("r"), F.col(node).alias("root"))

        both = edges.select("a", "b").union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("first"))
        maps.append(saved(first.select(F.col("a").alias("node"), F.least(rank("a"), "first")["root"].alias("root")), "hop"))
        heads, tails = maps[-1].toDF("a", "ta"), maps[-1].toDF("b", "tb")
        before = edges
        edges = before.join(heads, "a").join(tails, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = saved(edges.where("a != b").distinct(), "edges")
        dropped(before)
        if edges.isEmpty():
            break
    out = maps.pop()
    while maps:
        inner, out = maps.pop(), out.toDF("root", "_next")
        out = inner.join(out, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
        if len(maps) % 8 == 7:  # a plan of bounded depth
            out = saved(out, "composed")
    out = saved(out, "roots")
    return out.join(out.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
