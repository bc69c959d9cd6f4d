"""Graphs as edge tables: components, neighbourhoods and short paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.scratch import shuffled, written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


#: Edges that one task can settle; more are contracted by rounds first.
SETTLED_AT_ONCE = 200_000


def _settled(group: pd.DataFrame) -> pd.DataFrame:
    """Roots of at most SETTLED_AT_ONCE edges, by union-find."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(group["a"], group["b"], strict=True):
        root.setdefault(a, a)
        root.setdefault(b, b)
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    ids = list(root)
    return pd.DataFrame({"id": ids, "to": [find(x) for x in ids]})


def components(edges: DataFrame, at_once: int = SETTLED_AT_ONCE, rounds: list[int] | None = None) -> DataFrame:
    """``id, component`` (the smallest id reached) of ``edges(a, b)``; nulls link nothing.

    While more than ``at_once`` edges are left, a round gives every vertex a random rank, points it at its neighbour of
    the least rank if that is less than its own, follows the pointers a few steps and contracts the edges along them.
    Ranks are drawn anew in each round, so at least a fixed share of the vertices goes in each on average, whatever the
    shape: the rounds grow with the logarithm of the vertices. Each round is a written table. The pointers
    of the rounds are then applied backwards, which reads every vertex once. ``rounds`` takes the edges left at
    the start of each round."""
    edges = written(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kind = edges.schema["a"].dataType.simpleString()
    left, maps = edges.where("a <> b"), []
    while (n := left.count()) > at_once:
        if rounds is not None:
            rounds.append(n)
        rank = lambda c, k=len(maps): F.struct(F.xxhash64(c, F.lit(k)), c)
        near = both_ways(left).groupBy(F.col("a").alias("id")).agg(F.min(rank(F.col("b"))).alias("least"))
        near = written(near.select("id", F.when(F.col("least") < rank(F.col("id")), F.col("least.b")).otherwise(F.col("id")).alias("to")))
        for _ in range(2):
            further = near.select(F.col("id").alias("mid"), F.col("to").alias("far"))
            near = written(near.join(shuffled(further), F.col("to") == F.col("mid")).select("id", F.col("far").alias("to")))
        maps.append(near)
        ends_a, ends_b = near.select(F.col("id").alias("a"), F.col("to").alias("la")), near.select(F.col("id").alias("b"), F.col("to").alias("lb"))
        moved = left.join(shuffled(ends_a), "a").join(shuffled(ends_b), "b").where("la <> lb")
        left = written(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    labels = written(left.coalesce(1).groupBy(F.lit(0).alias("one")).applyInPandas(_settled, f"id {kind}, to {kind}"))
    for near in reversed(maps):
        onward = labels.select(F.col("id").alias("to"), F.col("to").alias("end"))
        labels = written(near.join(shuffled(onward), "to", "left").select("id", F.coalesce("end", "to").alias("to")))
    alone = edges.where("a = b").select(F.col("a").alias("id")).join(shuffled(labels), "id", "left_anti")
    least = labels.groupBy("to").agg(F.min("id").alias("component"))
    return labels.join(shuffled(least), "to").select("id", "component").unionByName(alone.select("id", F.col("id").alias("component")))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """``node, depth``: the least number of steps from ``start(node)``, which is left out, up to ``hops``."""
    links = both_ways(edges).distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, hops + 1):
        step = frontier.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def shortest_paths(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """One shortest simple path from ``start(node)`` to each node within ``hops``, the first in the order of its nodes."""
    links = both_ways(edges).distinct()
    paths = start.select("node", F.array("node").alias("path"))
    out = paths.where("false")
    for _ in range(hops):
        paths = paths.join(links, F.col("node") == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.col("b").alias("node"), F.array_append("path", F.col("b")).alias("path"))
        paths = paths.groupBy("node").agg(F.min("path").alias("path")).join(out, "node", "left_anti")
        out = out.unionByName(paths)
    return out


def named_clusters(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``id, cluster, name``: single linkage of ``edges(a, b, distance)`` in which ``names(id, name)`` never mix.

    As if the edges were taken in order of distance (then a, b) and each joined its two clusters unless they bear different
    names. All of that need not be done in order. The nearest edge of a cluster without a name is taken for certain: up to
    its turn nothing joins the cluster, and it may join whatever the other side has become. So is every edge between two
    clusters of one name. Each round takes all of these at once, which leaves at most half of the clusters without a
    name that can still be joined, and drops edges between different names; so rounds grow with the logarithm of the vertices.
    Ids are any comparable values; a null or repeated edge, or one from an id to itself, changes nothing, and an id without
    an edge is its own cluster. The cluster is its smallest id. A null name is no name; of several names of one id the least counts."""
    left = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("ea"), F.greatest("a", "b").alias("eb"), "distance")
    # Read for the ids and for each round, but made once.
    left = written(left.groupBy("ea", "eb").agg(F.min("distance").alias("distance")).withColumns({"a": F.col("ea"), "b": F.col("eb")}))
    given = names.groupBy("id").agg(F.min("name").alias("name"))
    ids = left.select(F.col("ea").alias("id")).unionByName(left.select(F.col("eb").alias("id"))).unionByName(given.select("id")).distinct()
    labels = written(ids.join(given, "id", "left").select("id", F.col("id").alias("cluster"), "name"))
    called = labels.select("cluster", "name")
    place = F.struct("distance", "ea", "eb")
    while True:
        a, b = (called.select(F.col("cluster").alias(c), F.col("name").alias(f"name_{c}")) for c in "ab")
        left = left.join(a, "a").join(b, "b").where("name_a is null or name_b is null or name_a = name_b")
        # Of the edges between two clusters only the nearest can be taken.
        left = written(left.groupBy("a", "b", "name_a", "name_b").agg(F.min(place).alias("e")).select("a", "b", "name_a", "name_b", "e.*"))
        if left.isEmpty():
            return labels.join(labels.groupBy("cluster").agg(F.min("id").alias("least")), "cluster").select("id", F.col("least").alias("cluster"), "name")
        free = left.where("name_a is null").select(F.col("a").alias("of"), "a", "b", place.alias("e")).unionByName(left.where("name_b is null").select(F.col("b").alias("of"), "a", "b", place.alias("e")))
        taken = free.groupBy("of").agg(F.min_by(F.struct("a", "b"), "e").alias("t")).select("t.*").unionByName(left.where("name_a = name_b").select("a", "b"))
        joined = components(taken).select(F.col("id").alias("cluster"), "component")
        labels = labels.join(joined, "cluster", "left").withColumn("cluster", F.coalesce("component", "cluster")).drop("component")
        labels = written(labels.select("id", "cluster", F.min("name").over(W.partitionBy("cluster")).alias("name")))
        called = labels.groupBy("cluster").agg(F.min("name").alias("name"))
        at = lambda c: joined.select(F.col("cluster").alias(c), F.col("component").alias(f"to_{c}"))  # noqa: E731, B023
        moved = left.select("a", "b", "ea", "eb", "distance").join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"), "ea", "eb", "distance")
        left = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ea", "eb", "distance")
