"""Connected components of links between ids, by rounds of hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formproof.llm.common import written


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id that is reachable.

    Every round, large-star then small-star: ids hook to the smallest id of their
    neighbourhood, so stars grow until each component is one star about its
    smallest id. The smallest neighbour is an aggregate, so hubs of any degree
    combine on the map side; edges are written each round, without lineage. A
    component of n ids takes about log(n) rounds.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        grown = _large_star(edges)
        after = written(_small_star(grown), "links")
        if _same(edges, after):
            break
        edges = after
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("id"), "component").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each id hook to the smallest of the id and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each id, and the id, hook to the smallest of them."""
    down = edges.where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hooked = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _same(before: DataFrame, after: DataFrame) -> bool:
    def digest(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    return digest(before) == digest(after)
