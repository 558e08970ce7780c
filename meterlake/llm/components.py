"""Connected components of a graph of links, by alternating large and small stars on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def components(links: DataFrame) -> DataFrame:
    """(u, component): the smallest vertex that each vertex of ``links`` (u, v) reaches.

    Vertices without links do not appear. Each round halves distances to the smallest vertex, and
    its minima are partial aggregates, so a vertex of very many links costs a row per task.
    """
    edges = cut(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count("*").alias("__rows")))
        # large star: neighbours above a vertex go to its smallest neighbour
        far = edges.select(F.col("v").alias("u"), F.col("u").alias("far"))
        large = spread_join(far, least, ["u"], "__rows", ["far"]).select(F.col("far").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: neighbours below a vertex, and itself, go to its smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
    roots = edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return edges.select("u", F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour at most, and those that others have as theirs have none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def spanning(u: list[int], v: list[int], size: int, label: np.ndarray) -> list[int]:
    """Local union-find on vertices below ``size``: the edges of a spanning forest of (u, v).

    ``label`` holds the tree of each vertex, by one of its vertices, and is brought up to date.
    """
    parent = label.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(u, v, strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    label[:] = [root(x) for x in range(size)]
    return kept
