"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; root is the smallest node it reaches.

    Alternates two steps until nothing changes. First each node's larger neighbours are tied to the
    smallest node it knows, then its smaller neighbours are. Both are an aggregate and a join, so a
    node with very many links is combined in each map task and its links may be split over tasks.
    Every round is checkpointed. No links: no rows.
    """
    edges = checkpointed(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    before = None
    while (now := _mark(edges)) != before:
        before = now
        edges = checkpointed(_tie_smaller(_tie_larger(edges)))
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _tie_larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _tie_smaller(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def local_roots(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For each of the nodes 0..nodes-1 the smallest node that it reaches over the links (a[i], b[i])."""
    root = np.arange(nodes)
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(up := root[root], root):
            root = up
