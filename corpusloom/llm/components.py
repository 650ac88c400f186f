"""Connected components of links: of small local sets with NumPy, of a whole table with DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: the smallest node that each node reaches."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, low)
        np.minimum.at(new, rb, low)
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == root).all():
            break
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


class Forest:
    """Local components to which links are added in parts; root[i] is the smallest node that node i reaches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        apart = ra != rb
        if apart.any():
            self.root = local_roots(len(self.root), ra[apart], rb[apart])[self.root]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link to another node; root is the smallest node it reaches.

    Alternating large and small stars: each round ties every node's neighbours to
    their smallest one, until all trees are stars. The rounds are staged tables,
    so lineage stays short; a node with very many links is dealt over tasks,
    since minima are pre-aggregated and joins read two staged tables, which lets
    the engine split a large key.
    """
    edges = staged(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = _sign(edges)
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = staged(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        inner = large.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = staged(inner.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "small")
        for old in (edges, least, large, lowest):
            drop_staged(old)
        edges, was, seen = small, seen, _sign(small)
        if was == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first())
