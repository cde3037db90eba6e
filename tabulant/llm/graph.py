"""Connected components of a table of links, and the local forests that keep such tables short."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def local_forest(n: int, pairs) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' component under ``pairs``: an iterable of index arrays (u, v).

    Chunks of pairs are folded in one after the other, so all pairs need never
    be held at once.
    """
    root = np.arange(n)
    for u, v in pairs:
        while len(u):
            a, b = root[u], root[v]
            differ = a != b
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:  # point every node at its root
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(``node``, ``component``): the smallest node reachable, for every node of the links (``a``, ``b``), longs.

    Large-star and small-star rounds in turn until the links no longer change:
    each round hooks a node's neighbours to the smallest of them, with a
    map-side minimum and an equi-join, so no neighbourhood is ever gathered in
    one place.  Every round is written to the shared folder, which cuts the
    lineage.  Links with a NULL end are left out.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, seen = stage(edges.distinct(), name), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        # Large star: every larger neighbour of u is hooked to the smallest node around u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are hooked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
