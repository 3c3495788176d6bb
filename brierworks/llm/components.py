"""Connected components of a link table, with Spark joins only."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from brierworks.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _smallest(links: DataFrame) -> DataFrame:
    """Links with the smallest partner of their ``u`` (or ``u`` itself where that is smaller)."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the component's smallest node) for each node with a link.

    ``links`` has long columns ``a`` and ``b``; repeats, both directions and self links are fine, rows with a null are
    ignored. Alternates large-star and small-star steps until nothing changes; the number of rounds grows with the
    logarithm of the longest path. A hub is a crowded join key, which adaptive execution splits, and is pre-aggregated
    in the grouping. Raises if ``rounds`` do not suffice.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _smallest(large)
        small = near.select("u", F.col("m").alias("v")).unionByName(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the pairs; ``parent`` continues an earlier call."""
    parent = np.arange(n) if parent is None else parent
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
