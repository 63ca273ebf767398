"""Connected components of an edge table, by alternating star contractions; nothing but counts reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for nodes 0 .. n-1 and edges a-b within one task."""
    label = np.arange(n)
    while len(a):
        # Only roots are moved: a node that left its tree alone would lose the ties of the rest.
        ra, rb = label[a], label[b]
        low = np.minimum(ra, rb)
        np.minimum.at(label, ra, low)
        np.minimum.at(label, rb, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or tied to one root only; one aggregation tells."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.node", "e.up")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).where("ups > 1 or (ups = 1 and root = 0)").isEmpty()


def _star(stash: Stash, name: str, both: DataFrame, tell: str) -> DataFrame:
    """Each node with its smallest neighbour (least), joined to its edges. The minima are a table of their own, so that both
    sides of the join are plain exchanges and a hub's rows can be split among tasks."""
    least = stash.save(both.groupBy("u").agg(F.min("v").alias("least")), f"{name}-{tell}-least")
    return both.join(least, "u")


def connected_components(edges: DataFrame, stash: Stash, name: str = "components") -> DataFrame:
    """edges (u, v) of numbers, any direction, repeated or not -> node, component (the smallest node that it reaches).
    Nodes without an edge to another node are absent."""
    tidy = lambda df: df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stash.save(tidy(edges), f"{name}-0")
    k = 0
    while not _is_stars(now):
        k += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Every larger neighbour is tied to the smallest of the neighbourhood.
        large = _star(stash, f"{name}-{k}", both, "large").where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        middle = stash.save(tidy(large), f"{name}-{k}-large")
        # Every node and its smaller neighbours are tied to the smallest of these.
        stars = _star(stash, f"{name}-{k}", middle, "small")
        small = stars.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
        now = stash.save(tidy(small), f"{name}-{k}")
        stash.drop(f"{name}-{k}-large", f"{name}-{k}-large-least", f"{name}-{k}-small-least", f"{name}-{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
