"""Connected components of a graph given as edges, by alternating stars (large-star, small-star).

Every step is a grouped minimum with map-side combination and an equi-join, so neither a component nor a vertex's
neighbours are ever gathered in one task. Each round is cut through the shared checkpoint folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, few


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For vertices 0..n-1 and edges (left, right): each vertex's smallest reachable one."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        left, right, low, high = left[open_], right[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns (vertex, root) for every vertex of `edges` (columns a, b of one ordered type): root is the smallest reachable vertex.

    No edges give no rows; loops and repeated edges do no harm. Raises if `max_rounds` rounds were not enough.
    """
    edges = cut(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        kept = low.where("m < a").select("a", F.col("m").alias("b"))
        large = large.unionByName(kept).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(few(small.where("a != b").distinct(), before[0]))
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: not settled")
    return edges.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
