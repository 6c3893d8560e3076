"""Connected components of an edge table, without gathering edges anywhere.

Large-star and small-star steps alternate (Kiveris et al., "Connected Components in MapReduce and Beyond"): every step
hangs a vertex's larger neighbours on the smallest vertex it knows. Each round is two aggregations whose hot vertices are
pre-aggregated, and is written to the shared folder, so lineage stays short. A task's own edges are first reduced to a
spanning forest, which keeps a vertex with very many edges from being dealt whole to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FLUSH = 2_000_000
MAX_ROUNDS = 60


class DisjointSets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def unite(self, x: int, y: int) -> bool:
        """True if they were apart."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the edges connect: every vertex that isn't the least of its component, and that least vertex."""
    if not len(a):
        return a, b
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:  # labels are positions in sorted order, so minima stay minima
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(before, root):
            break
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pdf in batches:
        held.append((pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)))
        size += len(pdf)
        if size > FLUSH:
            held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
            if len(held[0][0]) > FLUSH // 2:
                yield pd.DataFrame({"a": held[0][0], "b": held[0][1]})
                held = []
            size = len(held[0][0]) if held else 0
    if held:
        a, b = forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pd.DataFrame({"a": a, "b": b})


def local_forest(edges: DataFrame) -> DataFrame:
    """Spanning stars of each task's edges ``a, b`` (longs)."""
    return edges.select("a", "b").mapInPandas(_forests, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """From edges ``a, b`` (longs, no nulls) to ``vertex, component``: the least vertex reachable, for every vertex with an edge to another."""
    stars = materialize(local_forest(edges.filter("a <> b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a vertex hang on the least of its neighbourhood
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a vertex and its smaller neighbours hang on the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        after = materialize(small.filter("a <> b").distinct(), "edges")
        # done when the edges are stars: every vertex hangs on one root, and no root hangs on another
        open_ = after.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        stars = after
        if not open_:
            return stars.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    raise RuntimeError("components did not settle")
