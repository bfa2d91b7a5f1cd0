"""Connected components by alternating large and small stars, on tables of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antecede.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties neighbours to the smallest of each node's neighbourhood: the larger ones, or the smaller ones and the node.

    The smallest neighbours are a table of their own, so Spark can split the join at a node with very many edges.
    """
    pairs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    low = materialize(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    tied = pairs.where(F.col("b") > F.col("a")) if large else pairs
    new = tied.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        new = new.union(low.select("a", F.col("m").alias("b")))
    return materialize(new.where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b, whole numbers); loops and repeats do no harm."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = _star(_star(edges, large=True), large=False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def spread(hits: np.ndarray, asked: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest row of the connected piece that each asked and each base row is in."""
    big = np.iinfo(np.int64).max
    a, b = asked.copy(), base.copy()
    while True:
        new_b = np.minimum(b, np.where(hits, a[:, None], big).min(axis=0, initial=big))
        new_a = np.minimum(a, np.where(hits, new_b[None], big).min(axis=1, initial=big))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def merge(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``tree``, the smallest node of each node's piece, after ``a`` and ``b`` were tied, pair by pair."""
    while (apart := tree[a] != tree[b]).any():
        a, b = a[apart], b[apart]
        tree = tree.copy()
        np.minimum.at(tree, np.maximum(tree[a], tree[b]), np.minimum(tree[a], tree[b]))
        while ((up := tree[tree]) != tree).any():
            tree = up
    return tree
