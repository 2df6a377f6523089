"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Edges that fit one task by count (``ONE_TASK`` rows, a fixed bound) are solved there by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..durable import Scratch

#: So many edges, 16 bytes each, are left to a single task; more take rounds over all tasks.
ONE_TASK = 200_000


def _union_find(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pdfs = list(pdfs)
    if not pdfs:
        return
    edges = pd.concat(pdfs)
    nodes, at = np.unique(edges[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(u: int) -> int:
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        return u

    for u, v in at.reshape(-1, 2).tolist():
        u, v = root(u), root(v)
        parent[max(u, v)] = min(u, v)
    yield pd.DataFrame({"node": nodes, "component": nodes[[root(u) for u in range(len(nodes))]]})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = low.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node on an edge (a, b); the component is its smallest node.

    Self-loops and repeated edges are harmless; without edges the result is empty.  Each round is
    written to the shared folder, and the loop stops when a round leaves the edges unchanged.
    """
    current = scratch.save(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                           .where("a <> b").distinct(), f"{name}-0", release=False)
    if current.count() <= one_task:
        return scratch.save(current.coalesce(1).mapInPandas(_union_find, "node long, component long"), name, release=False)
    seen, k = None, 0
    while True:
        k += 1
        following = scratch.save(_small_star(_large_star(current)), f"{name}-{k}", release=False)
        mark = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        current = following
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.distinct())
