"""Cut vertices of the undirected call graph of an event.

Graphs that fit one task by count (``ONE_TASK`` edges, a fixed bound) are searched there, many events
to a task.  Larger ones take rounds over all tasks, as many as the logarithm of their size: a spanning
forest, its Euler tour and the blocks (``blocks.py``); a node between blocks cuts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..durable import Scratch
from . import blocks
from .ranking import ordered_starts

#: So many edges of an event, 16 bytes each, are left to a single task.  Edges of several events share a group of about ``GROUP``.
ONE_TASK, GROUP = 1_000_000, 100_000


def _search(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    total = len(names)
    if total < 3:
        return []
    u, v = at[: len(a)], at[len(a) :]
    order = np.argsort(np.concatenate((u, v)), kind="stable")
    near = np.concatenate((v, u))[order].tolist()
    first = np.searchsorted(np.concatenate((u, v))[order], np.arange(total + 1)).tolist()
    place, low, size, component = [-1] * total, [0] * total, [1] * total, [0] * total
    next_ = first[:-1]
    below: dict[int, list[int]] = {}
    sizes: list[int] = []
    seen = 0
    for root in range(total):
        if place[root] >= 0:
            continue
        place[root] = low[root] = seen
        seen += 1
        component[root] = len(sizes)
        path, parents = [root], [-1]
        while path:
            node = path[-1]
            if next_[node] < first[node + 1]:
                other = near[next_[node]]
                next_[node] += 1
                if place[other] < 0:
                    place[other] = low[other] = seen
                    seen += 1
                    component[other] = len(sizes)
                    path.append(other)
                    parents.append(node)
                elif other != parents[-1] and place[other] < low[node]:
                    low[node] = place[other]
            else:
                path.pop()
                parent = parents.pop()
                if parent >= 0:
                    if low[node] < low[parent]:
                        low[parent] = low[node]
                    size[parent] += size[node]
                    if low[node] >= place[parent]:
                        below.setdefault(parent, []).append(size[node])
        sizes.append(size[root])
    largest = sorted(range(len(sizes)), key=sizes.__getitem__)[-2:]
    out = []
    for node, parts in below.items():
        above = sizes[component[node]] - 1 - sum(parts)
        if above:
            parts = [*parts, above]
        if len(parts) > 1:
            elsewhere = max((sizes[c] for c in largest if c != component[node]), default=0)
            out.append((int(names[node]), total - 1 - max(*parts, elsewhere), len(parts) + len(sizes) - 1))
    return sorted(out, key=lambda x: (-x[1], -x[2], x[0]))


def cut_vertices(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(node, isolated, parts) of nodes whose removal increases the number of components.

    ``isolated`` is all other nodes, of any component, but those of the largest part that is left;
    ``parts`` is the number of components after removal.  Self-loops and repeated pairs do not count.
    """
    plain = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    return _search(*np.array(plain, dtype=np.int64).T) if plain else []


def _in_tasks(pairs: DataFrame, edges: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id", kind="stable")
        event, a, b = (pdf[c].to_numpy() for c in ("event_id", "a", "b"))
        cut = np.flatnonzero(np.r_[True, event[1:] != event[:-1], True]) if len(event) else [0]
        found = [(int(event[lo]), *f) for lo, hi in zip(cut[:-1], cut[1:]) for f in _search(a[lo:hi], b[lo:hi])]
        return pd.DataFrame(found, columns=["event_id", "id", "isolated", "parts"]).astype("int64")

    group = F.pmod(F.xxhash64("event_id"), F.lit(max(16, edges // GROUP)))
    return pairs.withColumn("g", group).groupBy("g").applyInPandas(run, "event_id long, id long, isolated long, parts long")


def _in_rounds(pairs: DataFrame, scratch: Scratch, one_task: int) -> DataFrame:
    """The same for graphs of any size; the number of rounds follows the logarithm of the number of nodes."""
    ends = pairs.select("event_id", F.col("a").alias("id")).union(pairs.select("event_id", "b")).distinct().withColumn("one", F.lit(1).cast("long"))
    # Nodes of all events are numbered, so that a node is one long.
    nodes = scratch.save(ordered_starts(ends, scratch, [F.col("event_id"), F.col("id")], "one", "node").select("event_id", "id", "node"), "nodes", release=False)
    of = lambda c: nodes.select("event_id", F.col("id").alias(c), F.col("node").alias(f"n{c}"))
    edges = pairs.join(of("a"), ["event_id", "a"]).join(of("b"), ["event_id", "b"])
    edges = scratch.save(edges.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")), "edges", release=False)
    tree, block, own = blocks.two_connected(edges, scratch, one_task)
    # A tree edge is known by its lower end.
    held = tree.where("parent IS NOT NULL").select("node", "parent", F.expr("(tout - tin + 1) div 2").alias("size"))
    below = scratch.save(held.join(block, "node", "left").select("node", "parent", "size", F.coalesce("component", "node").alias("block")), "below", release=False)
    above = below.select(F.col("node").alias("parent"), F.col("block").alias("up"))
    parts = below.join(above, "parent", "left").where("NOT (up <=> block)").groupBy("parent", "block").agg(F.sum("size").alias("size"), F.first("up").alias("up"))
    per = parts.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("cut_off"), F.max("size").alias("most"), F.count("*").alias("n"), F.max("up").alias("up"))
    whole = nodes.join(own, "node").groupBy("event_id", "component").agg(F.count("*").alias("members"))
    of = Window.partitionBy("event_id")
    # The largest component that is not the node's own: the largest of all, or the second where that is the own one.
    ranked = whole.withColumn("r", F.row_number().over(of.orderBy(F.desc("members"), "component")))
    best = ranked.groupBy("event_id").agg(F.sum("members").alias("total"), F.count("*").alias("components"), F.max(F.when(F.col("r") == 1, F.col("members"))).alias("m1"),
                                          F.max(F.when(F.col("r") == 2, F.col("members"))).alias("m2"), F.max(F.when(F.col("r") == 1, F.col("component"))).alias("c1"))
    rest = F.when(F.col("up").isNull(), 0).otherwise(F.col("members") - 1 - F.col("cut_off"))
    other = F.coalesce(F.when(F.col("component") == F.col("c1"), F.col("m2")).otherwise(F.col("m1")), F.lit(0))
    row = per.join(nodes, "node").join(own, "node").join(whole, ["event_id", "component"]).join(best, "event_id").withColumn("rest", rest)
    row = row.withColumn("n", F.col("n") + (F.col("rest") > 0).cast("long")).where("n > 1")
    return row.select("event_id", "id", (F.col("total") - 1 - F.greatest("most", "rest", other)).alias("isolated"), (F.col("n") + F.col("components") - 1).alias("parts"))


def chokepoints(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """(event_id, id, isolated, parts) of all cut vertices, whatever the size of an event's graph."""
    pairs = edges.select("event_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).where("a <> b")
    pairs = scratch.save(pairs.distinct(), "undirected", release=False)
    large = scratch.save(pairs.groupBy("event_id").agg(F.count("*").alias("n")).where(F.col("n") > one_task).select("event_id"), "large", release=False)
    small = _in_tasks(pairs.join(large, "event_id", "left_anti"), pairs.count())
    if large.isEmpty():
        return small
    return small.unionByName(_in_rounds(pairs.join(large, "event_id", "left_semi"), scratch, one_task))
