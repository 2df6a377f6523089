"""Cut vertices of many events whose graphs are unions of closures of names, without a row for each event and call.

Events are dealt into slices.  A task has the whole call graph, walks the closure of each name once and unites
closures in memory, some events at a time.  Of a batch of graphs all trees that hang from the rest are taken off
leaf by leaf, for the whole batch at once; only what is left, where calls form rings, is searched node by node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship

#: Distinct calls and definitions that a task may hold; nodes times events that are flagged at a time; changed names of a slice; rounds of taking leaves off.
HELD, FLAGS, SLICE, ROUNDS = 2_000_000, 1 << 21, 400_000, 2_000
#: Nodes of closures that are kept between events.
KEPT = 20_000_000


def _expand(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and places of the ranges ``first[k]:first[k + 1]`` for k in ``at``, one after the other."""
    n = first[at + 1] - first[at]
    return n, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)


def _core(first: np.ndarray, near: np.ndarray, weight: np.ndarray, size: np.ndarray, parts: np.ndarray, most: np.ndarray) -> None:
    """Searches nodes that have neighbours; sets the size of their components, and adds parts of core nodes to ``parts`` and ``most``."""
    total = len(first) - 1
    ends, near, weight = first.tolist(), near.tolist(), weight.tolist()
    next_ = ends[:-1]
    place, low, under, cut_off = [-1] * total, [0] * total, list(weight), [0] * total
    n_parts, largest = [0] * total, [0] * total
    seen = 0
    for root in range(total):
        if place[root] >= 0:
            continue
        place[root] = low[root] = seen
        seen += 1
        members, path, parents = [root], [root], [-1]
        while path:
            node = path[-1]
            at = next_[node]
            if at < ends[node + 1]:
                other = near[at]
                next_[node] = at + 1
                if place[other] < 0:
                    place[other] = low[other] = seen
                    seen += 1
                    members.append(other)
                    path.append(other)
                    parents.append(node)
                elif place[other] < low[node] and other != parents[-1]:
                    low[node] = place[other]
            else:
                path.pop()
                parent = parents.pop()
                if parent >= 0:
                    if low[node] < low[parent]:
                        low[parent] = low[node]
                    under[parent] += under[node]
                    if low[node] >= place[parent]:
                        n_parts[parent] += 1
                        cut_off[parent] += under[node]
                        if under[node] > largest[parent]:
                            largest[parent] = under[node]
        whole = under[root]
        for node in members:
            rest = whole - weight[node] - cut_off[node]
            if rest:
                n_parts[node] += 1
                if rest > largest[node]:
                    largest[node] = rest
        size[members] = whole
    parts += np.array(n_parts)
    np.maximum(most, np.array(largest), out=most)


def found(event: np.ndarray, u: np.ndarray, v: np.ndarray, events: int, top: int) -> tuple[np.ndarray, ...]:
    """(event, node, isolated, parts) of the first ``top`` cut vertices of each event that isolate something, as ``cutvertex`` counts them.

    Nodes 0.. of all events, those of an event together and in the order of their ids: ``event`` of each; edges (u, v) without loops and repeats.
    """
    total = len(event)
    degree = np.bincount(u, minlength=total) + np.bincount(v, minlength=total)
    # The sum of a node's neighbours is its only neighbour once one is left.
    near = (np.bincount(u, v, total) + np.bincount(v, u, total)).astype(np.int64)
    n_of = np.bincount(event[degree > 0], minlength=events)
    there = degree > 0
    weight, most, parts, up = np.ones(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, -1)
    mark, order = np.zeros(total, np.int64), []
    leaves = np.flatnonzero(degree == 1)
    while len(leaves) and len(order) < ROUNDS:
        to = near[leaves]
        # Of two leaves of one edge the smaller hangs from the other.
        free = (degree[to] > 1) | (leaves < to)
        leaves, to = leaves[free], to[free]
        up[leaves] = to
        order.append(leaves)
        degree[leaves] = 0
        own = weight[leaves]
        np.add.at(weight, to, own)
        np.maximum.at(most, to, own)
        np.add.at(parts, to, 1)
        np.subtract.at(degree, to, 1)
        np.subtract.at(near, to, leaves)
        to = to[degree[to] == 1]
        mark[to] = np.arange(len(to))
        leaves = to[mark[to] == np.arange(len(to))]
    size = weight.copy()
    core = np.flatnonzero(degree > 0)
    if len(core):
        at = np.full(total, -1)
        at[core] = np.arange(len(core))
        both = (at[u] >= 0) & (at[v] >= 0)
        a, b = at[u[both]], at[v[both]]
        ends, others = np.concatenate((a, b)), np.concatenate((b, a))
        by = np.argsort(ends, kind="stable")
        whole, n, largest = size[core], parts[core], most[core]
        _core(np.searchsorted(ends[by], np.arange(len(core) + 1)), others[by], weight[core], whole, n, largest)
        size[core], parts[core], most[core] = whole, n, largest
    root = there & (up < 0)
    for leaves in reversed(order):
        size[leaves] = size[up[leaves]]
    hung = np.flatnonzero(up >= 0)
    parts[hung] += 1
    most[hung] = np.maximum(most[hung], size[hung] - weight[hung])
    # Components: a core counts once, by shares of its members' weights.
    share = np.where(root, weight / size, 0.0)
    components = np.rint(np.bincount(event, share, events)).astype(np.int64)
    first, n_first, second = np.zeros(events, np.int64), np.zeros(events), np.zeros(events, np.int64)
    np.maximum.at(first, event[there], size[there])
    is_first = root & (size == first[event])
    n_first = np.rint(np.bincount(event[is_first], share[is_first], events)).astype(np.int64)
    less = there & (size < first[event])
    np.maximum.at(second, event[less], size[less])
    second = np.where(n_first > 1, first, second)
    cut = np.flatnonzero(there & (parts > 1))
    e = event[cut]
    elsewhere = np.where(size[cut] == first[e], second[e], first[e])
    isolated = n_of[e] - 1 - np.maximum(most[cut], elsewhere)
    all_parts = parts[cut] + components[e] - 1
    keep = isolated > 0
    cut, e, isolated, all_parts = cut[keep], e[keep], isolated[keep], all_parts[keep]
    # Those outside the largest component isolate least; where enough lie within it they need no order.
    least = isolated > n_of[e] - 1 - first[e]
    enough = np.bincount(e[least], minlength=events) >= top
    keep = least | ~enough[e]
    cut, e, isolated, all_parts = cut[keep], e[keep], isolated[keep], all_parts[keep]
    by = np.lexsort((cut, -all_parts, -isolated, e))
    cut, e, isolated, all_parts = cut[by], e[by], isolated[by], all_parts[by]
    few = np.arange(len(e)) - np.searchsorted(e, e) < top
    return e[few], cut[few], isolated[few], all_parts[few]


class _Graph:
    """The call graph with the definitions of names, and closures of names as they are asked for."""

    def __init__(self, calls: np.ndarray, seeds: np.ndarray, named: np.ndarray) -> None:
        self.ids, at = np.unique(np.concatenate((calls.ravel(), seeds[:, 1])), return_inverse=True)
        source, target = at[: 2 * len(calls)].reshape(-1, 2).T
        self.n = len(self.ids)
        self.all = self._callers(source, target)
        # A pair that calls each other is in the same closures: one of both calls is enough.
        key = np.unique(np.minimum(source, target) * self.n + np.maximum(source, target), return_index=True)[1]
        self.once = self._callers(source[key], target[key])
        self.names, name = np.unique(seeds[:, 0], return_inverse=True)
        by = np.argsort(name, kind="stable")
        self.seeds, self.first = at[2 * len(calls) :][by], np.searchsorted(name[by], np.arange(len(self.names) + 1))
        place = np.minimum(np.searchsorted(self.ids, named[:, 0]), self.n - 1)
        there = self.ids[place] == named[:, 0]
        by = np.argsort(place[there], kind="stable")
        self.name_of, self.first_name = named[there, 1][by], np.searchsorted(place[there][by], np.arange(self.n + 1))
        self.closures: dict[int, np.ndarray] = {}
        self.kept = 0

    def _callers(self, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(target, kind="stable")
        return np.searchsorted(target[by], np.arange(self.n + 1)), source[by].astype(np.int32)

    def closure(self, name: int) -> np.ndarray:
        """Nodes that reach a definition of the name, these included."""
        known = self.closures.get(name)
        if known is None:
            first, source = self.all
            level = np.unique(self.seeds[self.first[name] : self.first[name + 1]])
            seen = np.zeros(self.n, dtype=bool)
            seen[level] = True
            while len(level):
                level = source[_expand(first, level)[1]]
                level = np.unique(level[~seen[level]])
                seen[level] = True
            known = np.flatnonzero(seen).astype(np.int32)
            if self.kept + len(known) <= KEPT:
                self.closures[name], self.kept = known, self.kept + len(known)
        return known

    def cuts(self, event: np.ndarray, name: np.ndarray, top: int, shown: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(event, id, name, isolated, parts, is_changed, place) from pairs (event, name), sorted by event, numbers of both being 0.. without gaps."""
        starts = np.searchsorted(event, np.arange(event[-1] + 2))
        step = max(1, FLAGS // self.n)
        at = np.zeros(step * self.n, np.int32)
        first, source = self.once
        for lo in range(0, len(starts) - 1, step):
            hi = min(lo + step, len(starts) - 1)
            mine = slice(starts[lo], starts[hi])
            flags = np.zeros((hi - lo) * self.n, dtype=bool)
            for e, k in zip((event[mine] - lo).tolist(), name[mine].tolist()):
                flags[e * self.n : (e + 1) * self.n][self.closure(k)] = True
            key = np.flatnonzero(flags)
            of, node = np.divmod(key, self.n)
            at[key] = np.arange(len(key))
            n, place = _expand(first, node)
            u = at[np.repeat(of * self.n, n) + source[place]]
            e, cut, isolated, parts = found(of, u, np.repeat(np.arange(len(key)), n), hi - lo, top)
            n, place = _expand(self.first, name[mine])
            flags[:] = False
            flags[np.repeat((event[mine] - lo) * self.n, n) + self.seeds[place]] = True
            changed = flags[key[cut]]
            # Of definitions with one name the first stands for all.
            n, place = _expand(self.first_name, node[cut])
            row, called = np.repeat(np.arange(len(cut)), n), self.name_of[place]
            by = np.lexsort((row, called, e[row]))
            row, called = row[by], called[by]
            new = np.r_[True, (e[row][1:] != e[row][:-1]) | (called[1:] != called[:-1])][: len(row)]
            row, called = row[new], called[new]
            by = np.argsort(row, kind="stable")
            row, called = row[by], called[by]
            rank = np.arange(len(row)) - np.searchsorted(e[row], e[row])
            few = rank < shown
            row, called, rank = row[few], called[few], rank[few]
            yield e[row] + lo, self.ids[node[cut[row]]], called, isolated[row], parts[row], changed[row], rank + 1


def _search(top: int, shown: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            kind, pair = batch.column(0).to_numpy(), np.stack((batch.column(1).to_numpy(), batch.column(2).to_numpy()), axis=1)
            for k, held in enumerate(rows):
                held.append(pair[kind == k])
        calls, seeds, changed, named = (np.concatenate(x) if x else np.zeros((0, 2), np.int64) for x in rows)
        if not len(calls) or not len(seeds) or not len(changed):
            return
        graph = _Graph(calls, seeds, named)
        name = np.minimum(np.searchsorted(graph.names, changed[:, 1]), len(graph.names) - 1)
        known = graph.names[name] == changed[:, 1]
        events, event = np.unique(changed[known, 0], return_inverse=True)
        if not len(events):
            return
        event, name = np.divmod(np.unique(event * len(graph.names) + name[known]), len(graph.names))
        for e, id_, called, isolated, parts, is_changed, place in graph.cuts(event, name, top, shown):
            yield pa.RecordBatch.from_arrays([pa.array(events[e]), *(pa.array(x.astype(np.int64)) for x in (id_, called, isolated, parts)), pa.array(is_changed), pa.array(place.astype(np.int32))],
                                             names=["event_id", "id", "name", "isolated", "parts", "is_changed", "place"])

    return run


def first_cuts(changed: DataFrame, seeds: DataFrame, pairs: DataFrame, definitions: DataFrame, top: int, shown: int, slice_rows: int = SLICE) -> DataFrame:
    """(event_id, id, name, isolated, parts, is_changed, place): what ``scoring.named_cuts`` gives, from each event's names (event_id, name).

    Names are hashes. ``seeds``: (event_id, id), ``event_id`` being a name's hash; ``pairs``: distinct calls without loops.
    """
    ship(changed.sparkSession)
    slices = max(2 * changed.sparkSession.sparkContext.defaultParallelism, -(-changed.count() // slice_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    part = lambda df, kind, a, b, slice_=every: df.select(slice_, F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    own = F.pmod(F.xxhash64("event_id"), F.lit(slices)).cast("int").alias("slice")
    named = definitions.where("id IS NOT NULL").select("id", F.xxhash64("name").alias("name")).distinct()
    rows = part(pairs, 0, "source_id", "target_id").unionByName(part(seeds, 1, "event_id", "id")).unionByName(part(changed, 2, "event_id", "name", own)).unionByName(part(named, 3, "id", "name"))
    return rows.repartitionById(slices, F.col("slice")).drop("slice").mapInArrow(_search(top, shown), "event_id long, id long, name long, isolated long, parts long, is_changed boolean, place int")
