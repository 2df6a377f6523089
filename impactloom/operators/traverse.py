"""Traversal of the call graph, for many events at once.

Graphs of up to ``ONE_TASK`` distinct calls (a fixed bound, 16 bytes each) go to every task, which
walks from its own part of the seeds; larger ones take a round over all tasks for each level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..durable import Scratch
from ..session import ship
from .ranking import ordered_starts
from .reach import few

MAX_DEPTH = 8
#: The most distinct calls that every task may hold, how many events one walk takes along, how many seeds share a task, and the fewest groups of them.
ONE_TASK, TOGETHER, SEEDS, FEWEST_GROUPS = 200_000, 64, 8192, 8


def seeds_of(events: DataFrame, definitions: DataFrame) -> DataFrame:
    """(event_id, id): all definitions with a changed name; namesakes are united."""
    return events.select("event_id", F.col("changed_symbol").alias("name")).distinct().join(definitions.select("id", "name"), "name").select("event_id", "id").distinct()


def _walk(max_depth: int | None):
    """Rows (g, kind, a, b), calls (0, source, target) before seeds (1, event, id), to (event, id, depth).

    Without ``max_depth`` each node is reached once (a closure, seeds at depth 0), else once a level.
    """

    def search(calls: np.ndarray, seeds: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, at = np.unique(np.concatenate((calls.ravel(), seeds[:, 1])), return_inverse=True)
        source, target = at[: 2 * len(calls)].reshape(-1, 2).T
        order = np.argsort(target, kind="stable")
        first = np.searchsorted(target[order], np.arange(len(names) + 1))
        source, n = source[order], len(names)
        events, event = np.unique(seeds[:, 0], return_inverse=True)
        start = at[2 * len(calls) :]
        for lo in range(0, len(events), TOGETHER):
            mine = (event >= lo) & (event < lo + TOGETHER)
            level = np.unique((event[mine] - lo) * n + start[mine])
            seen = level
            out, depth = [(level, 0)] if max_depth is None else [], 0
            while len(level) and (max_depth is None or depth < max_depth):
                depth += 1
                who, node = level // n, level % n
                count = first[node + 1] - first[node]
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[node], count)
                level = np.unique(np.repeat(who, count) * n + source[place])
                if max_depth is None:
                    level = np.setdiff1d(level, seen, assume_unique=True)
                    seen = np.union1d(seen, level)
                out.append((level, depth))
            for keys, d in out:
                yield pa.record_batch([pa.array(events[lo + keys // n]), pa.array(names[keys % n]), pa.array(np.full(len(keys), d, dtype=np.int32))], names=["event_id", "id", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition holds several groups, each of all calls and some seeds; seeds are parts of one whole.
        group, calls, seeds = None, [], []
        for batch in batches:
            g, kind, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            group = g[0] if group is None and len(g) else group
            pair = np.stack((a, b), axis=1)
            calls.append(pair[(kind == 0) & (g == group)])
            seeds.append(pair[kind == 1])
        if seeds and sum(map(len, seeds)):
            yield from search(np.concatenate(calls).astype(np.int64), np.concatenate(seeds).astype(np.int64))

    return run


def _walk_in_tasks(seeds: DataFrame, step: DataFrame, max_depth: int | None) -> DataFrame:
    ship(seeds.sparkSession)
    groups = max(FEWEST_GROUPS, -(-seeds.count() // SEEDS))
    calls = step.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(0).alias("kind"), F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    starts = seeds.select(F.pmod(F.xxhash64("event_id"), F.lit(groups)).cast("int").alias("g"), F.lit(1).alias("kind"), F.col("event_id").alias("a"), F.col("id").alias("b"))
    # A partition for each group, whatever their numbers hash to.
    return calls.unionByName(starts).repartitionById(groups, F.col("g")).mapInArrow(_walk(max_depth), "event_id long, id long, depth int")


def callers_by_depth(seeds: DataFrame, calls: DataFrame, scratch: Scratch, max_depth: int = MAX_DEPTH, name: str = "level", one_task: int = ONE_TASK) -> DataFrame:
    """(event_id, id, depth): ids with a walk of that length to a seed, up to ``max_depth``.

    Levels are sets, so cycles end at the bound and a node appears once a level.  In rounds, each level
    is a table in the shared folder: it is read by the next one and by the result.
    """
    step = scratch.save(calls.select("source_id", "target_id").distinct(), f"{name}-step", release=False)
    level, out = seeds.select("event_id", "id"), None
    if step.count() <= one_task:
        return scratch.save(_walk_in_tasks(level, step, max_depth), name, release=False)
    for depth in range(1, max_depth + 1):
        level = scratch.save(level.join(step, level["id"] == step["target_id"]).select("event_id", F.col("source_id").alias("id")).distinct(), f"{name}-{depth}", release=False)
        row = level.withColumn("depth", F.lit(depth))
        out = row if out is None else out.unionByName(row)
    return out


def changed_names(events: DataFrame, scratch: Scratch) -> DataFrame:
    """(event_id, name): what each event changes, names by their hashes; written once, so that events are not joined anew for every reader."""
    return scratch.save(events.select("event_id", F.xxhash64("changed_symbol").alias("name")).where("event_id IS NOT NULL AND changed_symbol IS NOT NULL").distinct(), "changed")


def names_of(events: DataFrame, definitions: DataFrame) -> DataFrame:
    """(event_id, id): the definitions of each changed name; ``event_id`` is the hash of the name.

    A walk starts once from a name, however many events change it.
    """
    names = events.select(F.col("changed_symbol").alias("name")).distinct()
    return definitions.select("id", "name").join(names, "name", "left_semi").select(F.xxhash64("name").alias("event_id"), "id").distinct()


def of_events(events: DataFrame, per_name: DataFrame) -> DataFrame:
    """Rows of names, as ``names_of`` numbers them, for every event that changes such a name.

    Events are dealt out before they meet those rows, so while these are few enough for the optimiser
    to broadcast them, nothing that the join multiplies is shuffled for an aggregate per event.
    """
    changed = events.select(F.col("event_id").alias("event"), F.xxhash64("changed_symbol").alias("event_id")).distinct()
    width = 4 * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return changed.repartition(width, "event").withColumnRenamed("event_id", "_name").join(per_name.withColumnRenamed("event_id", "_name"), "_name").drop("_name").withColumnRenamed("event", "event_id")


def dependents(walked: DataFrame, definitions: DataFrame) -> DataFrame:
    """(event_id, id, depth, file_path, project_id): what has a definition row."""
    return walked.join(definitions.select("id", "file_path", "project_id", "name"), "id")


def closure(seeds: DataFrame, calls: DataFrame, scratch: Scratch, name: str = "closure", one_task: int = ONE_TASK) -> DataFrame:
    """(event_id, id): everything that reaches a seed, seeds included; a fixpoint without depth bound."""
    step = scratch.save(calls.select("source_id", "target_id").distinct(), f"{name}-step", release=False)
    if step.count() <= one_task:
        return scratch.save(_walk_in_tasks(seeds, step, None).select("event_id", "id"), name, release=False)
    visited = scratch.save(seeds.select("event_id", "id").distinct(), f"{name}-0", release=False)
    frontier, k = visited, 0
    while True:
        k += 1
        found = frontier.join(step, frontier["id"] == step["target_id"]).select("event_id", F.col("source_id").alias("id")).distinct()
        frontier = scratch.save(found.join(visited, ["event_id", "id"], "left_anti"), f"{name}-frontier-{k}", release=False)
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)
        if k % 8 == 0:
            visited = scratch.save(visited, f"{name}-{k}", release=False)


def induced_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(event_id, source_id, target_id): calls with both ends in a closure, multiplicity kept.

    A closure holds all callers of its nodes, so the calls of its nodes are all that lie within it.
    """
    return nodes.join(calls, nodes["id"] == calls["target_id"]).select("event_id", "source_id", "target_id")


def projects_reaching(seeds: DataFrame, definitions: DataFrame, calls: DataFrame, scratch: Scratch, max_depth: int = MAX_DEPTH, own: bool = False, one_task: int = ONE_TASK) -> DataFrame:
    """(event_id, project_id): the projects of what reaches a seed (event_id, id) by up to ``max_depth`` calls; ``own``: those of seeds too.

    In rounds, projects go from callers to what they call, so there is a row for each definition and project, however
    many seeds a definition reaches.  A project that came before goes no further.
    """
    step = scratch.save(calls.select("source_id", "target_id").distinct(), "projects-step", release=False)
    start = definitions.where("project_id IS NOT NULL AND id IS NOT NULL").select("id", "project_id").distinct()
    if step.count() <= one_task:
        walked = _walk_in_tasks(seeds.select("event_id", "id"), step, max_depth).select("event_id", "id")
        return (walked.unionByName(seeds.select("event_id", "id")) if own else walked).join(start, "id").select("event_id", "project_id").distinct()
    start = scratch.save(start, "projects-0", release=False)
    new, seen = start, start if own else None
    for depth in range(1, max_depth + 1):
        found = new.join(step, new["id"] == step["source_id"]).select(F.col("target_id").alias("id"), "project_id").distinct()
        new = scratch.save(found if seen is None else found.join(seen, ["id", "project_id"], "left_anti"), f"projects-{depth}", release=depth % 4 == 0)
        if new.isEmpty():
            break
        seen = new if seen is None else seen.unionByName(new)
    return (seen if seen is not None else new).join(seeds.select("event_id", "id"), "id").select("event_id", "project_id").distinct()


def walk_counts(seeds: DataFrame, calls: DataFrame, scratch: Scratch, max_depth: int = 5) -> DataFrame:
    """(event_id, id, depth, walks): numbers of walks, seeds at depth 0, without listing the walks."""
    level = seeds.select("event_id", "id", F.lit(1).cast("long").alias("walks"))
    out = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        level = scratch.save(level.join(calls, level["id"] == calls["target_id"]).groupBy("event_id", F.col("source_id").alias("id")).agg(F.sum("walks").alias("walks")), f"walks-{depth}", release=False)
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


def neighbourhood(seeds: DataFrame, calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(event_id, path, weight): files of changed (1.0), calling and called (0.5) definitions; the largest weight wins."""
    up = seeds.join(calls, seeds["id"] == calls["target_id"]).select("event_id", F.col("source_id").alias("id"), F.lit(0.5).alias("weight"))
    down = seeds.join(calls, seeds["id"] == calls["source_id"]).select("event_id", F.col("target_id").alias("id"), F.lit(0.5).alias("weight"))
    all_ = seeds.select("event_id", "id", F.lit(1.0).alias("weight")).unionByName(up).unionByName(down)
    return all_.join(definitions.select("id", "file_path"), "id").groupBy("event_id", F.col("file_path").alias("path")).agg(F.max("weight").alias("weight"))


def neighbourhood_of_events(changed: DataFrame, near: DataFrame, scratch: Scratch) -> DataFrame:
    """(event_id, path, weight) of events (event_id, name) from ``near``, the neighbourhoods of names (``event_id`` being a name's hash).

    Files are numbered, and 64 of them are one number of bits, so names meet in an event as a few numbers.  Events are
    dealt out once; where names and files are few these come to the events, and no row of an event and a file is shuffled.
    """
    near = scratch.save(near, "near-names", release=False)
    paths = near.select("path").distinct().withColumn("one", F.lit(1).cast("long"))
    numbered = ordered_starts(paths, scratch, [F.asc_nulls_first("path")], "one", "n")
    numbered = scratch.save(numbered.select("path", F.expr("n div 64").alias("word"), F.expr("shiftleft(1L, int(n % 64))").alias("bit")), "near-files", release=False)
    both = near.join(numbered.withColumnRenamed("path", "_path"), F.col("path").eqNullSafe(F.col("_path")))
    words = both.groupBy(F.col("event_id").alias("name"), "word").agg(F.bit_or("bit").alias("any"), F.bit_or(F.when(F.col("weight") >= 1, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("own"))
    width = 4 * int(changed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = changed.repartition(width, "event_id").join(few(scratch.save(words, "near-words", release=False)), "name").groupBy("event_id", "word").agg(F.bit_or("any").alias("any"), F.bit_or("own").alias("own"))
    return met.join(few(numbered), "word").where("any & bit <> 0").select("event_id", "path", F.when(F.expr("own & bit <> 0"), 1.0).otherwise(0.5).alias("weight"))
