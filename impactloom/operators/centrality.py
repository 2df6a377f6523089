"""Degrees, PageRank and ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..durable import Scratch
from ..session import ship

DAMPING, ROUNDS, TOLERANCE = 0.85, 60, 1e-9
#: So many edges, 16 bytes each, are left to a single task.
ONE_TASK = 200_000
#: Up to so many edges, a row group of DuckDB, shares are added as edges come, which is what SQL does; above, where it adds parts in any order, shares of a node are added by size.
IN_ORDER = 122_880
#: Shares of scores, which are 1 together.
SHARE = "decimal(38, 34)"


def degrees(calls: DataFrame) -> DataFrame:
    """(id, inbound, outbound): distinct callers and callees; each side is aggregated before they meet."""
    pairs = calls.distinct()
    inbound = pairs.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("inbound"))
    outbound = pairs.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("outbound"))
    return inbound.join(outbound, "id", "full").select("id", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


def _rank_in_task(rounds: int, tolerance: float, damping: float):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdfs = list(pdfs)
        if not pdfs:
            return
        rows = pd.concat(pdfs)
        known = rows[rows["score"].notna()]
        edges = rows.loc[rows["score"].isna(), ["source_id", "target_id"]].to_numpy(dtype=np.int64)
        if not len(edges):
            return
        names, at = np.unique(edges.ravel(), return_inverse=True)
        source, target = at.reshape(-1, 2).T
        n, out = len(names), np.bincount(source, minlength=len(names))
        score, of = np.full(n, 1 / n), out[source]
        if len(known):
            place = np.searchsorted(names, known["source_id"].to_numpy())
            there = (place < n) & (names[np.minimum(place, n - 1)] == known["source_id"].to_numpy())
            score[place[there]] = known["score"].to_numpy()[there]
            score /= score.sum()
        for k in range(1, rounds + 1):
            # A division for each edge: nodes that must tie get the same sums, so that ids decide.
            share = score[source] / of
            if len(edges) > IN_ORDER:
                by = np.lexsort((share, target))
                got = np.bincount(target[by], share[by], minlength=n)
            else:
                got = np.bincount(target, share, minlength=n)
            following = round(1 - damping, 12) / n + damping * (got + score[out == 0].sum() / n)
            change, score = np.abs(following - score).sum(), following
            if change < tolerance:
                break
        yield pd.DataFrame({"id": names, "score": score, "change": change, "rounds": k})

    return run


def pagerank(calls: DataFrame, scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE, damping: float = DAMPING, one_task: int = ONE_TASK,
             start: DataFrame | None = None) -> DataFrame:
    """(id, score, change, rounds) over the multigraph: parallel edges count each, self-loops stay, dangling mass is spread evenly.

    Stops after the round whose L1 change is below ``tolerance``, or after ``rounds``; ``change`` is that
    of the last round, so a reader can tell.  ``start`` (id, score) is where to begin, as the scores of an
    earlier state of the graph; other nodes begin with an even share.  Graphs of up to ``one_task`` edges are solved in a task.
    For larger ones each round is a table in the shared folder, and one aggregate of it gives both the
    change and the mass that dangles.
    """
    calls = calls.select("source_id", "target_id")
    if calls.count() <= one_task:
        ship(calls.sparkSession)
        rows = calls.withColumn("score", F.lit(None).cast("double"))
        if start is not None:
            rows = rows.unionByName(start.select(F.col("id").alias("source_id"), F.lit(None).cast("long").alias("target_id"), "score"))
        return scratch.save(rows.coalesce(1).mapInPandas(_rank_in_task(rounds, tolerance, damping), "id long, score double, change double, rounds int"), "ranks", release=False)
    out = calls.groupBy("source_id").agg(F.count("*").alias("out"))
    edges = scratch.save(calls.groupBy("source_id", "target_id").agg(F.count("*").alias("m")).join(out, "source_id")
                         .select("source_id", "target_id", "m", "out"), "edges", release=False)
    nodes = calls.select(F.col("source_id").alias("id")).unionByName(calls.select(F.col("target_id").alias("id"))).distinct()
    nodes = scratch.save(nodes.join(out.select(F.col("source_id").alias("id"), F.lit(False).alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(True)).alias("dangling")), "nodes", release=False)
    n, dangling = nodes.agg(F.count("*"), F.count_if("dangling")).first()
    rank, lost, change = nodes.withColumn("score", F.lit(1.0 / n)), dangling / n, None
    if start is not None and n:
        begun = nodes.join(start.select("id", F.col("score").alias("had")), "id", "left").withColumn("score", F.coalesce("had", F.lit(1.0 / n)))
        total, lost = begun.agg(F.sum("score"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0))).first()
        rank, lost = scratch.save(begun.select("id", "dangling", (F.col("score") / F.lit(total)).alias("score")), "rank-0", release=False), lost / total
    for k in range(1, rounds + 1):
        # Sums of decimals do not depend on the order in which shares come, so nodes that must tie do.
        share = (F.col("score") / F.col("out") * F.col("m")).cast(SHARE)
        moved = rank.join(edges, rank["id"] == edges["source_id"]).groupBy(F.col("target_id").alias("id")).agg(F.sum(share).cast("double").alias("got"))
        following = (rank.select("id", "dangling", F.col("score").alias("old")).join(moved, "id", "left")
                     .select("id", "dangling", "old", (F.lit(round(1 - damping, 12) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))).alias("score")))
        following = scratch.save(following, f"rank-{k}", release=False)
        change, lost = following.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0))).first()
        rank = following.select("id", "dangling", "score")
        if k > 1:
            scratch.drop(f"rank-{k - 1}")
        if change < tolerance:
            break
    return rank.select("id", "score", F.lit(change).cast("double").alias("change"), F.lit(k).alias("rounds"))


def ranked(scores: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, score, rank), ties by id: a global order without a window over all rows.

    Rows are sorted into ranges; a row's rank is its place in its range and the number of rows before it.
    """
    placed = scores.select("id", "score").repartitionByRange(F.desc("score"), F.asc("id")).withColumn("part", F.spark_partition_id())
    placed = scratch.save(placed, "ranges", release=False)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "id"))
    return placed.join(F.broadcast(before), "part").select("id", "score", (within + F.col("before")).cast("long").alias("rank"))
