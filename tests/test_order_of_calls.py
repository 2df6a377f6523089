"""Ranks in graphs of many calls do not depend on the order in which calls come."""

from __future__ import annotations

from itertools import permutations

import pytest

from impactloom.durable import Scratch
from impactloom.operators import centrality
from pyspark.sql import functions as F


@pytest.mark.parametrize("one_task", [centrality.ONE_TASK, 0])
def test_nodes_with_equal_shares_tie_in_any_order(spark, one_task):
    # Callers of 3, 7, 11, 13 and 17 calls; each of 120 nodes is called by one of each, in another order.
    kinds, calls, callers = (3, 7, 11, 13, 17), [], {}
    for node, order in enumerate(permutations(kinds)):
        for kind in order:
            caller, left = callers.get(kind, (0, 0))
            if not left:
                caller, left = 1000 + len(calls), kind
            calls.append((caller, node))
            callers[kind] = (caller, left - 1)
    calls += [(caller, 10_000_000 + k) for caller, left in callers.values() for k in range(left)]
    scratch = Scratch(spark, "t")
    many = spark.range(130_000).select((F.col("id") + 20_000_000).alias("source_id"), (F.col("id") + 30_000_000).alias("target_id")) if one_task else spark.createDataFrame([], "source_id long, target_id long")
    rows = spark.createDataFrame(calls, "source_id long, target_id long").coalesce(1).unionByName(many)
    got = centrality.ranked(centrality.pagerank(rows, scratch, rounds=4, tolerance=0.0, one_task=one_task), scratch).where("id < 120").orderBy("rank").collect()
    assert [r.id for r in got] == list(range(120)) and len({r.score for r in got}) == 1
