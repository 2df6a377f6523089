"""Projects that reach names, carried down the calls, against walks from the names."""

from __future__ import annotations

import random

import pytest

from impactloom.durable import Scratch
from impactloom.operators import traverse
from impactloom.operators.impact import Impact


@pytest.mark.parametrize("seed,depth,own,one_task", [(1, 2, False, 0), (2, 3, True, 0), (4, 3, False, 1000)])
def test_projects_equal_those_of_walks(spark, seed, depth, own, one_task):
    r = random.Random(seed)
    definitions = [(i, r.choice([None, 1, 2, 3, 4, 5, 6, 7])) for i in range(60) if i % 9] + [(4, 8)]
    calls = sorted({(r.randrange(60), r.randrange(60)) for _ in range(70)} | {(5, 5)})
    seeds = [(e, r.randrange(60)) for e in range(25)] + [(25, 5)]
    want = set()
    for e, i in seeds:
        level, reached = {i}, {i} if own else set()
        for _ in range(depth):
            level = {a for a, b in calls if b in level}
            reached |= level
        want |= {(e, p) for d, p in definitions if d in reached and p is not None}
    got = traverse.projects_reaching(spark.createDataFrame(seeds, "event_id long, id long"), spark.createDataFrame(definitions, "id long, project_id long"),
                                     spark.createDataFrame(calls, "source_id long, target_id long"), Scratch(spark, "projects"), depth, own, one_task).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 10


def test_services_need_no_row_for_a_name_and_definition(spark):
    definitions = spark.createDataFrame([(i, f"n{i}", "f", i % 3) for i in range(40)], "id long, name string, file_path string, project_id long")
    calls = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "source_id long, target_id long")
    events = spark.createDataFrame([(e, f"n{e}", "body-edit") for e in range(40)], "event_id long, changed_symbol string, edit_class string")
    impact = Impact(events, definitions, calls)
    got = {tuple(x) for x in impact.services().collect()}
    assert impact._reach is None and got == {(e, d % 3) for e in range(40) for d in range(e + 1, min(e + 9, 40))}
    impact.summary.count()
    assert got == {tuple(x) for x in impact.services().collect()}
