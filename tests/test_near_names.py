"""What events take over from their names, against rows for each event and definition; nothing of an event but its names is shuffled."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from impactloom.operators import history, traverse
from impactloom.operators.impact import Impact


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(5)
    spans = [(i, f"n{i % 4}", f"f{r.randrange(150)}", 0, r.choice([0, 1, 1, 1]), 9) for i in range(300)]
    definitions = spark.createDataFrame(spans, "id long, name string, file_path string, project_id long, start_line long, end_line long")
    calls = [(r.randrange(300), min(r.randrange(300), r.randrange(300))) for _ in range(500)]
    events = [(e, f"n{n}", "body-edit") for e in range(30) for n in r.sample(range(5), r.randrange(1, 4))]
    return spans, calls, events, definitions, spark.createDataFrame(calls, "source_id long, target_id long"), spark.createDataFrame(events, "event_id long, changed_symbol string, edit_class string")


def test_neighbourhoods_of_events_equal_those_of_their_seeds(graph):
    _, _, _, definitions, calls, events = graph
    want = {tuple(x) for x in traverse.neighbourhood(traverse.seeds_of(events, definitions), calls, definitions).collect()}
    got = [tuple(x) for x in Impact(events, definitions, calls).near().collect()]
    assert set(got) == want and len(got) == len(want) > 300


def test_heaviest_definitions_of_events_equal_brute_force(graph):
    spans, calls, events, *frames = graph
    definitions, call_rows, event_rows = frames
    inbound = {d: len({s for s, t in calls if t == d}) for d in range(300)}
    seeds = {n: {d[0] for d in spans if d[1] == n} for n in {e[1] for e in events}}
    reach = {}
    for n, level in seeds.items():
        reach[n] = set()
        for _ in range(traverse.MAX_DEPTH):
            level = {s for s, t in calls if t in level}
            reach[n] |= level
    usable = {d[0] for d in spans if d[4] >= 1}
    want = set()
    for e in {x[0] for x in events}:
        names = [n for x, n, _ in events if x == e]
        both = {d for n in names for d in seeds[n] | reach[n]} & usable
        want |= {(e, d, inbound[d]) for d in sorted(both, key=lambda d: (-inbound[d], d))[: history.BLAST]}
    blast = Impact(event_rows, definitions, call_rows).blast()
    got = [(x.event_id, x.id, x.inbound) for x in blast.collect()]
    assert set(got) == want and len(got) == len(want) and max(sum(1 for g in got if g[0] == e) for e in range(30)) == history.BLAST
    # Events are dealt out once; an aggregate of an event stays in its partition.
    plan = blast.groupBy("event_id").agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
