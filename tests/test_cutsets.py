"""Cut vertices of many events in slices against the search of each event's graph."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from impactloom.operators import cutsets, cutvertex, scoring
from impactloom.operators.impact import Impact


@pytest.mark.parametrize("seed", range(60))
def test_slices_equal_a_search_of_each_event(seed, monkeypatch):
    r = random.Random(seed)
    if seed % 3 == 0:
        monkeypatch.setattr(cutsets, "ROUNDS", 1)
        monkeypatch.setattr(cutsets, "FLAGS", 1)
        monkeypatch.setattr(cutsets, "KEPT", 0)
    n = r.randrange(2, 40)
    calls = sorted({(a, b) for a, b in ((r.randrange(n) * 7 - 3, r.randrange(n) * 7 - 3) for _ in range(r.randrange(1, 70))) if a != b})
    name_of = {k * 7 - 3: r.randrange(8) * 100 for k in range(n) if r.random() < 0.9}
    changed = [(e * 11, k * 100) for e in range(30) for k in r.sample(range(9), r.randrange(1, 4))]
    rows = [(0, *c) for c in calls] + [(1, k, i) for i, k in name_of.items()] + [(2, *c) for c in changed] + [(3, i, k) for i, k in name_of.items()]
    r.shuffle(rows)
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), *(pa.array([x[k] for x in part], pa.int64()) for k in (1, 2))], names=["kind", "a", "b"]) for part in (rows[:9], rows[9:]) if part]
    got: dict[int, list] = {}
    for batch in cutsets._search(20, 5)(iter(batches)):
        for x in batch.to_pylist():
            got.setdefault(x["event_id"], []).append((x["place"], x["name"], x["isolated"], x["parts"], x["is_changed"]))
    for e in {e for e, _ in changed}:
        seeds = {i for i, k in name_of.items() if (e, k) in changed}
        closure = set(seeds)
        while more := {a for a, b in calls if b in closure} - closure:
            closure |= more
        want: list = []
        for id_, isolated, parts in [c for c in cutvertex.cut_vertices([(a, b) for a, b in calls if b in closure]) if c[1] > 0][:20]:
            if id_ in name_of and name_of[id_] not in [w[1] for w in want]:
                want.append((len(want) + 1, name_of[id_], isolated, parts, id_ in seeds))
        assert sorted(got.get(e, [])) == want[:5]


def test_no_row_for_an_event_and_call_is_written(spark):
    # A hundred events that all reach a fan of 300 calls: what is written of cut vertices is a row an event, not 30,000.
    definitions = spark.createDataFrame([(i, f"n{i}", "f", 1) for i in range(302)], "id long, name string, file_path string, project_id long")
    calls = spark.createDataFrame([(1, 0)] + [(i, 1) for i in range(2, 302)], "source_id long, target_id long")
    events = spark.createDataFrame([(e, "n0", "body-edit") for e in range(100)], "event_id long, changed_symbol string, edit_class string")
    impact = Impact(events, definitions, calls)
    cuts = impact.cuts().collect()
    assert {(c.name, c.isolated, c.parts, c.is_changed, c.place) for c in cuts} == {("n1", 300, 301, False, 1)} and len(cuts) == 100
    path = spark._jvm.org.apache.hadoop.fs.Path(impact.scratch.root)
    written = {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
    assert "cuts" in written and not written & {"undirected", "induced"}


def test_large_graphs_take_the_other_way(spark, monkeypatch):
    definitions = spark.createDataFrame([(i, f"n{i % 7}", "f", 1) for i in range(40)], "id long, name string, file_path string, project_id long")
    calls = spark.createDataFrame([(i, i // 2) for i in range(1, 40)] + [(30, 3), (31, 5)], "source_id long, target_id long")
    events = spark.createDataFrame([(e, f"n{(e * k) % 9}", "body-edit") for e in range(12) for k in (1, 2)], "event_id long, changed_symbol string, edit_class string")
    here = {tuple(r) for r in Impact(events, definitions, calls).cuts().collect()}
    monkeypatch.setattr(cutsets, "HELD", 0)
    assert here == {tuple(r) for r in Impact(events, definitions, calls).cuts().collect()} and len(here) > 12 and scoring.SHOWN_CUTS == 5
