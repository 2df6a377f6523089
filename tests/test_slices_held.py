"""What names reach is sent to few tasks, each of which holds it for many groups of events."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from test_slices import SCHEMA

from impactloom.durable import Scratch
from impactloom.operators import reach


@pytest.mark.parametrize("kept,together,top", [(1 << 26, 7, None), (0, 7, 3), (40, 1, 0), (0, 10**6, None)])
def test_groups_of_events_equal_all_at_once(monkeypatch, kept, together, top):
    r = random.Random(5)
    starts = [0, 3, 900, reach.CHUNK, reach.CHUNK + 70_000, 4 * reach.CHUNK]
    rows = [(-1, 0, e, n, None, None) for e in range(40) for n in r.sample(range(9), r.randrange(0, 5))] + [(-1, 1, n, n % 4 + 1, None, [n % 3, 7]) for n in range(8)]
    rows += [(s // reach.CHUNK, 0, s, r.choice([-1, 0, 3]), None, None) for s in starts]
    for n in range(8):
        for c in {s // reach.CHUNK for s in starts}:
            lo = min(s for s in starts if s // reach.CHUNK == c) - c * reach.CHUNK
            rows.append((c, 1, n, 0, sorted(r.sample(range(lo, lo + 90_000), 50)), None))
    rows.sort(key=lambda x: x[:3])
    batches = lambda: iter([pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, x)) for x in rows[k : k + 13]], schema=SCHEMA) for k in range(0, len(rows), 13)])
    want = [x for b in reach._digest(top, 1 << 27)(batches()) for x in b.to_pylist()]
    monkeypatch.setattr(reach, "KEPT", kept)
    assert [x for b in reach._digest(top, 1 << 27, together)(batches()) for x in b.to_pylist()] == want and len(want) > 30


def test_many_events_that_list_their_files_are_few_slices(spark):
    d = spark.createDataFrame([(i, f"p{i % 5}", 1) for i in range(50)], "id long, file_path string, project_id long")
    places = reach.numbered(d, Scratch(spark, "t"))
    names = reach.packed(spark.createDataFrame([(n, n + k, 1) for n in range(40) for k in range(9)], "event_id long, id long, depth int"), places)
    changed = spark.createDataFrame([(e, e % 40) for e in range(2000)], "event_id long, name long")
    digest = reach.digests(changed, names, places, None, slice_rows=20)
    assert digest.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert {x.event_id: x.n for x in digest.collect()} == {e: 9 for e in range(2000)}
