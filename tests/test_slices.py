"""Slices of events against sets."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from impactloom.operators import reach

SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("v", pa.list_(pa.int32())), ("p", pa.list_(pa.int64()))])


@pytest.mark.parametrize("top,room,size,few", [(3, 1 << 27, 11, 900), (None, 1 << 27, 100_000, 900), (None, 0, 7, 900), (3, 0, 100_000, 900), (2, 1 << 27, 100_000, 3), (0, 1 << 27, 50, 3)])
def test_digests_of_a_slice_equal_sets(top, room, size, few):
    r = random.Random(size + few)
    starts = [0, 1, 40, 41, 700, reach.CHUNK, reach.CHUNK + few, 3 * reach.CHUNK]
    label = {s: r.choice([-1, 0, 40, reach.CHUNK]) for s in starts}
    ends = [*starts[1:], 3 * reach.CHUNK + 50]
    names = {n * 10**12: sorted({p for _ in range(r.randrange(1, 5)) for lo, hi in [r.choice(list(zip(starts, ends)))] for p in r.choices(range(lo, min(hi, lo + few)), k=r.randrange(1, 40))}) for n in range(12)}
    depth, projects = {n: r.randrange(1, 9) for n in names}, {n: r.sample(range(9), r.randrange(0, 4)) for n in names}
    events = {e * 10**11: r.sample([*names, 5], r.randrange(0, 8)) for e in range(60)}
    chunk_of = lambda p: max(s for s in starts if s <= p) // reach.CHUNK
    rows = [(-1, 0, e, n, None, None) for e in events for n in events[e]] + [(-1, 1, n, depth[n], None, projects[n]) for n in names] + [(s // reach.CHUNK, 0, s, label[s], None, None) for s in starts]
    for n, places in names.items():
        for c in {chunk_of(p) for p in places}:
            rows.append((c, 1, n, 0, [p - c * reach.CHUNK for p in places if chunk_of(p) == c], None))
    rows.sort(key=lambda x: x[:3])
    batches = [pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, x)) for x in rows[k : k + size]], schema=SCHEMA) for k in range(0, len(rows), size)]
    got = {x.pop("event_id"): x for b in reach._digest(top, room)(iter(batches)) for x in b.to_pylist()}
    want = {}
    for e, changed in events.items():
        known = [n for n in changed if n in names]
        if not known:
            continue
        held, files, labels = {p for n in known for p in names[n]}, {}, {}
        for p in held:
            s = max(s for s in starts if s <= p)
            files[s] = files.get(s, 0) + 1
        for s, n in files.items():
            if label[s] >= 0:
                a, b = labels.get(label[s], (0, 0))
                labels[label[s]] = (a + n, b + 1)
        ranked = sorted(files.items(), key=lambda x: (-x[1], x[0]))[: len(files) if top is None else top]
        want[e] = {"n": len(held), "depth": max(depth[n] for n in known), "projects": sorted({p for n in known for p in projects[n]}), "files": [f for f, _ in ranked], "counts": [n for _, n in ranked],
                   "labels": sorted(labels), "label_counts": [labels[k][0] for k in sorted(labels)], "label_files": [labels[k][1] for k in sorted(labels)]}
    assert got == want and len(want) > 40
