"""Path suffixes, line bins, blame by lines and global ranks against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from impactloom.durable import Scratch
from impactloom.functions import spans, textdiff
from impactloom.operators import cutvertex, ranking, reach
from impactloom.sources import git
from impactloom.sources.derive import GraphSource

SF = "/root/testdata/sf0.001"
DEFS = "id long, name string, file_path string, start_line long, end_line long"


def test_files_are_found_by_whole_suffixes_of_segments(spark):
    paths = ["a/b/mod.rs", "b/mod.rs", "x\\b\\mod.rs", "ab/mod.rs", "mod.rs", "/abs/mod.rs", "other.rs", None]
    indexed = spark.createDataFrame([(p,) for p in paths], "file_path string")
    changed = spark.createDataFrame([("b/mod.rs",), ("mod.rs",), ("zz/b/mod.rs",), (None,)], "base string")
    got = {(r.base, r.file_path) for r in spans.files_of(changed, indexed).collect()}
    assert got == {(b, p) for b in ("b/mod.rs", "mod.rs", "zz/b/mod.rs") for p in paths if p and (p.replace("\\", "/") == b or p.replace("\\", "/").endswith("/" + b))}


def test_ranges_meet_once_like_a_comparison_of_all(spark):
    r = random.Random(2)
    defs = [(k, f"n{k}", r.choice(["a/f.rs", "b/f.rs", "g.rs"]), s, s + r.choice([0, 3, 63, 64, 200, 1000, -5])) for k in range(150) for s in [r.randrange(1, 500)]] + [(900, "x", "g.rs", None, 5), (901, "y", None, 1, 5)]
    ranges = [(k, r.choice(["f.rs", "a/f.rs", "g.rs"]), lo, lo + r.choice([0, 1, 64, 300])) for k in range(60) for lo in [r.randrange(1, 600)]] + [(99, "g.rs", None, 4)]
    met = spans.meeting(spark.createDataFrame(defs, DEFS), spark.createDataFrame(ranges, "event_id long, base string, lo long, hi long")).select("event_id", "id").collect()
    want = sorted((e, d[0]) for e, b, lo, hi in ranges if lo is not None for d in defs if d[2] and d[3] is not None and (d[2] == b or d[2].endswith("/" + b)) and d[3] <= hi and d[4] >= lo)
    assert sorted(map(tuple, met)) == want
    lines = spark.createDataFrame([("./f.rs", 10), ("./f.rs", 12)], "path string, line long")
    got = {r.name for r in textdiff.changed_symbols(lines, spark.createDataFrame(defs, DEFS)).collect()}
    assert got == {d[1] for d in defs if d[2] in ("a/f.rs", "b/f.rs") and d[3] <= 12 and d[4] >= 10}


def test_no_join_on_a_basename_is_planned(spark):
    g = GraphSource(spark, SF)
    ranges = g.sql("SELECT id AS event_id, file_path AS base, start_line AS lo, start_line AS hi FROM gl_definition")
    plan = spans.meeting(g.table("gl_definition"), ranges)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert any("suffix" in x for x in joins) and any("_bin" in x and "_file" in x for x in joins) and "element_at" not in plan


def test_blame_by_lines_equals_a_count_line_by_line(spark):
    r = random.Random(4)
    lines = [(p, n, f"d{r.randrange(4)}") for p in ("a.rs", "b\\c.rs") for n in range(1, 700)]
    defs = [(k, "n", r.choice(["a.rs", "b/c.rs", "none.rs"]), s, s + r.choice([0, 1, 62, 63, 64, 128, 400, 5000])) for k in range(80) for s in [r.randrange(0, 650)]]
    defs += [(200, "n", "a.rs", None, 3), (201, "n", "a.rs", 9, 8), (202, "n", None, 1, 8), (203, "n", "a.rs", 64, 127), (204, "n", "a.rs", 64, 128)]
    got = {(r.definition_id, r.author_email): r.lines for r in spans.blamed(spark.createDataFrame(defs, DEFS), spark.createDataFrame(lines, "path string, line long, author_email string")).collect()}
    want: dict = {}
    for d in defs:
        if d[2] and d[3] is not None and 1 <= d[3] <= d[4]:
            for p, n, a in lines:
                if p.replace("\\", "/") == d[2] and d[3] <= n <= d[4]:
                    want[d[0], a] = want.get((d[0], a), 0) + 1
    assert got == want


def test_blame_lines_of_porcelain(spark):
    sha = "0123456789abcdef0123456789abcdef01234567"
    text = (f"{sha} 3 1 2\nauthor Ann\nauthor-mail <Ann@X.y>\nsummary {sha} 9 9\nfilename f\n\t{sha} 5 5\n{sha} 4 2\nauthor Bob B\nauthor-mail <>\n\tauthor-mail <no@x.y>\n"
            f"{sha} 9 3\nauthor \nauthor-mail <>\n\t\n{sha} 9 4\nauthor Ann\nauthor-mail <Ann@X.y>\n\tlast")
    rows = git.blame_lines(spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "path string, text string")).collect()
    assert sorted(map(tuple, rows)) == [("f", 1, "ann@x.y"), ("f", 2, "Bob B"), ("f", 3, "unknown"), ("f", 4, "ann@x.y")]


@pytest.mark.parametrize("values", [[5, 1, 1, None, 9, 5, 5, None, 2], [3], [], [4] * 50, list(range(200)) + [7] * 300])
def test_percent_ranks_equal_the_window(spark, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v long")
    got = ranking.percent_ranks(rows, Scratch(spark, "t"), "v", "share")
    want = rows.selectExpr("id", "v", "percent_rank() OVER (ORDER BY v) AS share")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_ordered_starts_equal_a_window_over_all(spark):
    rows = spark.range(2000).select(((F.col("id") * 7919) % 2003).alias("k"), (F.col("id") % 5).alias("n"))
    got = ranking.ordered_starts(rows, Scratch(spark, "t"), [F.desc("k")], "n", "before").orderBy("k").collect()
    want = rows.selectExpr("k", "n", "coalesce(sum(n) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before").orderBy("k").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_cut_vertices_of_long_graphs_take_few_rounds(spark, monkeypatch):
    size, r, tables = 6000, random.Random(1), []
    label = list(range(size))
    r.shuffle(label)
    half = size // 2
    path = [(1, label[k], label[k + 1]) for k in range(size - 1)]
    ladder = [(2, label[k], label[k + 1]) for k in range(size - 1) if k != half - 1] + [(2, label[k], label[half + k]) for k in range(half)]
    hung = [(3, k, k + 1) for k in range(50)] + [(3, 50, 40), (3, 10, 0), (3, 10, 90), (3, 90, 91), (3, 91, 10), (3, 500, 501)]
    real = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, **more: tables.append(name) or real(self, df, name, **more))
    edges = spark.createDataFrame(path + ladder + hung, "event_id long, source_id long, target_id long")
    got = sorted(tuple(x) for x in cutvertex.chokepoints(edges, Scratch(spark, "t"), one_task=0).collect())
    want = sorted((event, *x) for event, part in ((1, path), (2, ladder), (3, hung)) for x in cutvertex.cut_vertices([(a, b) for _, a, b in part]))
    assert got == want and sum(x.rpartition("-")[2].isdigit() for x in tables) <= 60


def _reached(rows):
    """Places by brute force: rows (event, chunk, depth, places, files, projects)."""
    out = {}
    for event, chunk, depth, places, files, projects in rows:
        held = out.setdefault((event, chunk), [0, set(), set(), set()])
        held[0] = max(held[0], depth)
        for k, values in enumerate((places, files, projects), 1):
            held[k] |= set(values)
    want = {}
    for (event, chunk), (depth, places, files, projects) in out.items():
        counts = {f: 0 for f in files}
        for p in places:
            counts[max(f for f in files if f <= p)] += 1
        want[event, chunk] = (len(places), depth, sorted(projects), [(f + chunk * reach.CHUNK, counts[f]) for f in sorted(files)])
    return want


@pytest.mark.parametrize("size,held,flags", [(7, 10**6, 1 << 27), (1, 30, 1 << 27), (5, 3, 0), (1000, 10**6, 0)])
def test_union_of_reach_equals_sets(monkeypatch, size, held, flags):
    import pyarrow as pa

    monkeypatch.setattr(reach, "HELD", held)
    monkeypatch.setattr(reach, "FLAGS", flags)
    r, rows = random.Random(9), []
    starts = [0, 3, 4, 20, 500, 8000]
    for event in range(40):
        for chunk in range(r.randrange(1, 4)):
            for _ in range(r.randrange(1, 6)):
                places = sorted(r.sample(range(12_000), r.randrange(1, 30)))
                rows.append((event * 10**12, chunk, r.randrange(1, 9), places, sorted({max(s for s in starts if s <= p) for p in places}), [x * 10**11 for x in r.sample(range(9), r.randrange(0, 3))]))
    schema = pa.schema([("event_id", pa.int64()), ("chunk", pa.int64()), ("depth", pa.int32()), ("places", pa.list_(pa.int32())), ("files", pa.list_(pa.int32())), ("projects", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows[k : k + size]], schema=schema) for k in range(0, len(rows), size)]
    got = [x for b in reach._unite(iter(batches)) for x in b.to_pylist()]
    want = _reached(rows)
    assert len(got) == len(want)
    for x, (key, w) in zip(got, want.items()):
        assert (x["event_id"], x["n"], x["depth"], x["projects"], list(zip(x["files"], x["counts"]))) == (key[0], *w)


def test_places_follow_files_and_chunks_hold_whole_files(spark):
    g = GraphSource(spark, SF)
    rows = reach.numbered(g.table("gl_definition"), Scratch(spark, "t")).orderBy("place").collect()
    assert [x.place for x in rows] == list(range(200)) and [x.file_path for x in rows] == sorted(x.file_path for x in rows)
    first = {}
    for x in rows:
        assert x.file == first.setdefault(x.file_path, x.place) and x.chunk == x.file // reach.CHUNK
