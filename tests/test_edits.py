"""Verdicts of events against brute force, code changes, ownership, compaction, fallback of sources."""

from __future__ import annotations

import random

import pytest
from test_core import brute_cuts

from impactloom.durable import Scratch
from impactloom.functions import textdiff
from impactloom.operators import centrality, history, scoring
from impactloom.operators.impact import Impact
from impactloom.sources.tables import GraphTables, first_alive
from impactloom.streaming import intake
from pyspark.sql import functions as F


def test_verdicts_of_events_equal_brute_force(spark):
    r = random.Random(11)
    defs = [(i, f"n{i % 23}", f"crates/{'auth' if i % 7 == 0 else 'x'}/m{i % 5}.rs", i % 4) for i in range(40)]
    calls = [(r.randrange(44), r.randrange(40)) for _ in range(60)]
    events = [(e, f"n{r.randrange(23)}", r.choice(["cosmetic", "body-edit", "contract-break"])) for e in range(25) for _ in range(2)]
    d = spark.createDataFrame([(i, n, p, q, 1, 2) for i, n, p, q in defs], "id long, name string, file_path string, project_id long, start_line long, end_line long")
    got = {x.event_id: x for x in Impact(spark.createDataFrame(events, "event_id long, changed_symbol string, edit_class string"), d, spark.createDataFrame(calls, "source_id long, target_id long")).verdicts().collect()}
    assert set(got) == {e for e, _, _ in events}
    by_id = {i: (n, p, q) for i, n, p, q in defs}
    worst = {"cosmetic": 0, "body-edit": 1, "contract-break": 2}
    for e, row in got.items():
        names = {n for x, n, _ in events if x == e}
        seeds = {i for i, n, _, _ in defs if n in names}
        level, reached = seeds, {}
        for depth in range(1, 9):
            level = {s for s, t in calls if t in level}
            reached |= {s: depth for s in level}
        known = {i: k for i, k in reached.items() if i in by_id}
        closure = set(seeds)
        while more := {s for s, t in calls if t in closure} - closure:
            closure |= more
        cuts = sorted(((-iso, -parts, i) for i, iso, parts in brute_cuts([(s, t) for s, t in calls if s in closure and t in closure]) if iso > 0))[:20]
        named = list(dict.fromkeys(by_id[i][0] for _, _, i in cuts if i in by_id))[:5]
        first = {n: next(i for _, _, i in cuts if i in by_id and by_id[i][0] == n) for n in named}
        assert (row.total_dependents, row.affected_services, row.max_depth) == (len(known), len({by_id[i][2] for i in known}), max(known.values(), default=0))
        assert (row.n_cuts, row.changed_cut) == (len(named), any(i in seeds for i in first.values()))
        assert row.edit_class == max((c for x, _, c in events if x == e), key=worst.get)
    caught = scoring.catches(spark.createDataFrame(list(got.values()))).collect()
    want = sorted((x for x in got.values() if x.action in ("BLOCK", "SENIOR_REVIEW") or x.edit_class == "contract-break"), key=lambda x: (-x.total_dependents, x.event_id))[:6]
    assert [c.event_id for c in caught] == [w.event_id for w in want]


def test_signatures_and_spans_of_awkward_texts():
    deep = "fn f(" + "(" * 50_000 + ")" * 50_000 + ") {" + "{" * 50_000
    assert textdiff._signature(deep, "f").endswith(")) ") and textdiff._spans(deep) == [{"name": "f", "start": 1, "end": 1}]
    assert textdiff._signature("def f(a): return {1: 2}", "f") == "def f(a)" and textdiff._signature("fn f(a", "f") == "fn f(a" and textdiff._signature("fn f<T>", "f") is None
    assert textdiff._spans("function prose about things {") == [] and textdiff._spans(None) == [] and textdiff._signature(None, "f") is None
    assert textdiff._spans("} fn a() {\n fn b() {}\n") == [{"name": "a", "start": 1, "end": 3}, {"name": "b", "start": 2, "end": 2}]


def test_changed_files_match_by_suffix_and_lines_between_hunks_are_not_changed(spark):
    d = spark.createDataFrame([("a", "repo/src/a.rs", 1, 9), ("b", "src/b.rs", 1, 9), ("c", "other_src/a.rs", 1, 9), ("d", "src/a.rs", 20, 30)], "name string, file_path string, start_line long, end_line long")
    lines = spark.createDataFrame([("./src/a.rs", 3), ("src\\a.rs", 5)], "path string, line long")
    assert {r.name for r in textdiff.changed_symbols(lines, d).collect()} == {"a"}
    files = spark.createDataFrame([(1, "x.rs", "fn a() {\n1\n}\nfn b() {\n2\n}\nfn c() {\n3\n}\n")], "event_id long, path string, new_text string")
    hunks = spark.createDataFrame([(1, "x.rs", 2, 2), (1, "x.rs", 8, 8)], "event_id long, path string, lo long, hi long")
    assert {r.name for r in textdiff.changed_functions(files, hunks).collect()} == {"a", "c"}


def test_author_labels_go_on_past_z(spark):
    rows = spark.range(1, 704).select("id", history.author_label(F.col("id").cast("int")).alias("l")).collect()
    labels = {r.id: r.l for r in rows}
    assert [labels[i] for i in (1, 26, 27, 52, 53, 702)] == ["Author A", "Author Z", "Author AA", "Author AZ", "Author BA", "Author ZZ"] and len(set(labels.values())) == 703


def test_compaction_keeps_what_upserts_amount_to(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for batch in range(5):
        intake.upsert(spark, spark.createDataFrame([(1, batch), (10 + batch, batch)], "event_id long, v int"), folder, ["event_id"], batch)
    read = lambda: sorted((r.event_id, r.v) for r in intake.current(spark, folder, ["event_id"]).collect())
    before = read()
    intake.compact(spark, folder, ["event_id"])
    intake.compact(spark, folder, ["event_id"])
    assert read() == before and [e[:2] for e in intake.Versions(spark, folder).entries()] == [(0, 3), (4, 4)]
    assert len(list((tmp_path / "data").glob("[0-9a-f]*"))) == 2


@pytest.mark.parametrize("step", ["_write", "_commit", "_clear"])
@pytest.mark.parametrize("late", [False, True])
def test_a_step_that_breaks_off_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, step, late):
    folder, keys = f"file://{tmp_path}", ["event_id"]
    rows = lambda batch: spark.createDataFrame([(batch, f"own {batch}"), (7, f"last {batch}")], "event_id long, v string")
    read = lambda: sorted((r.event_id, r.v) for r in intake.current(spark, folder, keys).collect())
    want = lambda n: sorted([(k, f"own {k}") for k in range(n)] + [(7, f"last {n - 1}")])
    real = getattr(intake.Versions, step)

    def broken(self, *args):
        if late:
            real(self, *args)
        raise OSError("lost")

    for batch in range(4):
        if step != "_clear":
            monkeypatch.setattr(intake.Versions, step, broken)
            with pytest.raises(OSError):
                intake.upsert(spark, rows(batch), folder, keys, batch)
            monkeypatch.setattr(intake.Versions, step, real)
        intake.upsert(spark, rows(batch), folder, keys, batch)
        assert read() == want(batch + 1)
    monkeypatch.setattr(intake.Versions, step, broken)
    with pytest.raises(OSError):
        intake.compact(spark, folder, keys)
    monkeypatch.setattr(intake.Versions, step, real)
    assert read() == want(4)
    intake.upsert(spark, rows(3), folder, keys, 3)  # replayed, the newest
    intake.upsert(spark, rows(1), folder, keys, 1)  # and one that may be compacted
    assert read() == want(4)
    intake.compact(spark, folder, keys)
    intake.upsert(spark, rows(2), folder, keys, 2)
    assert read() == want(4) and len(list((tmp_path / "data").glob("[0-9a-f]*"))) == len(intake.Versions(spark, folder).entries()) == 2


def test_the_first_source_alive_is_taken_and_none_is_made_up(spark):
    d = "id long, name string, fqn string, definition_type string, file_path string, project_id long, start_line long, end_line long"
    edges = spark.createDataFrame([], "source_id long, target_id long, relationship_kind string")
    empty = GraphTables(spark, {"gl_definition": spark.createDataFrame([], d), "gl_edge": edges})
    full = GraphTables(spark, {"gl_definition": spark.createDataFrame([(1, "a", "a", "Function", "f", 1, 1, 2)], d), "gl_edge": edges})
    assert first_alive(empty, full) is full
    with pytest.raises(ValueError, match="no definitions"):
        first_alive(empty)


def test_ranks_are_kept_across_batches(spark):
    d = "id long, name string, fqn string, definition_type string, file_path string, project_id long, start_line long, end_line long"
    edges = spark.createDataFrame([(2, 1, "CALLS"), (3, 1, "CALLS"), *((i, 2, "CALLS") for i in range(4, 20))], "source_id long, target_id long, relationship_kind string")
    g = GraphTables(spark, {"gl_definition": spark.createDataFrame([(i, f"n{i}", "f", "Function", "f", 1, 1, 2) for i in range(1, 20)], d), "gl_edge": edges})
    state = intake.GraphState(g)
    one = state.impact(spark.createDataFrame([(7, "n2", "body-edit")], "event_id long, changed_symbol string, edit_class string")).ranked_keystones().collect()
    assert [(r.event_id, r.name, r["rank"], r.pagerank_rank) for r in one] == [(7, "n2", 1, 1)] and state.ranks() is state.ranks()


def test_ranks_follow_the_version_of_the_graph(spark, tmp_path, monkeypatch):
    class Graph:
        def __init__(self, pairs):
            self.spark, self.pairs = spark, pairs

        def table(self, name):
            return spark.createDataFrame(self.pairs, "source_id long, target_id long")

    r = random.Random(3)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(300)]
    run = lambda p: {x.id: x for x in intake.GraphState(Graph(p), f"file://{tmp_path}/state").scores().collect()}
    first, calls = run(pairs), []
    real = centrality.pagerank
    monkeypatch.setattr(centrality, "pagerank", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert run(pairs[::-1]) == first and not calls  # the same edges in another order, another driver
    grown = pairs + [(3, 99), (4, 5)]
    warm, fresh = run(grown), {x.id: x for x in real(Graph(grown).table(""), Scratch(spark, "t")).collect()}
    assert calls == [1] and warm.keys() == fresh.keys() and all(abs(warm[i].score - fresh[i].score) < 1e-8 for i in fresh)
    assert warm[3].rounds < fresh[3].rounds
    start = spark.createDataFrame([(x.id, x.score) for x in first.values()], "id long, score double")
    many = {x.id: x for x in real(Graph(grown).table(""), Scratch(spark, "t"), one_task=0, start=start, rounds=6).collect()}
    one = {x.id: x for x in real(Graph(grown).table(""), Scratch(spark, "t"), start=start, rounds=6).collect()}
    assert all(abs(many[i].score - one[i].score) < 1e-12 for i in one)


def test_single_point_is_a_label_unless_identities_are_asked_for(spark):
    defs = spark.createDataFrame([(1, 10, "f", 9, 3.0), (1, 11, "g", 2, 1.0)], "event_id long, id long, name string, inbound long, weight double")
    blame = spark.createDataFrame([(10, "zoe@x.y", 9), (10, "ann@x.y", 1), (11, "ann@x.y", 4)], "definition_id long, author_email string, lines long")
    shown, named = (history.ownership_report(defs, blame, who).first() for who in (False, True))
    assert (shown.spof_author, shown.owners, shown.spof_symbol) == ("Author A", "Author A,Author B", "f")
    assert (named.spof_author, named.owners) == ("zoe@x.y", "zoe@x.y,ann@x.y")
