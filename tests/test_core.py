"""Tiny graphs with known answers, golden score vectors, and metamorphic checks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from impactloom.durable import Scratch
from impactloom.functions import paths, textdiff
from impactloom.operators import centrality, components, cutvertex, history, scoring, traverse
from impactloom.sources.derive import GraphSource
from impactloom.streaming import intake

SF = "/root/testdata/sf0.001"


def calls(spark, pairs):
    return spark.createDataFrame(pairs, "source_id long, target_id long")


def seeds(spark, *ids):
    return spark.createDataFrame([(1, i) for i in ids], "event_id long, id long")


@pytest.mark.parametrize("one_task", [traverse.ONE_TASK, 0])
def test_walks_are_sets_per_depth_and_cycles_end_at_the_bound(spark, one_task):
    g = calls(spark, [(2, 1), (3, 2), (1, 3), (4, 3)])
    rows = {(r.id, r.depth) for r in traverse.callers_by_depth(seeds(spark, 1), g, Scratch(spark, "t"), one_task=one_task).collect()}
    assert {d for i, d in rows if i == 1} == {3, 6}
    assert max(d for _, d in rows) == 8


def test_walks_and_closures_in_tasks_equal_those_in_rounds(spark):
    r = random.Random(3)
    g = calls(spark, [(r.randrange(60), r.randrange(60)) for _ in range(90)])
    many = spark.createDataFrame([(e, r.randrange(70)) for e in range(200) for _ in range(2)], "event_id long, id long").distinct()
    for f in (traverse.callers_by_depth, traverse.closure):
        a, b = (sorted(map(tuple, f(many, g, Scratch(spark, "t"), one_task=n).collect())) for n in (traverse.ONE_TASK, 0))
        assert a == b and len(a) > 500


@pytest.mark.parametrize("one_task", [traverse.ONE_TASK, 0])
def test_closure_has_seeds_and_terminates(spark, one_task):
    g = calls(spark, [(2, 1), (3, 2), (1, 3), (9, 8)])
    ids = {r.id for r in traverse.closure(seeds(spark, 1), g, Scratch(spark, "t"), one_task=one_task).collect()}
    assert ids == {1, 2, 3}
    nodes = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)], "event_id long, id long")
    assert traverse.induced_edges(nodes, g.unionByName(calls(spark, [(2, 1), (4, 3)]))).count() == 5


def test_walk_counts(spark):
    g = calls(spark, [(2, 1), (3, 1), (4, 2), (4, 3)])
    assert {(r.id, r.depth): r.walks for r in traverse.walk_counts(seeds(spark, 1), g, Scratch(spark, "t"), 3).where("id = 4").collect()} == {(4, 2): 2}


def brute_cuts(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def parts(without):
        seen, out = set(), []
        for s in near:
            if s in seen or s == without:
                continue
            stack, n = [s], 0
            seen.add(s)
            while stack:
                n += 1
                for o in near[stack.pop()]:
                    if o not in seen and o != without:
                        seen.add(o)
                        stack.append(o)
            out.append(n)
        return out

    before = len(parts(None))
    return {(n, len(near) - 1 - max(p), len(p)) for n in near if len(p := parts(n)) > before}


@pytest.mark.parametrize("seed", range(40))
def test_cut_vertices_equal_remove_and_recount(seed):
    r = random.Random(seed)
    pairs = [(r.randrange(14), r.randrange(14)) for _ in range(r.randrange(1, 22))]
    assert set(cutvertex.cut_vertices(pairs)) == brute_cuts(pairs)


def test_cut_vertices_of_path_star_and_limits():
    assert {n for n, _, _ in cutvertex.cut_vertices([(1, 2), (2, 3), (3, 4)])} == {2, 3}
    assert cutvertex.cut_vertices([(0, i) for i in range(1, 6)])[0] == (0, 4, 5)
    assert cutvertex.cut_vertices([]) == []


def choke(spark, events, one_task):
    rows = [(e, a, b) for e, pairs in events.items() for a, b in pairs]
    found = cutvertex.chokepoints(spark.createDataFrame(rows, "event_id long, source_id long, target_id long"), Scratch(spark, "t"), one_task).collect()
    return {e: {(r.id, r.isolated, r.parts) for r in found if r.event_id == e} for e in events}


def test_cut_vertices_by_rounds_equal_remove_and_recount(spark):
    r = random.Random(7)
    events = {e: [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(1, 2 * n))] for e, n in ((e, r.randrange(3, 26)) for e in range(30))}
    events = {e: [p for p in pairs if p[0] != p[1]] or [(0, 1)] for e, pairs in events.items()}
    want = {e: brute_cuts(pairs) for e, pairs in events.items()}
    assert choke(spark, events, 0) == want and choke(spark, events, 10**6) == want


def test_large_stars_and_barbells_have_their_cut_vertices(spark):
    n = 20_000
    star = [(0, i) for i in range(1, n)]
    # Two cycles' fans, joined by a path of one node.
    barbell = [(0, i) for i in range(2, n // 2)] + [(i, i + 1) for i in range(2, n // 2 - 1)]
    barbell = [*barbell, *((a + n, b + n) for a, b in barbell), (0, 1), (1, n)]
    side = n // 2 - 1
    want = {1: {(0, n - 2, n - 1)}, 2: {(1, side, 2), (0, side - 1, 2), (n, side - 1, 2)}}
    assert choke(spark, {1: star, 2: barbell}, 10**6) == want
    assert choke(spark, {1: star, 2: barbell}, 1000) == want


def test_pagerank_in_a_task_equals_rounds_and_ranks_are_global(spark):
    r = random.Random(5)
    g = calls(spark, [(r.randrange(40), r.randrange(50)) for _ in range(120)])
    scratch = Scratch(spark, "t")
    one, many = ({x.id: x.score for x in centrality.pagerank(g, Scratch(spark, "t"), rounds=9, one_task=n).collect()} for n in (10**6, 0))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-12 for i in one)
    done = centrality.pagerank(g, scratch, rounds=400)
    assert done.first().change < centrality.TOLERANCE and centrality.pagerank(g, Scratch(spark, "t"), rounds=2).first().change > centrality.TOLERANCE
    want = {i: n for n, (_, i) in enumerate(sorted((-x.score, x.id) for x in done.collect()), 1)}
    assert {x.id: x["rank"] for x in centrality.ranked(done, scratch).collect()} == want


def test_pagerank_counts_parallel_edges_and_keeps_mass(spark):
    g = calls(spark, [(1, 2), (1, 2), (1, 3), (4, 4)])
    s = {r.id: r.score for r in centrality.pagerank(g, Scratch(spark, "t")).collect()}
    assert abs(sum(s.values()) - 1) < 1e-9 and s[2] > s[3]
    path = {r.id: r.score for r in centrality.pagerank(calls(spark, [(1, 2), (2, 3), (3, 4)]), Scratch(spark, "t")).collect()}
    assert max(path, key=path.get) == 4


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_components(spark, one_task):
    e = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (8, 7), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(e, Scratch(spark, "t"), one_task=one_task).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def score(spark, parts, danger, k, conf, impact=True):
    d = spark.range(1).withColumn("p", F.array(*[F.lit(float(x)) for x in parts])).withColumn("risk", scoring.blended(F.col("p"), F.lit(float(danger))))
    d = d.withColumn("level", scoring.risk_level(F.col("risk")))
    r = d.withColumn("action", scoring.decision(F.col("level"), F.lit(k), F.lit(float(danger)), F.lit(impact), F.lit(conf))).first()
    return round(r.risk, 4), r.level, r.action


def test_golden_scores(spark):
    compile_ = [0.39, 0.85, 0.90, 0.85, 0.55]
    assert score(spark, compile_, 1, 1, 0.95) == (0.8232, "CRITICAL", "BLOCK")
    assert score(spark, compile_, 0.5, 1, 0.95) == (0.4116, "MEDIUM", "SENIOR_REVIEW")
    assert score(spark, compile_, 0, 1, 0.95) == (0.0, "LOW", "AUTO_APPROVE")
    assert score(spark, [0.45, 0.85, 0.90, 0.85, 0.55], 1, 2, 0.95)[1:] == ("CRITICAL", "BLOCK")
    assert score(spark, [0.05, 0.20, 0.85, 0.25], 1, 0, 0.95) == (0.645, "HIGH", "SENIOR_REVIEW")
    assert score(spark, [0.05, 0.20, 0.85, 0.25], 0.5, 0, 0.95) == (0.3225, "LOW", "AUTO_APPROVE")
    assert score(spark, [0.10, 0.20, 0.25, 0.25], 1, 0, 0.95) == (0.23, "LOW", "AUTO_APPROVE")
    assert [score(spark, [s], 1, 0, 0.95, False)[2] for s in (0.95, 0.80, 0.60, 0.30, 0.50)] == ["BLOCK", "BLOCK", "SENIOR_REVIEW", "REVIEW_REQUIRED", "REVIEW_REQUIRED"]


def test_confidence_is_double_arithmetic(spark):
    r = spark.range(1).select(scoring.impact_confidence(F.lit(1), F.lit(False)).alias("c")).first()
    assert r.c < 0.90


def test_scar_raises_failure_rate_by_its_cap_at_most(spark):
    f = lambda scar: spark.range(1).select(scoring.change_failure_rate(F.lit(1), F.lit(509), F.lit(True), F.lit(True), F.lit(scar)).alias("c")).first().c
    assert round(f(None), 6) == 0.39 and round(f(5.0) - f(None), 6) == 0.12


def test_paths(spark):
    d = spark.createDataFrame([("crates/Auth\\x/test_a.py",), ("src/a.pb.rs",), ("one",), (None,)], "p string")
    r = d.select(paths.module_of(F.col("p")).alias("m"), paths.is_test(F.col("p")).alias("t"), paths.is_generated(F.col("p")).alias("g"), paths.boundary(F.col("p")).alias("b"), paths.to_int(F.lit(" 7x")).alias("i")).collect()
    assert [(x.m, x.t, x.g, x.b, x.i) for x in r] == [("crates/Auth", True, False, "security", 0), ("src/a.pb.rs", False, True, None, 0), ("one", False, False, None, 0), ("", False, False, None, 0)]


def test_edit_semantics(spark):
    d = spark.createDataFrame([("rs", "a /* x */ b // c", "a\nb"), ("py", "x # y", "x"), ("py", "", ""), ("md", "a b", "a c")], "e string, o string, n string")
    assert [r.c for r in d.select(textdiff.is_cosmetic(F.col("o"), F.col("n"), F.col("e")).alias("c")).collect()] == [True, True, False, False]
    files = spark.createDataFrame([(1, "a.rs", "fn f(a: (i32, i32)) -> bool {", "fn f(a: i32) -> bool {"), (2, "b.rs", "fn f(a) {", "fn f( a ) {"), (3, "c.rs", "", "fn f(a) {"), (4, "d.rs", "fn f(a) {", "")],
                                  "event_id long, path string, old_text string, new_text string")
    names = spark.createDataFrame([(i, "f") for i in range(1, 5)], "event_id long, name string")
    assert {r.event_id for r in textdiff.contract_breaks(files, names).collect()} == {1, 4}
    e = spark.createDataFrame([(0, True, True), (1, True, True), (1, False, True), (1, False, False)], "n int, b boolean, c boolean")
    assert [r.x for r in e.select(textdiff.edit_class(F.col("n"), F.col("b"), F.col("c")).alias("x")).collect()] == ["unknown", "contract-break", "cosmetic", "body-edit"]


def test_diff_headers_and_changed_symbols(spark):
    diff = spark.createDataFrame([("./src\\a.rs", "@@ -1,2 +10,3 @@"), ("./src\\a.rs", "@@ -9 +30,0 @@")], "path string, header string")
    lines = textdiff.hunk_lines(diff)
    assert {r.line for r in lines.collect()} == {10, 11, 12, 30}
    defs = spark.createDataFrame([("f", "src/a.rs", 1, 10), ("g", "src/a.rs", 20, 25), ("h", "src/a.rs", 31, 40)], "name string, file_path string, start_line long, end_line long")
    assert {r.name for r in textdiff.changed_symbols(lines, defs).collect()} == {"f", "g"}
    text = spark.createDataFrame([("fn a() {\n x\n}\ndef b():\n  y\n",)], "t string")
    assert [(s.name, s.start, s.end) for s in text.select(textdiff.function_spans("t").alias("s")).first().s] == [("a", 1, 3)]


def test_commit_kinds(spark):
    subjects = ['Revert "x"', "hotfix: y", "roll back", "fix crash", "fix typo", "fix information schema", "feat"]
    d = spark.createDataFrame([(s,) for s in subjects], "s string")
    assert [r.k for r in d.select(history.commit_kind(F.col("s")).alias("k")).collect()] == ["revert", "hotfix", "hotfix", "fix", None, None, None]


def test_throttle_and_routing(spark):
    e = spark.createDataFrame([(1, f"2024-01-01 00:00:{i:02d}") for i in range(15)], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.n, r.allowed) for r in intake.throttle(e).collect()] == [(15, 10)]
    k = spark.createDataFrame([("x.mr_opened",), ("finding_created",), ("other",)], "event_type string")
    assert [r.kind for r in intake.route(k).collect()] == ["change", "finding", "unknown"]


def test_streaming_scores_micro_batches(spark, tmp_path):
    from impactloom.operators.impact import Impact

    (tmp_path / "in").mkdir()
    g = GraphSource(spark, SF)
    name = g.sql("SELECT name FROM gl_definition WHERE id = 8").first().name
    (tmp_path / "in/a.json").write_text(f'{{"event_id": 5, "event_type": "mr_opened", "payload": {{"changed_symbols": ["{name}"], "edit_class": "cosmetic"}}}}\n')
    score = lambda batch: Impact(batch, g.table("gl_definition"), g.table("gl_calls")).verdicts()
    q = intake.score_stream(intake.read_events(spark, str(tmp_path / "in")), score, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    rows = intake.current(spark, str(tmp_path / "out"), ["event_id"]).collect()
    assert [(r.event_id, r.total_dependents, r.level) for r in rows] == [(5, 37, "LOW")]
    # A cosmetic edit is approved without review only where the confidence allows it.
    assert rows[0].action == ("AUTO_APPROVE" if rows[0].confidence >= 0.9 else "REVIEW_REQUIRED")


def test_same_event_other_edit_class_other_action(spark):
    from impactloom.operators.impact import Impact

    g = GraphSource(spark, SF)
    act = lambda edit: Impact(g.sql(f"SELECT CAST(1 AS BIGINT) AS event_id, name AS changed_symbol, '{edit}' AS edit_class FROM gl_definition WHERE id = 1"), g.table("gl_definition"), g.table("gl_calls")).verdicts().first()
    strict, cosmetic = act("contract-break"), act("cosmetic")
    assert strict.total_dependents == 200 and strict.risk > cosmetic.risk and strict.action != cosmetic.action
