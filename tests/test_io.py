"""Sources, typed queries, verdicts of mixed events, renderers and sinks on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from impactloom.__main__ import main
from impactloom.operators import history
from impactloom.plans.typed import GraphQueries
from impactloom.plans.verdicts import Scored, change_of, compose_lenses
from impactloom.sinks import output, render
from impactloom.sources import events, git
from impactloom.sources.tables import GraphTables


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.createDataFrame([(1, "root", "c::root", "Function", "crates/auth/a.rs", 1, 1, 9), (2, "mid", "c::mid", "Function", "crates/auth/b.rs", 1, 1, 9),
                               (3, "leaf", "c::leaf", "Function", "crates/x/tests/c.rs", 2, 1, 9), (4, "lone", "c::lone", "Class", "crates/x/d.rs", 2, 20, 30), (5, "root", "d::root", "Function", "crates/y/e.rs", 2, 1, 2)],
                              "id long, name string, fqn string, definition_type string, file_path string, project_id long, start_line long, end_line long")
    e = spark.createDataFrame([(2, 1, "CALLS"), (3, 2, "CALLS"), (3, 2, "CALLS"), (4, 1, "IMPORTS"), (None, 1, "CALLS")], "source_id long, target_id long, relationship_kind string")
    out = {"gl_definition": d, "gl_edge": e}
    out["gl_project"] = spark.createDataFrame([(1, "auth", "g/auth"), (2, "x", "g/x")], "id long, name string, full_path string")
    out["gl_user"] = spark.createDataFrame([(7, "ann", "Ann")], "id long, username string, name string")
    out["gl_merge_request"] = spark.createDataFrame([(70, "t", "merged", "main", 7, "2024-01-01")], "id long, title string, state string, target_branch string, author_id long, created_at string")
    out["gl_definition_history"] = spark.createDataFrame([(1, 71, "2024-02-01", False), (1, 70, "2024-01-01", True)], "definition_id long, merge_request_id long, created_at string, is_intro boolean")
    out["gl_finding"] = spark.createDataFrame([(9, "hole", "HIGH", 1)], "id long, title string, severity string, affected_definition_id long")
    out["gl_job"] = spark.createDataFrame([(1, "deploy", "success", "2024-03-01"), (2, "deploy", "failed", "2024-03-01")], "project_id long, job_type string, status string, created_at string")
    return out


@pytest.fixture(scope="module")
def folder(tables, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}.parquet")
    return str(root)


EVENTS = [
    {"event_id": "a", "event_type": "mr_opened", "payload": {"mr_id": "1", "changed_symbols": ["root"], "edit_semantics": {"edit_class": "contract-break"},
                                                             "findings": [{"finding_id": "f1", "severity": "LOW", "affected_symbol": "mid"}, {"finding_id": "f2", "title": "a|b", "severity": "CRITICAL", "affected_symbol": "root"}]}},
    {"event_id": "b", "event_type": "vulnerability.created", "payload": {"finding_id": "f3", "title": "t", "severity": "HIGH", "affected_symbol": "gone"}},
    {"event_id": "c", "event_type": "something else", "payload": {}},
    {"event_id": "d", "event_type": "mr_opened", "payload": {"changed_symbols": ["nowhere"]}},
]


def test_typed_queries(spark, tables):
    q = GraphQueries(GraphTables(spark, tables))
    assert tuple(q.query("transitive_dependents", symbols=["root"]).first()) == (2, 2, 2)
    assert tuple(q.query("transitive_dependents", symbols=["no such"]).first()) == (0, 0, 0)
    assert [tuple(r) for r in q.query("affected_services", symbols=["root"]).orderBy("service_id").collect()] == [("f1", "crates/auth/b.rs", 1, True, False), ("f2", "crates/x/tests/c.rs", 1, False, True)]
    assert {(r.area_id, r.area) for r in q.query("affected_owners", symbols=["root"]).collect()} == {("area-1", "crates/auth"), ("area-2", "crates/x")}
    assert {(r.id, r.inbound) for r in q.query("symbol_defs", symbols=spark.createDataFrame([("root",), ("root",)], "s string")).collect()} == {(1, 1), (5, 0)}
    assert q.query("symbol_definition", symbol="root").first().file_path == "crates/auth/a.rs"
    edges = [tuple(r) for r in q.query("subgraph_edges", symbols=["root"]).collect()]
    assert sorted(edges) == [(2, 1, False, True), (3, 2, False, False), (3, 2, False, False)]
    assert [r.name for r in q.query("direct_callers", symbols=["root", "it's"]).collect()] == ["mid"]
    calls = [(r.id, r.called_symbol, r.definition_type) for r in q.query("called_symbols", symbols=["mid", "root"]).collect()]
    assert calls == [(3, "mid", "Function"), (3, "mid", "Function"), (2, "root", "Function")] and q.query("called_symbols", symbols=["mid", "root"], limit=1).count() == 1
    assert {r.id for r in q.query("definitions_by_id", ids=[1, 4, 99]).collect()} == {1, 4}
    assert q.query("all_call_edges").count() == 3
    assert [r.id for r in q.query("ownership_centrality", least=1).collect()] == [2]
    assert tuple(q.query("lineage", finding_id=9).first()) == (9, "root", 1, 70, "ann")
    with pytest.raises(ValueError, match="unknown query"):
        q.query("nothing")


def test_json_requests(spark, tables):
    q = GraphQueries(GraphTables(spark, tables))
    node = {"entity": "Definition", "filters": {"name": {"op": "in", "value": ["mid", "leaf"]}, "id": {"op": "eq", "value": 3}}}
    assert [r.id for r in q.dsl({"query": {"query_type": "traversal", "node": node}}).collect()] == [3]
    path = {"query_type": "pathfinding", "start": {"entity": "Finding", "filters": {"id": {"op": "eq", "value": 9}}}, "end": {"entity": "User"}, "limit": 1}
    assert [r.author for r in q.dsl({"query": path}).collect()] == ["ann"]
    for bad in ({"query_type": "traversal", "node": {}}, {"query_type": "else"}, {"query_type": "traversal", "node": {"entity": "User", "filters": {"id": {"op": "gt", "value": 1}}}}):
        with pytest.raises(ValueError):
            q.dsl(bad)


def test_tables_are_checked(spark, tables, folder):
    assert set(GraphTables.from_folder(spark, folder).tables) == {*tables, "gl_calls"}
    assert GraphTables.from_folder(spark, folder).alive()
    with pytest.raises(ValueError, match="no table gl_edge"):
        GraphTables(spark, {"gl_definition": tables["gl_definition"]})
    with pytest.raises(ValueError, match="lacks name"):
        GraphTables(spark, {**tables, "gl_definition": tables["gl_definition"].drop("name")})
    with pytest.raises(ValueError, match="no table blame"):
        GraphTables(spark, tables).table("blame")


def test_log_blame_and_diff(spark, tmp_path, tables):
    log = "\x00".join(["", "c1\x1f2024-01-03\x1fRevert \"x\"\n\na.rs\nb.rs\n", "c2\x1f2024-01-02\x1ffix: crash\x1fhere\n\na.rs\n", "c3\x1fbad\x1f\n"])
    (tmp_path / "log").write_bytes(log.encode())
    commits, files = git.read_log(spark, str(tmp_path / "log"))
    assert [(r.commit_id, str(r.committed_at), r.subject) for r in commits.orderBy("seq").collect()] == [("c1", "2024-01-03", 'Revert "x"'), ("c2", "2024-01-02", "fix: crash\x1fhere"), ("c3", "None", "")]
    assert {tuple(r) for r in files.collect()} == {("c1", "a.rs"), ("c1", "b.rs"), ("c2", "a.rs")}
    assert [r.commit_id for r in git.mainline(commits, 1, 0).collect()] == ["c1"]
    changes = history.usable_changes(commits, files)
    assert {r.file_path: (r.reverts, r.fixes) for r in history.scars(changes).collect()} == {"a.rs": (1, 1), "b.rs": (1, 0)}
    assert [(r.file_path, r.kind) for r in history.receipts(changes).orderBy("file_path", "place").collect()] == [("a.rs", "revert"), ("a.rs", "fix"), ("b.rs", "revert")]
    porcelain = "h 1 1 1\nauthor A\nauthor-mail <A@x.y>\n\tauthor-mail <no@x.y>\nh 2 2\nauthor-mail <a@x.y>\n\tz\n"
    blame = git.blame_table(spark.createDataFrame([(1, porcelain), (2, None)], "definition_id long, text string"))
    assert [tuple(r) for r in blame.collect()] == [(1, "a@x.y", 2)]
    diff = ("diff --git a/crates/auth/a.rs b/crates/auth/a.rs\n--- a/crates/auth/a.rs\n+++ b/crates/auth/a.rs\n@@ -3,0 +4,2 @@ fn root\n+@@ -1 +1 @@\n+++x\n"
            "diff --git a/gone.rs b/gone.rs\n--- a/gone.rs\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n")
    new = "diff --git a/n.rs b/n.rs\n--- /dev/null\n+++ b/n.rs\n@@ -0,0 +1 @@\n+pub fn fresh() {}\n"
    diffs = spark.createDataFrame([(1, diff), (2, new), (3, ""), (4, None)], "event_id long, diff string")
    assert [tuple(r) for r in git.diff_headers(diffs).orderBy("event_id").collect()] == [(1, "crates/auth/a.rs", "@@ -3,0 +4,2 @@"), (2, "n.rs", "@@ -0,0 +1 @@")]
    assert {tuple(r) for r in change_of(diffs, tables["gl_definition"]).collect()} == {(1, "root"), (2, "fresh")}
    assert {r.path for r in git.changed_files(diffs, ("n",)).collect()} == {"crates/auth/a.rs"}
    assert [git.diff_base(s) for s in ({"diff_base_sha": "x", "target_branch": "m"}, {"target_branch": "m"}, {})] == ["x", "origin/m", "HEAD~1"]


def test_mixed_events(spark, tables):
    scored = Scored(events.read_json(spark, json.dumps(EVENTS)), GraphTables(spark, tables))
    v = {r.event_id: r for r in scored.verdicts().collect()}
    assert len(v) == 4 and v["a"].severity == "CRITICAL" and v["a"].total_dependents == 2 and v["a"].has_impact
    assert (v["b"].level, v["b"].action, v["b"].total_dependents) == ("CRITICAL", "BLOCK", None)
    assert (v["c"].level, v["c"].action) == ("UNKNOWN", "REVIEW_REQUIRED")
    assert v["d"].total_dependents == 0 and v["d"].has_impact
    lineage = {r.finding_id: r for r in scored.lineage.collect()}
    assert (lineage["f2"].author, lineage["f2"].composed, lineage["f2"].steps, round(lineage["f2"].confidence, 2)) == ("ann", True, 5, 0.95)  # what it shares looks up no deployment
    assert (lineage["f3"].steps, lineage["f3"].composed, round(lineage["f3"].confidence, 2)) == (2, False, 0.69)  # no service, so none without a deployment
    md = {r.event_id: r.markdown for r in render.render(scored.reports()).collect()}
    assert md["a"].startswith("# ") and "`crates/auth/b.rs`: 1 definitions, critical path" in md["a"] and "a\\|b" in md["a"] and "Callers to review" in md["a"] and 'N0["finding f1"]' in md["a"]
    assert "## Impact" not in md["b"] and "Finding f3" in md["b"] and "UNKNOWN" in md["c"]


def test_composing_given_lenses(spark):
    given = [{"event_id": "x", "edit_class": "contract-break", "impact": {"total_dependents": 509, "change_failure_rate": 0.39, "confidence": 0.95, "keystone_symbols": [{"name": "k"}]}, "ownership": {"risk_level": "HIGH"}, "compliance": {"risk_level": "MEDIUM"}},
             {"event_id": "y"}]
    r = {r.event_id: r for r in compose_lenses(events.read_json(spark, json.dumps(given), events.LENSES)).collect()}
    assert (round(r["x"].risk, 4), r["x"].level, r["x"].action) == (0.8232, "CRITICAL", "BLOCK")
    assert (r["y"].risk, r["y"].level, r["y"].action) == (None, "UNKNOWN", "REVIEW_REQUIRED")


def test_sinks(spark, tmp_path):
    reports = spark.createDataFrame([("1", "new"), ("2", "other")], "target string, markdown string")
    notes = spark.createDataFrame([("1", 5, output.MARKER + "\nold"), ("1", 4, "talk"), ("1", 6, output.MARKER), ("2", 8, None)], "target string, note_id long, body string")
    got = {r.target: (r.note_id, r.method, r.body) for r in output.comment_upserts(reports, notes).collect()}
    assert got == {"1": (5, "PUT", output.MARKER + "\nnew"), "2": (None, "POST", output.MARKER + "\nother")}
    output.write_markdown(reports.withColumnRenamed("target", "event_id"), str(tmp_path / "md"))
    assert "".join(p.read_text() for p in (tmp_path / "md" / "event_id=1").glob("part-*")).strip() == "new"
    blocked = spark.createDataFrame([("BLOCK",)], "action string")
    assert [output.exit_code(blocked, True), output.exit_code(blocked, False), output.exit_code(blocked.where("false"), True)] == [1, 0, 0]
    svg = render.risk_map_svg([{"name": "<f>", "total_callers": 9, "test_callers": 0, "untested": True}])
    assert "&lt;f&gt;" in svg and "#c62828" in svg and render.risk_map_svg([]).endswith("</svg>")
    assert [tuple(r) for r in render.tally(spark.createDataFrame([("BLOCK",), ("BLOCK",), ("X",)], "action string")).collect()] == [("BLOCK", 2, 2 / 3), ("X", 1, 1 / 3)]


def test_command_line(spark, folder, tmp_path, capsys):
    run = lambda *a: main(list(a), spark)
    assert run("verdict", "--tables", folder, json.dumps(EVENTS), "--enforce", "--markdown", str(tmp_path / "md")) == 1
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {r["event_id"] for r in rows} == {"a", "b", "c", "d"} and len(list((tmp_path / "md").glob("event_id=*"))) == 4
    assert run("query", "--tables", folder, "direct_callers", '{"symbols": ["mid"]}') == 0
    assert json.loads(capsys.readouterr().out)["name"] == "leaf"
    assert run("dsl", "--tables", folder, '{"query_type": "traversal", "node": {"entity": "User"}}') == 0
    assert "ann" in capsys.readouterr().out
    assert run("compose", '{"event_id": "x", "provenance": {"severity": "HIGH"}}') == 0
    assert json.loads(capsys.readouterr().out)["level"] == "CRITICAL"
    assert run("fragile", "--tables", folder) == 0 and run("risk-map", "--tables", folder, "--out", str(tmp_path / "m.svg")) == 0
    (tmp_path / "log").write_bytes(b"\x00c\x1f2024-01-01\x1fhotfix: y\na.rs\n")
    assert run("scars", str(tmp_path / "log")) == 0 and "a.rs" in capsys.readouterr().out
    assert run("verdict", "--tables", str(tmp_path / "none"), "[]") == 2
