"""Services exposed to findings: shared with the event's traversal, or walked for the symbol alone."""

from __future__ import annotations

import datetime as dt

from impactloom.operators.impact import Impact
from impactloom.operators import scoring
from impactloom.plans import verdicts


class Source:
    def __init__(self, **tables):
        self.tables = tables

    def table(self, name):
        return self.tables[name]


def _source(spark):
    # d4 calls d3 calls d2 calls d1; projects 1 to 3, and 4 without a row; a second definition is named a.
    d = spark.createDataFrame([(1, "a", "p/x.rs", 1), (2, "b", "p/y.rs", 2), (3, "c", "q/z.rs", 3), (4, "e", "q/w.rs", 4), (5, "a", "q/v.rs", None)], "id long, name string, file_path string, project_id long")
    return Source(gl_definition=d, gl_calls=spark.createDataFrame([(2, 1), (3, 2), (4, 3), (3, 5)], "source_id long, target_id long"),
                  gl_project=spark.createDataFrame([(1, "g/core"), (2, "g/auth"), (3, "g/web")], "id long, full_path string"),
                  gl_job=spark.createDataFrame([(1, "deploy", "success", dt.datetime(2024, 1, 1)), (1, "deploy", "success", dt.datetime(2024, 2, 1)), (2, "deploy", "failed", dt.datetime(2024, 3, 1)),
                                                (3, "build", "success", dt.datetime(2024, 3, 1))], "project_id long, job_type string, status string, created_at timestamp"))


def test_exposure_is_shared_where_the_event_changes_the_symbol(spark):
    source = _source(spark)
    events = spark.createDataFrame([(1, "a", "body-edit"), (1, "a", "body-edit"), (2, "b", "cosmetic")], "event_id long, changed_symbol string, edit_class string")
    found = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "a"), (3, 1, None), (3, 2, "nowhere")], "event_id long, nth int, affected_symbol string")
    impact = Impact(events, source.table("gl_definition"), source.table("gl_calls"))
    rows = verdicts.exposed(found, impact, source).collect()
    got = {(r.event_id, r.nth, r.project_id): (r.composed, r.is_deployed, r.last_deployment) for r in rows}
    last = dt.datetime(2024, 2, 1)
    own = {2: (False, False, None), 3: (False, False, None)}
    want = {(1, 0, p): (True, True, None) for p in (2, 3)}  # of the dependents, the symbol's own project is none
    want |= {(1, 1, p): v for p, v in own.items()}
    want |= {(e, 0, p): v for e in (2, 3) for p, v in {1: (False, True, last), **own}.items()}
    assert got == want and len(rows) == len(want)
    assert {(r.event_id, r.total_dependents) for r in impact.verdicts().collect()} == {(1, 3), (2, 2)}  # names of events are left as they were
    lineage = found.selectExpr("event_id", "nth", "affected_symbol", "5 AS steps", "event_id = 1 AND nth = 0 AS composed", "true AS critical", "0.5D AS confidence")
    out = {(r.event_id, r.nth): (r.services, r.critical, round(r.confidence, 2)) for r in verdicts.exposed_lineage(lineage, verdicts.exposed(found, impact, source)).collect()}
    assert out == {(1, 0): (2, True, 0.95), (1, 1): (2, True, 0.94), (2, 0): (3, True, 0.94), (3, 0): (3, True, 0.94), (3, 1): (0, False, 0.99), (3, 2): (0, False, 0.99)}


def test_no_findings_have_no_exposure(spark):
    source = _source(spark)
    events = spark.createDataFrame([], "event_id long, changed_symbol string, edit_class string")
    found = spark.createDataFrame([], "event_id long, nth int, affected_symbol string")
    assert verdicts.exposed(found, Impact(events, source.table("gl_definition"), source.table("gl_calls")), source).count() == 0


def test_authors_count_definitions_once(spark):
    reached = spark.createDataFrame([(1, "a", "f", 1), (2, "b", "f", None), (3, "c", "g", 2), (3, "c", "g", 2)], "id long, name string, file_path string, project_id long")
    authorship = spark.createDataFrame([("f", 7), ("f", 7), ("g", 7), ("g", 8), ("h", 9), ("g", 10)], "file_path string, user_id long")
    users = spark.createDataFrame([(7, "x"), (8, "y"), (9, "z")], "id long, username string")
    assert {tuple(r) for r in scoring.affected_authors(reached, authorship, users).collect()} == {(7, "x", 3, 2), (8, "y", 1, 1)}
