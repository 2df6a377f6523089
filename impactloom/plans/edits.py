"""Queries over code changes: signatures, spans, edit classes, ownership, scars and boundaries.

Code is made up from definitions, a different form for each id modulo ``FORMS``; the SQL states what
each form must give, so it shares nothing with the scanners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..durable import Scratch
from ..functions import paths, textdiff
from ..operators import centrality, history, scoring, traverse
from ..operators.impact import Impact
from ..sources.derive import GraphSource

FORMS = 8
_NL = "chr(10)"

#: One text for each form: nested parentheses, braces in a Python body, generics, an unclosed list, prose, a nested body, an unclosed body, nothing.
_CODE = f"""SELECT id, name, CASE id % {FORMS}
    WHEN 0 THEN '// ' || file_path || {_NL} || 'pub fn ' || name || '(a: (int, int), b: str) -> bool {{ call(a) }}'
    WHEN 1 THEN 'def ' || name || '(a, b=(1, 2)): return {{1: 2}}' || {_NL}
    WHEN 2 THEN 'fn ' || name || '<T>(a: T,' || {_NL} || '    b: U) -> Option<T> {{' || {_NL} || '  if a {{ b }}' || {_NL} || '}}' || {_NL}
    WHEN 3 THEN 'function ' || name || '(a, (b'
    WHEN 4 THEN 'a function prose about ' || name || ' things {{ x }}'
    WHEN 5 THEN {_NL} || 'function ' || name || '(a) {{' || {_NL} || ' fn inner(b) {{ }}' || {_NL} || '}}; fn last(c) {{}}'
    WHEN 6 THEN 'fn ' || name || '(a); {{ {{' || {_NL} || 'x }}' || {_NL} || 'y'
    ELSE '' END AS text FROM gl_definition"""

#: An edit of each definition's file: a comment, a body, a type of a parameter, a removal, blanks, a rename, a new file, nothing left.
_EDITS = f"""SELECT id AS event_id, name, file_path AS path,
    CASE WHEN id % {FORMS} = 6 THEN '' ELSE 'fn ' || name || '(a: i32) -> bool {{' || {_NL} || '  a > 0' || {_NL} || '}}' || {_NL} || 'fn other(b: i32) {{' || {_NL} || '  b' || {_NL} || '}}' || {_NL} END AS old_text,
    CASE id % {FORMS}
    WHEN 0 THEN 'fn ' || name || '(a: i32) -> bool {{ // note' || {_NL} || '  a > 0' || {_NL} || '}}' || {_NL} || 'fn other(b: i32) {{' || {_NL} || '  b' || {_NL} || '}}' || {_NL}
    WHEN 1 THEN 'fn ' || name || '(a: i32) -> bool {{' || {_NL} || '  a > 1' || {_NL} || '}}' || {_NL} || 'fn other(b: i32) {{' || {_NL} || '  b' || {_NL} || '}}' || {_NL}
    WHEN 2 THEN 'fn ' || name || '(a: i64) -> bool {{' || {_NL} || '  a > 0' || {_NL} || '}}' || {_NL} || 'fn other(b: i32) {{' || {_NL} || '  b' || {_NL} || '}}' || {_NL}
    WHEN 3 THEN 'fn other(b: i32) {{' || {_NL} || '  b' || {_NL} || '}}' || {_NL}
    WHEN 4 THEN 'fn ' || name || '(a:i32)->bool{{' || {_NL} || {_NL} || 'a>0 }}' || {_NL} || 'fn other(b: i32) {{ b }}'
    WHEN 5 THEN 'fn renamed(a: i32) -> bool {{' || {_NL} || '  a > 0' || {_NL} || '}}' || {_NL} || 'fn other(b: i32) {{' || {_NL} || '  b' || {_NL} || '}}' || {_NL}
    WHEN 6 THEN 'fn ' || name || '(a: i32) -> bool {{' || {_NL} || '  a > 0' || {_NL} || '}}' || {_NL}
    ELSE '' END AS new_text,
    CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 1 END AS first_line, CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 9 ELSE 1 END AS last_line FROM gl_definition"""
_CODE, _EDITS = _CODE.replace("{{", "{").replace("}}", "}"), _EDITS.replace("{{", "{").replace("}}", "}")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GraphSource(spark, sf_dir).sql(_EDITS)


def signature_extract(spark, sf_dir):
    d = GraphSource(spark, sf_dir).sql(_CODE)
    return d.select("id", textdiff.readable(textdiff.signature("text", "name")).alias("signature"))


def function_spans(spark, sf_dir):
    d = GraphSource(spark, sf_dir).sql(_CODE)
    return d.select("id", F.explode(textdiff.function_spans("text")).alias("s")).select("id", "s.name", "s.start", "s.end")


def edit_classes(spark, sf_dir):
    """Edits of every class, contract breaks included."""
    e = _edits(spark, sf_dir)
    return textdiff.classify_changes(e.select("event_id", "path", "old_text", "new_text"), e.select("event_id", "name"))


def contract_breaks(spark, sf_dir):
    e = _edits(spark, sf_dir)
    return textdiff.contract_breaks(e.select("event_id", "path", "old_text", "new_text"), e.select("event_id", "name"))


def changed_functions(spark, sf_dir):
    """Functions of the new texts that hold a line of a hunk; half of the edits have one hunk above and one below."""
    e = _edits(spark, sf_dir)
    hunks = e.select("event_id", "path", F.col("first_line").alias("lo"), F.col("first_line").alias("hi")).unionByName(e.select("event_id", "path", F.col("last_line").alias("lo"), F.col("last_line").alias("hi")))
    return textdiff.changed_functions(e.select("event_id", "path", "new_text"), hunks)


def keystone_ranks(spark, sf_dir):
    """Keystones of all events with their PageRank ranks."""
    g = GraphSource(spark, sf_dir)
    scratch = Scratch(spark, "keystone-ranks")
    keys = scoring.keystones(g.table("mr_event"), centrality.degrees(g.table("gl_calls")), g.table("gl_definition"))
    # All rounds: ranks far down are told apart by less than the tolerance.
    ranks = centrality.ranked(centrality.pagerank(g.table("gl_calls"), scratch, tolerance=0.0), scratch)
    return scoring.with_ranks(keys, ranks, g.table("gl_definition")).select("event_id", "name", F.col("rank").cast("long").alias("rank"), "pagerank_rank")


def boundary_files(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    return scoring.boundary_files(Impact(g.table("mr_event"), g.table("gl_definition"), g.table("gl_calls")).top_files)


def near(g: GraphSource) -> DataFrame:
    """(event_id, path, weight): the files around what each event changes."""
    events, definitions, scratch = g.table("mr_event"), g.table("gl_definition"), Scratch(g.spark, "near")
    changed = traverse.changed_names(events, scratch)
    names = scratch.save(traverse.names_of(events, definitions), "names", release=False)
    return traverse.neighbourhood_of_events(changed, traverse.neighbourhood(names, g.table("gl_calls"), definitions), scratch)


def scars(g: GraphSource) -> DataFrame:
    """The scars of all files, written once."""
    return Scratch(g.spark, "scars").save(history.scars(history.usable_changes(g.table("git_commit"), g.table("git_commit_file"))), "scars")


def scar_contributors(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    changes = history.usable_changes(g.table("git_commit"), g.table("git_commit_file"))
    found = history.scar_contributors(near(g), scars(g), changes)
    # Ranks are left out: contributions that are equal but for rounding may change places between engines.
    return found.select("event_id", "path", "proximity", "weight", "reverts", "hotfixes", F.round("fix_density", 6).alias("fix_density"), F.round("intensity", 6).alias("intensity"),
                        F.round("contribution", 6).alias("contribution"), "receipts")


def scar_files(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    s = history.scars(history.usable_changes(g.table("git_commit"), g.table("git_commit_file")))
    return s.select("file_path", "total", "reverts", "hotfixes", "fixes", F.round("fix_density", 6).alias("fix_density"), F.round("intensity", 6).alias("intensity"))


def ranked_scars(spark, sf_dir):
    """The production files that history marks most."""
    g = GraphSource(spark, sf_dir)
    # Rounded first: intensities that are equal but for rounding may change places between engines.
    s = history.scars(history.usable_changes(g.table("git_commit"), g.table("git_commit_file"))).withColumn("intensity", F.round("intensity", 6))
    return history.ranked_scars(s).select("place", "file_path", "reverts", "hotfixes", "fixes", F.round("fix_density", 6).alias("fix_density"), "intensity")


#: Blamed lines of few authors: of each definition most lines are one author's, as in code that one person keeps.
_FEW = """SELECT l_partkey AS definition_id, 'dev' || CAST(CASE WHEN l_suppkey % 10 = 0 THEN 9 ELSE l_partkey % 3 END AS STRING) || '@example.com' AS author_email, CAST(sum(l_linenumber) AS BIGINT) AS lines
    FROM lineitem GROUP BY l_partkey, CASE WHEN l_suppkey % 10 = 0 THEN 9 ELSE l_partkey % 3 END"""


def _blast(g: GraphSource) -> tuple[DataFrame, DataFrame]:
    """What events touch, and its blamed lines."""
    impact = Impact(g.table("mr_event"), g.table("gl_definition"), g.table("gl_calls"))
    return impact.blast(), impact.blamed(g.sql(_FEW))


def single_points(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    return history.single_points(*_blast(g)).select("event_id", "id", "inbound", "author_email", F.round("share", 6).alias("share"))


def ownership_report(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    r = history.ownership_report(*_blast(g))
    # Labels are ranks of authors; which of two authors with equal lines comes first is a matter of rounding.
    return r.select("event_id", "definitions_blamed", "bus_factor", F.round("concentration", 6).alias("concentration"), F.size(F.split("owners", ",")).cast("long").alias("n_owners"),
                    F.size(F.split("reviewers", ",")).cast("long").alias("n_reviewers"), "spof_symbol", F.round("spof_share", 6).alias("spof_share"))


def service_map(spark, sf_dir):
    """Projects that depend on a symbol, directly or not."""
    g = GraphSource(spark, sf_dir)
    return scoring.service_map(_reached(g, 60, traverse.MAX_DEPTH), g.table("gl_project"))


def affected_authors(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    return scoring.affected_authors(_reached(g, 60, traverse.MAX_DEPTH), g.table("gl_file_authorship"), g.table("gl_user"))


def exposure_scope(spark, sf_dir):
    """For the symbol of each finding, the projects that reach it by up to ten calls, its own included, and their last deployment."""
    g = GraphSource(spark, sf_dir)
    found = g.sql("SELECT DISTINCT f.affected_definition_id AS event_id, d.name AS changed_symbol FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id")
    return scoring.exposure(found, g.table("gl_definition"), g.table("gl_calls"), g.table("gl_project"), g.table("gl_job"), Scratch(spark, "exposure"))


def _reached(g: GraphSource, id_: int, depth: int) -> DataFrame:
    event = g.sql(f"SELECT CAST(1 AS BIGINT) AS event_id, name AS changed_symbol FROM gl_definition WHERE id = {id_}")
    walked = traverse.callers_by_depth(traverse.seeds_of(event, g.table("gl_definition")), g.table("gl_calls"), Scratch(g.spark, "reached"), depth)
    return walked.select("event_id", "id").distinct().join(g.table("gl_definition").select("id", "name", "file_path", "project_id"), "id")


FUNCTIONS = [signature_extract, function_spans, edit_classes, contract_breaks, changed_functions, keystone_ranks, boundary_files, scar_contributors, scar_files, ranked_scars, single_points,
             ownership_report, service_map, affected_authors, exposure_scope]

_OLD = "'fn ' || name || '(a: i32) -> bool'"
_WALK60 = """seed AS (SELECT id FROM gl_definition WHERE name IN (SELECT name FROM gl_definition WHERE id = 60)),
    walk AS (SELECT DISTINCT e.source_id AS id, 1 AS depth FROM gl_calls e JOIN seed s ON e.target_id = s.id UNION SELECT e.source_id, w.depth + 1 FROM gl_calls e JOIN walk w ON e.target_id = w.id WHERE w.depth < 8),
    reached AS (SELECT DISTINCT d.id, d.name, d.file_path, d.project_id FROM walk JOIN gl_definition d ON d.id = walk.id)"""


def sql(event_walk: str, test: str, near: str, scars: str, marked: str, blast: str, keystones: str, pagerank: str, security: str, payments: str) -> dict[str, str]:
    """The same in SQL, on common parts of the catalogue's."""
    few = f"few AS ({_FEW})"
    blamed = blast.replace("JOIN blame ON", "JOIN few ON")
    lines = """li AS (SELECT event_id, bl.id, inbound, author_email, lines / sum(lines) OVER (PARTITION BY event_id, bl.id) AS share, row_number() OVER (PARTITION BY event_id, bl.id ORDER BY lines DESC, author_email) AS r FROM bl JOIN few ON definition_id = bl.id),
        sp1 AS (SELECT event_id, id, inbound, author_email, share FROM li WHERE r = 1 AND share >= 0.7 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY inbound DESC, share DESC, id) = 1)"""
    return {
        "signature_extract": f"""SELECT id, CASE id % {FORMS} WHEN 0 THEN 'fn ' || name || '(a: (int, int), b: str) -> bool' WHEN 1 THEN 'def ' || name || '(a, b=(1, 2))' WHEN 2 THEN 'fn ' || name || '<T>(a: T, b: U) -> Option<T>'
            WHEN 3 THEN 'function ' || name || '(a, (b' WHEN 5 THEN 'function ' || name || '(a)' WHEN 6 THEN 'fn ' || name || '(a)' END AS signature FROM gl_definition""",
        "function_spans": f"""SELECT id, name, CAST(1 AS INT) AS start, CAST(1 AS INT) AS "end" FROM gl_definition WHERE id % {FORMS} = 1 UNION ALL SELECT id, name, 1, 4 FROM gl_definition WHERE id % {FORMS} = 2
            UNION ALL SELECT id, name, 2, 4 FROM gl_definition WHERE id % {FORMS} = 5 UNION ALL SELECT id, 'inner', 3, 3 FROM gl_definition WHERE id % {FORMS} = 5 UNION ALL SELECT id, 'last', 4, 4 FROM gl_definition WHERE id % {FORMS} = 5
            UNION ALL SELECT id, name, 1, 3 FROM gl_definition WHERE id % {FORMS} = 6 UNION ALL SELECT id, name, 2, 2 FROM gl_definition WHERE id % {FORMS} = 0""",
        "edit_classes": f"""SELECT id AS event_id, CAST(1 AS BIGINT) AS files, CASE WHEN id % {FORMS} IN (0, 4) THEN 'cosmetic' WHEN id % {FORMS} IN (1, 6) THEN 'body-edit' ELSE 'contract-break' END AS edit_class,
            CAST(CASE WHEN id % {FORMS} IN (2, 3, 5, 7) THEN 1 ELSE 0 END AS BIGINT) AS broken FROM gl_definition""",
        "contract_breaks": f"""SELECT id AS event_id, file_path AS path, name, {_OLD} AS before, CASE WHEN id % {FORMS} = 2 THEN 'fn ' || name || '(a: i64) -> bool' END AS after FROM gl_definition WHERE id % {FORMS} IN (2, 3, 5, 7)""",
        # Lines 2, or 5 and 9 (none), or 1 of a text whose first function has lines 1 to 3 and whose other one 4 to 6, but for the forms that differ.
        "changed_functions": f"""SELECT id AS event_id, CASE WHEN id % {FORMS} = 5 THEN 'renamed' ELSE name END AS name FROM gl_definition WHERE id % 3 <> 1 AND id % {FORMS} NOT IN (3, 7)
            UNION ALL SELECT id, 'other' FROM gl_definition WHERE id % 3 = 1 AND id % {FORMS} IN (0, 1, 2, 5) UNION ALL SELECT id, 'other' FROM gl_definition WHERE id % 3 <> 1 AND id % {FORMS} = 3""",
        "keystone_ranks": f"""WITH {keystones}, pr AS ({pagerank}), k AS (SELECT DISTINCT m.event_id, f.rank, arg.name FROM mr_event m JOIN f ON f.name = lower(m.changed_symbol) JOIN (SELECT t.rank, d.name FROM t JOIN gl_definition d ON d.id = t.id) arg ON arg.rank = f.rank)
            SELECT k.event_id, k.name, k.rank, coalesce(min(pr.rank), 0) AS pagerank_rank FROM k JOIN gl_definition d ON d.name = k.name LEFT JOIN pr ON pr.id = d.id GROUP BY 1, 2, 3""",
        "boundary_files": f"""WITH RECURSIVE {event_walk}, b AS (SELECT event_id, file_path, CASE WHEN {security} THEN 'security' WHEN {payments} THEN 'payments' END AS c FROM files WHERE rank <= 6),
            n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY file_path) AS r FROM b WHERE c IS NOT NULL)
            SELECT event_id, string_agg(DISTINCT c, ',' ORDER BY c) AS crossed, string_agg(CASE WHEN r <= 5 THEN file_path END, ',' ORDER BY file_path) AS boundary_files FROM n GROUP BY 1""",
        "scar_contributors": f"""WITH {near}, sc AS ({scars}), {marked}, shown AS (SELECT file_path, least(count(*), 3) AS receipts FROM marked WHERE kind IS NOT NULL GROUP BY 1)
            SELECT near.event_id, near.path, CASE WHEN weight >= 1 THEN 'changed file' ELSE 'one hop away' END AS proximity, weight, reverts, hotfixes, round(fix_density, 6) AS fix_density, round(intensity, 6) AS intensity,
                   round(weight * intensity, 6) AS contribution, coalesce(shown.receipts, 0) AS receipts FROM near JOIN sc ON sc.file_path = near.path LEFT JOIN shown ON shown.file_path = near.path WHERE intensity > 0""",
        "ranked_scars": f"""WITH sc AS ({scars}), s AS (SELECT * REPLACE (round(intensity, 6) AS intensity) FROM sc)
            SELECT row_number() OVER (ORDER BY intensity DESC, reverts DESC, hotfixes DESC, file_path) AS place, file_path, reverts, hotfixes, fixes, round(fix_density, 6) AS fix_density, intensity
            FROM s WHERE intensity > 0 AND NOT {test} QUALIFY place <= 15""",
        "single_points": f"WITH RECURSIVE {few}, {blamed}, {lines} SELECT event_id, id, inbound, author_email, round(share, 6) AS share FROM sp1",
        "ownership_report": f"""WITH RECURSIVE {few}, {blamed}, {lines}, nb AS (SELECT event_id, count(*) AS n FROM bl WHERE id IN (SELECT definition_id FROM few) GROUP BY 1),
            o AS (SELECT event_id, coalesce(min(CASE WHEN cum > 0.5 THEN place END), count(*)) AS bus_factor, max(CASE WHEN place = 1 THEN share END) AS c, least(count(*), 6) AS n_owners, least(count(*), 4) AS n_reviewers FROM cu GROUP BY 1)
            SELECT o.event_id, nb.n AS definitions_blamed, bus_factor, round(c, 6) AS concentration, n_owners, n_reviewers, d.name AS spof_symbol, round(coalesce(sp1.share, CASE WHEN bus_factor <= 1 THEN c END), 6) AS spof_share
            FROM o JOIN nb USING (event_id) LEFT JOIN sp1 USING (event_id) LEFT JOIN gl_definition d ON d.id = sp1.id""",
        "service_map": f"WITH RECURSIVE {_WALK60} SELECT p.id AS project_id, p.full_path, count(*) AS definitions, SORTED_LIST(r.name) AS names FROM reached r JOIN gl_project p ON p.id = r.project_id GROUP BY 1, 2",
        "affected_authors": f"""WITH RECURSIVE {_WALK60} SELECT u.id AS user_id, u.username, count(DISTINCT r.id) AS definitions, count(DISTINCT r.project_id) AS services FROM reached r JOIN gl_file_authorship a ON a.file_path = r.file_path
            JOIN gl_user u ON u.id = a.user_id GROUP BY 1, 2""",
        "exposure_scope": """WITH RECURSIVE want AS (SELECT DISTINCT f.affected_definition_id AS symbol_id, d.name FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id),
            walk AS (SELECT w.symbol_id, d.id, 0 AS depth FROM want w JOIN gl_definition d ON d.name = w.name UNION SELECT w.symbol_id, e.source_id, w.depth + 1 FROM gl_calls e JOIN walk w ON e.target_id = w.id WHERE w.depth < 10),
            x AS (SELECT DISTINCT w.symbol_id, d.project_id FROM walk w JOIN gl_definition d ON d.id = w.id), j AS (SELECT project_id, max(created_at) AS last FROM gl_job WHERE job_type = 'deploy' AND status = 'success' GROUP BY 1)
            SELECT x.symbol_id, p.id AS project_id, p.full_path, j.last AS last_deployment, j.last IS NOT NULL AS is_deployed FROM x JOIN gl_project p ON p.id = x.project_id LEFT JOIN j ON j.project_id = p.id""",
    }
