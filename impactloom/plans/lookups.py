"""Queries that look up files, lines and ranks, and those that hold the solvers of large graphs against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..durable import Scratch
from ..functions import paths, spans
from ..operators import centrality, components, cutvertex, history, ranking, scoring
from ..operators.impact import Impact
from ..sources import git
from ..sources.derive import GraphSource, dialect
from . import verdicts

#: A diff of each definition's lines whose paths lack the root folder under which files are indexed.
_ROOTED = """SELECT id AS event_id, 'diff --git a/' || p || ' b/' || p || chr(10) || '--- a/' || p || chr(10) || '+++ b/' || p || chr(10) || '@@ -1 +' || CAST(start_line AS STRING) || ',' || CAST(id % 3 AS STRING) || ' @@' ||
    chr(10) || '+x' || chr(10) AS diff FROM (SELECT id, start_line, substring(file_path, 8) AS p FROM gl_definition)"""


def diff_symbols_rooted(spark, sf_dir) -> DataFrame:
    """Changed symbols of diffs from another root: files are found by a suffix of the indexed path, all of it but the first folder."""
    g = GraphSource(spark, sf_dir)
    return verdicts.change_of(g.sql(_ROOTED), g.table("gl_definition"))


def _porcelain(g: GraphSource) -> DataFrame:
    """(path, text): what blame says of every file, six authors taking turns by a few lines, one of them without an address."""
    files = g.sql("SELECT file_path AS path, max(end_line) AS n, length(file_path) AS k FROM gl_definition GROUP BY file_path")
    entry = """concat(repeat('a1b2c3d4', 5), ' ', l, ' ', l, ' 1', '\\nauthor Dev ', (l * 7 + k) div 5 % 6, '\\nauthor-mail <',
        if((l * 7 + k) div 5 % 6 = 5, '', concat('Dev', (l * 7 + k) div 5 % 6, '@Example.com')), '>\\nsummary x\\n\\tauthor-mail <none@example.com> ', l)"""
    return files.select("path", F.expr(f"array_join(transform(sequence(1L, n), l -> {entry}), '\\n')").alias("text"))


def blame_spans(spark, sf_dir) -> DataFrame:
    """The authors of each definition's lines, from blame of whole files."""
    g = GraphSource(spark, sf_dir)
    return spans.blamed(g.table("gl_definition"), git.blame_lines(_porcelain(g)))


def centrality_percentile(spark, sf_dir) -> DataFrame:
    """The 20 definitions of most calls and the share of definitions with fewer, ranked without a window over the graph."""
    g = GraphSource(spark, sf_dir)
    degrees = centrality.degrees(g.table("gl_calls")).join(g.table("gl_definition").select("id", "name"), "id")
    scratch = Scratch(spark, "percentile")
    busy = scratch.save(degrees.select("id", "name", (F.col("inbound") + F.col("outbound")).alias("total")).where("total > 5"), "busy", release=False)
    ranked = ranking.percent_ranks(busy, scratch, "total", "share")
    return ranked.orderBy(F.desc("total"), "id").limit(20).select("id", "name", "total", F.round("share", 6).alias("centrality_percentile"))


def components_rounds(spark, sf_dir) -> DataFrame:
    """Components of the call graph by the rounds that graphs of any size take."""
    calls = GraphSource(spark, sf_dir).table("gl_calls")
    found = components.connected_components(calls.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), Scratch(spark, "components"), one_task=0)
    return found.groupBy("component").agg(F.count("*").alias("n"))


def pagerank_rounds(spark, sf_dir) -> DataFrame:
    """PageRank of the call graph by the rounds that graphs of any size take."""
    scratch = Scratch(spark, "pagerank")
    scores = centrality.pagerank(GraphSource(spark, sf_dir).table("gl_calls"), scratch, one_task=0)
    return centrality.ranked(scores, scratch).where("rank <= 50").select("id", F.round("score", 8).alias("score"), "rank")


def chokepoints_whole_graph(spark, sf_dir) -> DataFrame:
    """Cut vertices of the whole call graph, by the rounds that graphs of any size take."""
    g = GraphSource(spark, sf_dir)
    whole = g.table("gl_calls").withColumn("event_id", F.lit(1).cast("long"))
    return cutvertex.chokepoints(whole, Scratch(spark, "whole-graph"), one_task=0).select("id", "isolated", "parts")


def named_chokepoints(spark, sf_dir) -> DataFrame:
    """The first named cut vertices of the whole call graph, and whether a finding is about them."""
    g = GraphSource(spark, sf_dir)
    whole = g.table("gl_calls").withColumn("event_id", F.lit(1).cast("long"))
    cuts = cutvertex.chokepoints(whole, Scratch(spark, "named"), one_task=0)
    found = g.sql("SELECT DISTINCT CAST(1 AS BIGINT) AS event_id, affected_definition_id AS id FROM gl_finding")
    return scoring.named_cuts(cuts, g.table("gl_definition"), found).select("name", "isolated", "parts", "is_changed", F.col("place").cast("long").alias("place"))


def authorship_decay(spark, sf_dir) -> DataFrame:
    """Definitions in files of one or two authors, and how long these have not written."""
    g = GraphSource(spark, sf_dir)
    return history.orphaned(g.table("gl_definition"), g.table("gl_file_authorship"), F.expr(dialect("AS_OF", "spark")), Scratch(spark, "orphans"))


#: Whether somebody else approved an event's merge request, and how its pipeline ended.
CONTROLS = """SELECT e.event_id, coalesce(max(CASE WHEN a.user_id <> m.author_id THEN 1 ELSE 0 END), 0) = 1 AS approved, max(CASE WHEN p.status = 'success' THEN 'passed' ELSE p.status END) AS pipeline
        FROM (SELECT DISTINCT event_id FROM mr_event) e JOIN gl_merge_request m ON m.id = e.event_id LEFT JOIN gl_merge_request_approval a ON a.mr_id = m.id LEFT JOIN gl_pipeline p ON p.mr_id = m.id GROUP BY e.event_id"""


def compliance_controls(spark, sf_dir) -> DataFrame:
    """Control states and compliance level of every event, from the boundaries that its first files cross."""
    g = GraphSource(spark, sf_dir)
    files = Impact(g.table("mr_event"), g.table("gl_definition"), g.table("gl_calls")).top_files
    crossed = files.groupBy("event_id").agg(F.array_sort(F.collect_set(paths.boundary(F.col("file_path")))).alias("crossed"))
    rows = g.table("mr_event").select("event_id").distinct().join(crossed, "event_id", "left").join(g.sql(CONTROLS), "event_id", "left")
    return scoring.controlled(rows).select("event_id", F.coalesce(F.array_join("crossed", ","), F.lit("")).alias("crossed"), "approval_control", "pipeline_control", "compliance")


def compliance_tally(spark, sf_dir) -> DataFrame:
    """How many events are in each state of controls and compliance."""
    return compliance_controls(spark, sf_dir).groupBy("approval_control", "pipeline_control", "compliance").agg(F.count("*").alias("n"))


FUNCTIONS = [authorship_decay, diff_symbols_rooted, blame_spans, centrality_percentile, components_rounds, pagerank_rounds, chokepoints_whole_graph, named_chokepoints, compliance_controls, compliance_tally]


_CUTS = """und AS (SELECT source_id AS a, target_id AS b FROM gl_calls WHERE source_id <> target_id UNION SELECT target_id, source_id FROM gl_calls WHERE source_id <> target_id),
    nodes AS (SELECT DISTINCT a AS id FROM und), gone AS (SELECT id FROM nodes UNION ALL SELECT -1000000),
    low(x, id, c) USING KEY (x, id) AS (SELECT g.id, n.id, n.id FROM gone g, nodes n WHERE g.id <> n.id
        UNION SELECT l.x, u.b, min(l.c) FROM low l JOIN und u ON u.a = l.id JOIN recurring.low r ON r.x = l.x AND r.id = u.b WHERE u.b <> l.x AND l.c < r.c GROUP BY l.x, u.b),
    sizes AS (SELECT x, c, count(*) AS n FROM low GROUP BY 1, 2), per AS (SELECT x, count(*) AS parts, max(n) AS m FROM sizes GROUP BY x),
    cuts AS (SELECT x AS id, (SELECT count(*) FROM nodes) - 1 - m AS isolated, parts FROM per WHERE x <> -1000000 AND parts > (SELECT parts FROM per WHERE x = -1000000))"""


def sql(call_components: str, pagerank_top: str, event_walk: str, security: str, payments: str) -> dict[str, str]:
    states = f"""{event_walk}, top AS (SELECT event_id, CASE WHEN {security} THEN 'security' WHEN {payments} THEN 'payments' END AS b FROM files WHERE rank <= 6),
        x AS (SELECT event_id, string_agg(DISTINCT b, ',' ORDER BY b) AS crossed FROM top GROUP BY 1), k AS ({CONTROLS}),
        s AS (SELECT e.event_id, coalesce(x.crossed, '') AS crossed, CASE WHEN approved IS NULL THEN 'NEEDS_DATA' WHEN approved THEN 'PASS' ELSE 'FAIL' END AS approval_control,
              CASE WHEN pipeline IS NULL THEN 'NEEDS_DATA' WHEN pipeline = 'passed' THEN 'PASS' ELSE 'FAIL' END AS pipeline_control
              FROM (SELECT DISTINCT event_id FROM mr_event) e LEFT JOIN x USING (event_id) LEFT JOIN k USING (event_id)),
        r AS (SELECT *, CASE WHEN crossed <> '' AND 'FAIL' IN (approval_control, pipeline_control) THEN 'HIGH' WHEN crossed <> '' AND 'NEEDS_DATA' IN (approval_control, pipeline_control) THEN 'MEDIUM' ELSE 'LOW' END AS compliance FROM s)"""
    return {
        "diff_symbols_rooted": """SELECT DISTINCT e.id AS event_id, d.name AS changed_symbol FROM (SELECT id, start_line, substring(file_path, 8) AS p, id % 3 AS n FROM gl_definition) e
            JOIN gl_definition d ON (d.file_path = e.p OR ends_with(d.file_path, '/' || e.p)) AND d.start_line <= e.start_line + greatest(e.n, 1) - 1 AND d.end_line >= e.start_line""",
        "blame_spans": """WITH f AS (SELECT file_path AS path, max(end_line) AS n FROM gl_definition GROUP BY 1), li AS (SELECT path, unnest(range(1, n + 1)) AS line FROM f),
            bl AS (SELECT path, line, ((line * 7 + length(path)) // 5) % 6 AS a FROM li)
            SELECT d.id AS definition_id, CASE WHEN a = 5 THEN 'Dev 5' ELSE 'dev' || CAST(a AS VARCHAR) || '@example.com' END AS author_email, count(*) AS lines
            FROM gl_definition d JOIN bl ON bl.path = d.file_path AND bl.line BETWEEN d.start_line AND d.end_line GROUP BY 1, 2""",
        "components_rounds": call_components,
        # Each node is taken out in turn and the smallest node that is still reached labels the rest.
        "chokepoints_whole_graph": f"WITH RECURSIVE {_CUTS} SELECT id, isolated, parts FROM cuts",
        "named_chokepoints": f"""WITH RECURSIVE {_CUTS}, few AS (SELECT *, row_number() OVER (ORDER BY isolated DESC, parts DESC, id) AS r FROM cuts WHERE isolated > 0 QUALIFY r <= 20),
            n AS (SELECT d.name, few.*, few.id IN (SELECT affected_definition_id FROM gl_finding) AS is_changed FROM few JOIN gl_definition d ON d.id = few.id QUALIFY row_number() OVER (PARTITION BY d.name ORDER BY r) = 1)
            SELECT name, isolated, parts, is_changed, row_number() OVER (ORDER BY r) AS place FROM n QUALIFY place <= 5""",
        "compliance_controls": f"WITH RECURSIVE {states} SELECT * FROM r",
        "compliance_tally": f"WITH RECURSIVE {states} SELECT approval_control, pipeline_control, compliance, count(*) AS n FROM r GROUP BY 1, 2, 3",
        "pagerank_rounds": pagerank_top,
    }
