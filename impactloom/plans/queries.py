"""All queries of the library and what they equal in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..durable import Scratch
from ..functions import paths, textdiff
from ..operators import centrality, components, cutvertex, history, scoring, traverse
from ..operators.impact import Impact
from ..sources.derive import GraphSource, for_duckdb
from ..streaming import intake, tokens
from . import edits, lookups, replay, verdicts
from .catalogue import QUERIES, SYMBOL
from .typed import GraphQueries

Query = Callable[[SparkSession, str], DataFrame]


def _event(g: GraphSource, id_: int) -> DataFrame:
    return g.sql(f"SELECT CAST(1 AS BIGINT) AS event_id, name AS changed_symbol, 'body-edit' AS edit_class FROM gl_definition WHERE id = {id_}")


def _impact(g: GraphSource, events: DataFrame | None = None) -> Impact:
    return Impact(events if events is not None else g.table("mr_event"), g.table("gl_definition"), g.table("gl_calls"))


_SEED = f"seed AS (SELECT id FROM gl_definition WHERE name IN {SYMBOL})"
_WALK = """callers AS (SELECT DISTINCT e.source_id AS id, 1 AS depth FROM gl_calls e JOIN seed s ON e.target_id = s.id
    UNION SELECT e.source_id, c.depth + 1 FROM gl_calls e JOIN callers c ON e.target_id = c.id WHERE c.depth < 8)"""
_EVENT_WALK = """seed AS (SELECT DISTINCT v.event_id, d.id FROM mr_event v JOIN gl_definition d ON d.name = v.changed_symbol),
    walk AS (SELECT DISTINCT s.id AS root, e.source_id AS id, 1 AS depth FROM gl_calls e JOIN seed s ON e.target_id = s.id
    UNION SELECT w.root, e.source_id, w.depth + 1 FROM gl_calls e JOIN walk w ON e.target_id = w.id WHERE w.depth < 8),
    callers AS (SELECT s.event_id, w.id, max(w.depth) AS depth FROM seed s JOIN (SELECT root, id, max(depth) AS depth FROM walk GROUP BY 1, 2) w ON w.root = s.id GROUP BY 1, 2),
    deps AS (SELECT c.event_id, c.id, d.file_path, d.project_id FROM callers c JOIN gl_definition d ON d.id = c.id),
    files AS (SELECT event_id, file_path, count(*) AS affected, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, file_path) AS rank FROM deps GROUP BY event_id, file_path),
    areas AS (SELECT event_id, array_to_string((string_split(file_path, '/'))[1:2], '/') AS area, sum(affected) AS definitions, count(*) AS files FROM files GROUP BY ALL)"""
_CLOSURE = "clo AS (SELECT id FROM seed UNION SELECT e.source_id FROM gl_calls e JOIN clo c ON e.target_id = c.id)"
_INDUCED = "ind AS (SELECT e.source_id, e.target_id FROM gl_calls e JOIN clo a ON a.id = e.source_id JOIN clo b ON b.id = e.target_id)"
_TEST_SQL = "(" + " OR ".join(f"contains(lower(file_path), '{p}')" for p in paths.TEST_PARTS) + ")"


def _named(name: str) -> Query:
    return lambda spark, sf_dir: GraphSource(spark, sf_dir).sql(QUERIES[name])


def transitive_dependents(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    return _impact(g, _event(g, 60)).totals().select("total_dependents", "affected_services", F.col("max_depth").cast("long").alias("max_depth"))


def transitive_by_depth(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    seeds = traverse.seeds_of(_event(g, 8), g.table("gl_definition"))
    return traverse.callers_by_depth(seeds, g.table("gl_calls"), Scratch(spark, "levels")).groupBy("depth").agg(F.count("*").alias("n"))


def batch_dependents(spark, sf_dir):
    return _impact(GraphSource(spark, sf_dir)).totals().select("event_id", "total_dependents", "affected_services", F.col("max_depth").cast("long").alias("max_depth"))


def affected_files(spark, sf_dir):
    return _impact(GraphSource(spark, sf_dir)).files.select("event_id", "file_path", "affected", F.col("rank").cast("long").alias("rank"))


def affected_modules(spark, sf_dir):
    return _impact(GraphSource(spark, sf_dir)).areas.select("event_id", "area", "definitions", "files")


def test_prod_split(spark, sf_dir):
    f = _impact(GraphSource(spark, sf_dir)).split(F.coalesce(paths.is_test(F.col("file_path")), F.lit(False)))
    t = F.col("label")
    return f.groupBy("event_id").agg(F.sum(F.when(t, F.col("definitions")).otherwise(0)).alias("test_definitions"), F.sum(F.when(t, 0).otherwise(F.col("definitions"))).alias("prod_definitions"))


def walk_depth_stats(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    seeds = traverse.seeds_of(_event(g, 60), g.table("gl_definition"))
    w = traverse.walk_counts(seeds, g.table("gl_calls"), Scratch(spark, "walks")).join(g.table("gl_definition").select("id"), "id", "left_semi")
    # The median weighs each depth by its number of walks.
    return w.agg(F.sum("walks").alias("walks"), F.countDistinct("id").alias("definitions"), F.max("depth").cast("long").alias("max_depth"), F.percentile("depth", 0.5, F.col("walks")).alias("median_depth"))


def closure_nodes(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    return traverse.closure(traverse.seeds_of(_event(g, 8), g.table("gl_definition")), g.table("gl_calls"), Scratch(spark, "closure")).select("id")


def induced_edges(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    nodes = traverse.closure(traverse.seeds_of(_event(g, 60), g.table("gl_definition")), g.table("gl_calls"), Scratch(spark, "closure"))
    return traverse.induced_edges(nodes, g.table("gl_calls")).groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


def neighbourhood_weights(spark, sf_dir):
    return edits.near(GraphSource(spark, sf_dir))


PAGERANK_ROUNDS = centrality.ROUNDS


def pagerank_top(spark, sf_dir):
    scratch = Scratch(spark, "pagerank")
    scores = centrality.pagerank(GraphSource(spark, sf_dir).table("gl_calls"), scratch)
    return centrality.ranked(scores, scratch).where("rank <= 50").select("id", F.round("score", 8).alias("score"), "rank")


def call_components(spark, sf_dir):
    calls = GraphSource(spark, sf_dir).table("gl_calls")
    cc = components.connected_components(calls.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), Scratch(spark, "components"))
    return cc.groupBy("component").agg(F.count("*").alias("n"))


def chokepoints(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    scratch = Scratch(spark, "chokepoints")
    nodes = traverse.closure(traverse.seeds_of(_event(g, 60), g.table("gl_definition")), g.table("gl_calls"), scratch)
    return cutvertex.chokepoints(traverse.induced_edges(nodes, g.table("gl_calls")), scratch).select("id", "isolated", "parts")


def keystones(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    return scoring.keystones(g.table("mr_event"), centrality.degrees(g.table("gl_calls")), g.table("gl_definition")).select("event_id", F.lower("name").alias("name"), F.col("rank").cast("long").alias("rank"))


def ownership_lens(spark, sf_dir):
    areas = _impact(GraphSource(spark, sf_dir)).areas.where(F.col("rank") <= scoring.TOP_OWNERS)
    o = areas.groupBy("event_id").agg(F.count("*").alias("bus_factor"), (F.max("definitions") / F.sum("definitions")).alias("concentration"))
    return o.select("event_id", "bus_factor", F.round("concentration", 6).alias("concentration"), scoring.ownership_risk(F.col("concentration"), F.col("bus_factor"), F.lit(False)).alias("risk"))


def impact_confidence(spark, sf_dir):
    top = _impact(GraphSource(spark, sf_dir)).top_files
    low = F.lower("file_path")
    c = top.groupBy("event_id").agg(F.count_if(low.contains("private")).alias("p"), F.bool_or(low.contains("generated") | low.contains("/gen/")).alias("g"), F.bool_or(paths.is_critical(F.col("file_path"))).alias("critical"))
    return c.select("event_id", "critical", F.round(scoring.impact_confidence(F.col("p"), F.col("g")), 6).alias("confidence"))


def compliance_boundaries(spark, sf_dir):
    top = _impact(GraphSource(spark, sf_dir)).top_files
    return top.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set(paths.boundary(F.col("file_path")))), ",").alias("crossed"))


_GRID = """SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS k, CAST(o_orderkey * 37 % 600 AS BIGINT) AS deps, o_orderkey % 3 = 0 AS cut, o_orderkey % 5 = 0 AS critical,
    CAST(o_orderkey % 7 AS DOUBLE) / 50 AS scar, CAST(o_orderkey % 3 AS INT) AS private, o_orderkey % 11 = 0 AS gen,
    CASE o_orderkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' END AS severity,
    CASE o_orderkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END AS ownership,
    CASE o_orderkey % 9 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END AS compliance,
    CASE o_orderkey % 3 WHEN 0 THEN 'contract-break' WHEN 1 THEN 'body-edit' ELSE 'cosmetic' END AS edit_class FROM orders"""


_GIVEN = f"""SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE edit_class END AS edit_class, id % 8 > 1 AS has_impact, scar AS cfr, deps AS total_dependents, k AS n_keystones,
    CAST(0.95 AS DOUBLE) AS confidence, severity, ownership, compliance FROM ({_GRID}) g"""


def risk_and_gate(spark, sf_dir):
    """The whole score model over a grid of inputs made from orders."""
    d = GraphSource(spark, sf_dir).sql(_GRID)
    c = F.col
    d = d.withColumn("cfr", scoring.change_failure_rate(c("k"), c("deps"), c("cut"), c("critical"), c("scar"))).withColumn("confidence", scoring.impact_confidence(c("private"), c("gen"))).withColumn("danger", textdiff.edit_danger(c("edit_class")))
    d = d.withColumn("risk", scoring.blended(scoring.risk_parts(c("cfr"), c("deps"), c("k"), c("severity"), c("ownership"), c("compliance"), F.lit(True)), c("danger"))).withColumn("level", scoring.risk_level(c("risk")))
    return d.select("id", F.round("cfr", 6).alias("cfr"), F.round("confidence", 6).alias("confidence"), F.round("risk", 6).alias("risk"), "level", scoring.decision(c("level"), c("k"), c("danger"), F.lit(True), c("confidence")).alias("action"))


def event_verdicts(spark, sf_dir):
    """The verdict of every event: shared traversal, all lenses, scars from history and controls; no table ties findings to events."""
    g = GraphSource(spark, sf_dir)
    impact = _impact(g)
    scars = history.scar_prior(impact.near(), edits.scars(g)).select("event_id", "prior")
    controls = g.sql(lookups.CONTROLS)
    v = impact.verdicts(controls, scars)
    return v.select(*(F.round(c, 6).alias(c) if c in ("concentration", "cfr", "confidence", "risk") else F.col(c).cast("long").alias(c) if c == "max_depth" else c for c in v.columns))


def backtest_tally(spark, sf_dir):
    """Decisions over all events with their shares."""
    v = event_verdicts(spark, sf_dir)
    return v.groupBy("action").agg(F.count("*").alias("n"), F.sum(F.when(F.col("edit_class") == "contract-break", 1).otherwise(0)).alias("contract_breaks"))


def backtest_catches(spark, sf_dir):
    """The escalated or contract-breaking events with the most dependents."""
    return scoring.catches(event_verdicts(spark, sf_dir)).select("event_id", "action", "edit_class", "total_dependents")


def _graph(spark, sf_dir) -> GraphQueries:
    return GraphQueries(GraphSource(spark, sf_dir))


def _symbol(q: GraphQueries) -> DataFrame:
    return q.source.sql("SELECT name FROM gl_definition WHERE id = 60")


def direct_callers(spark, sf_dir):
    q = _graph(spark, sf_dir)
    return q.direct_callers(_symbol(q)).select("id", "name", "fqn", "file_path", "start_line")


def symbol_defs(spark, sf_dir):
    q = _graph(spark, sf_dir)
    return q.symbol_defs(_symbol(q)).select("id", "name", "inbound")


def symbol_definition(spark, sf_dir):
    q = _graph(spark, sf_dir)
    return q.symbol_definition(_symbol(q)).select("id", "name", "fqn", "file_path", "start_line", "end_line", "inbound")


def called_symbols(spark, sf_dir):
    """Who calls the symbols that findings are about, the first hundred calls."""
    q = _graph(spark, sf_dir)
    return q.query("called_symbols", symbols=q.source.sql("SELECT d.name FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id"))


def definitions_by_id(spark, sf_dir):
    return _graph(spark, sf_dir).definitions_by_id([1, 8, 60, 61, 99999999])


def all_call_edges(spark, sf_dir):
    return _graph(spark, sf_dir).all_call_edges().groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


def ownership_centrality(spark, sf_dir):
    return _graph(spark, sf_dir).ownership_centrality()


def lineage_path(spark, sf_dir):
    return _graph(spark, sf_dir).lineage()


def _changes(g):
    return history.usable_changes(g.table("git_commit"), g.table("git_commit_file"))


def scar_prior(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    return history.scar_prior(edits.near(g), edits.scars(g)).select("event_id", "contributors", F.round("prior", 6).alias("prior"), "capped")


def scar_receipts(spark, sf_dir):
    return history.receipts(_changes(GraphSource(spark, sf_dir))).withColumn("place", F.col("place").cast("long"))


def blast_definitions(spark, sf_dir):
    return _impact(GraphSource(spark, sf_dir)).blast().select("event_id", "id", "inbound", F.round("weight", 6).alias("weight"))


def blame_ownership(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    impact = _impact(g)
    return history.blame_owners(impact.blast(), impact.blamed(g.table("blame"))).select("event_id", "author_email", F.round("share", 6).alias("share"))


def bus_factor(spark, sf_dir):
    g = GraphSource(spark, sf_dir)
    impact = _impact(g)
    return history.bus_factor(history.blame_owners(impact.blast(), impact.blamed(g.table("blame")))).select("event_id", F.col("bus_factor").cast("long").alias("bus_factor"), F.round("concentration", 6).alias("concentration"))



def path_functions(spark, sf_dir):
    p = F.col("file_path")
    return GraphSource(spark, sf_dir).table("gl_definition").select("id", paths.module_of(p).alias("module"), paths.is_critical(p).alias("critical"), paths.is_test(p).alias("test"), paths.is_generated(p).alias("generated"), paths.boundary(p).alias("boundary"))


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "html")


def strip_comments(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.select("id", F.md5(textdiff.strip_comments(F.col("html"), F.lit("rs"))).alias("digest"))





def throttle_stream(spark, sf_dir):
    """The stateful throttle over the events table, which comes as a stream in three parts; the stream is started anew for each."""
    scratch = Scratch(spark, "throttle")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = events.select(F.percentile_approx(F.unix_timestamp("ts"), [1 / 3, 2 / 3])).first()[0] or []
    part = sum((F.when(F.unix_timestamp("ts") >= end, 1).otherwise(0) for end in ends), F.lit(0))
    for k in range(len(ends) + 1):
        events.where(part == k).write.mode("append").parquet(f"{scratch.root}/in")
        arriving = spark.readStream.schema(events.schema).parquet(f"{scratch.root}/in")
        tokens.throttle_stream(arriving, f"{scratch.root}/out", f"{scratch.root}/state").awaitTermination()
    return intake.current(spark, f"{scratch.root}/out", ["user_id", "window_start"]).select("user_id", "window_start", "n", "allowed")


_DIFF = """SELECT id AS event_id, 'diff --git a/' || file_path || ' b/' || file_path || chr(10) || '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || '@@ -1 +' ||
    CAST(start_line AS STRING) || ',' || CAST(id % 3 AS STRING) || ' @@' || chr(10) || '+x' || chr(10) AS diff FROM gl_definition"""


def diff_symbols(spark, sf_dir):
    """Changed symbols of diffs, which are made up from definitions."""
    g = GraphSource(spark, sf_dir)
    return verdicts.change_of(g.sql(_DIFF), g.table("gl_definition"))


def lineage_lens(spark, sf_dir):
    """The lineage of all findings, as lens."""
    g = GraphSource(spark, sf_dir)
    found = g.sql("SELECT f.id AS event_id, CAST(0 AS INT) AS nth, f.id AS finding_id, f.title, f.severity, d.name AS affected_symbol FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id")
    changed = g.sql("SELECT f.id AS event_id, d.name AS changed_symbol FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id WHERE f.id % 2 = 0")
    return verdicts.provenance(found, changed, g).select("finding_id", "affected_symbol", "definition_id", "mr_id", "author", "project", "steps", "composed", F.round("confidence", 6).alias("confidence"))


_FOUND = """SELECT f.id AS event_id, CAST(0 AS INT) AS nth, f.id AS finding_id, f.title, f.severity, d.name AS affected_symbol FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id"""


def _exposed(g: GraphSource) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, of which every other one is about a symbol that its event changes, their changes, and what is exposed to them."""
    found = g.sql(_FOUND)
    changed = found.where("event_id % 2 = 0").select("event_id", F.col("affected_symbol").alias("changed_symbol"), F.lit("body-edit").alias("edit_class"))
    return found, changed, verdicts.exposed(found, _impact(g, changed), g)


def exposed_services(spark, sf_dir):
    """The services exposed to each finding, from the shared traversal where its event changes the symbol."""
    return _exposed(GraphSource(spark, sf_dir))[2].select(F.col("event_id").alias("finding_id"), "composed", "project_id", "full_path", F.unix_timestamp("last_deployment").alias("last_deployment"), "is_deployed")


def exposed_lineage(spark, sf_dir):
    """The lineage of each finding with the confidence that its exposed services leave."""
    g = GraphSource(spark, sf_dir)
    found, changed, exposure = _exposed(g)
    rows = verdicts.exposed_lineage(verdicts.provenance(found, changed, g), exposure)
    return rows.select("finding_id", "author", "steps", "composed", "services", "critical", F.round("confidence", 6).alias("confidence"))


def composed_grid(spark, sf_dir):
    """Composition of lens results that are given, over a grid made from orders in which any lens may be absent."""
    return verdicts.compose(GraphSource(spark, sf_dir).sql(_GIVEN)).select("id", F.round("risk", 6).alias("risk"), "level", "action")


def typed_lineage(spark, sf_dir):
    return GraphQueries(GraphSource(spark, sf_dir)).dsl({"query_type": "pathfinding", "start": {"entity": "Finding", "filters": {"severity": {"op": "in", "value": ["HIGH", "CRITICAL"]}}}, "end": {"entity": "User"}, "limit": 1000000})


def typed_traversal(spark, sf_dir):
    q = GraphQueries(GraphSource(spark, sf_dir))
    return q.dsl({"query": {"query_type": "traversal", "node": {"entity": "Definition", "filters": {"project_id": {"op": "eq", "value": 3}, "definition_type": {"op": "in", "value": ["Class"]}}}, "limit": 1000000}}).select("id", "name", "file_path")


def _case_any(column: str, words, test: str = "contains(lower({c}), '{w}')") -> str:
    return "(" + " OR ".join(test.format(c=column, w=w) for w in words) + ")"


def _pagerank_sql(first: int | None = 50) -> str:
    parts = ["""n AS (SELECT source_id AS id FROM gl_calls UNION SELECT target_id FROM gl_calls), o AS (SELECT source_id AS id, count(*) AS c FROM gl_calls GROUP BY 1),
        p0 AS (SELECT id, CAST(1 AS DOUBLE) / (SELECT count(*) FROM n) AS s FROM n)"""]
    for k in range(1, PAGERANK_ROUNDS + 1):
        parts.append(f"""p{k} AS MATERIALIZED (SELECT n.id, CAST(0.15 AS DOUBLE) / (SELECT count(*) FROM n) + CAST(0.85 AS DOUBLE) * (coalesce(g.s, 0) + (SELECT coalesce(sum(p.s), 0) FROM p{k - 1} p LEFT JOIN o ON o.id = p.id WHERE o.id IS NULL) / (SELECT count(*) FROM n)) AS s
            FROM n LEFT JOIN (SELECT e.target_id AS id, sum(p.s / o.c) AS s FROM gl_calls e JOIN p{k - 1} p ON p.id = e.source_id JOIN o ON o.id = e.source_id GROUP BY 1) g ON g.id = n.id)""")
    return f"WITH {', '.join(parts)} SELECT id, round(s, 8) AS score, row_number() OVER (ORDER BY s DESC, id) AS rank FROM p{PAGERANK_ROUNDS}{f' ORDER BY s DESC, id LIMIT {first}' if first else ''}"


_D = "CAST({} AS DOUBLE)"
_LEVEL = "CASE WHEN {c} IS NULL THEN NULL WHEN {c} = 'HIGH' THEN {h} WHEN {c} = 'MEDIUM' THEN {m} WHEN {c} = 'LOW' THEN {l} ELSE 0.4 END"
_GATE_SQL = f"""
WITH grid AS ({_GRID}),
a AS (SELECT *, least({_D.format(0.9)}, {_D.format(0.05)} + least({_D.format(0.18)}, k * {_D.format(0.06)}) + CASE WHEN deps >= 300 THEN {_D.format(0.15)} WHEN deps >= 100 THEN {_D.format(0.1)} WHEN deps >= 25 THEN {_D.format(0.05)} ELSE 0 END
        + CASE WHEN cut THEN {_D.format(0.08)} ELSE 0 END + CASE WHEN critical THEN {_D.format(0.05)} ELSE 0 END + greatest(0, least({_D.format(0.12)}, scar))) AS cfr,
      greatest(0, {_D.format(0.95)} - private * {_D.format(0.05)} - CASE WHEN gen THEN {_D.format(0.1)} ELSE 0 END) AS confidence,
      CASE edit_class WHEN 'cosmetic' THEN 0 WHEN 'body-edit' THEN {_D.format(0.5)} ELSE 1 END AS danger FROM grid),
b AS (SELECT *, list_filter([cfr, CASE WHEN deps >= 300 THEN 0.85 WHEN deps >= 100 THEN 0.65 WHEN deps >= 25 THEN 0.45 ELSE 0.2 END, CASE WHEN k > 0 THEN 0.9 END,
        CASE severity WHEN 'CRITICAL' THEN 0.95 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.6 WHEN 'LOW' THEN 0.3 END,
        {_LEVEL.format(c='ownership', h=0.85, m=0.6, l=0.25)}, {_LEVEL.format(c='compliance', h=0.9, m=0.55, l=0.25)}], lambda x: x IS NOT NULL) AS parts FROM a),
r AS (SELECT *, (list_max(parts) * {_D.format(0.6)} + list_sum(parts) / len(parts) * {_D.format(0.4)}) * danger AS risk FROM b),
l AS (SELECT *, CASE WHEN risk >= 0.8 THEN 'CRITICAL' WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r)
SELECT id, round(cfr, 6) AS cfr, round(confidence, 6) AS confidence, round(risk, 6) AS risk, level,
  CASE WHEN level = 'CRITICAL' THEN 'BLOCK' WHEN level = 'HIGH' OR (k > 0 AND danger >= 0.5) THEN 'SENIOR_REVIEW' WHEN level = 'MEDIUM' THEN 'REVIEW_REQUIRED'
       WHEN confidence >= {_D.format(0.9)} THEN 'AUTO_APPROVE' ELSE 'REVIEW_REQUIRED' END AS action FROM l
"""
_SCARS = QUERIES["scar_files"].replace("round(CAST(fixes AS DOUBLE) / total, 6)", "CAST(fixes AS DOUBLE) / total").replace("ELSE CAST(0 AS DOUBLE) END), 6) AS intensity", "ELSE CAST(0 AS DOUBLE) END)) AS intensity").replace("round(least(", "(least(")
_NEAR = """s AS (SELECT DISTINCT v.event_id, d.id FROM mr_event v JOIN gl_definition d ON d.name = v.changed_symbol),
    x AS (SELECT event_id, id, CAST(1 AS DOUBLE) AS w FROM s UNION ALL SELECT event_id, source_id, CAST(0.5 AS DOUBLE) FROM s JOIN gl_calls ON target_id = id UNION ALL SELECT event_id, target_id, CAST(0.5 AS DOUBLE) FROM s JOIN gl_calls ON source_id = id),
    near AS (SELECT event_id, d.file_path AS path, max(w) AS weight FROM x JOIN gl_definition d ON d.id = x.id GROUP BY ALL)"""
_BLAST = f"""{_EVENT_WALK}, deg AS (SELECT target_id AS id, count(DISTINCT source_id) AS n FROM gl_calls GROUP BY 1),
    sp AS (SELECT d.id, coalesce(n, 0) AS inbound FROM gl_definition d LEFT JOIN deg ON deg.id = d.id WHERE start_line >= 1 AND end_line >= start_line),
    ca AS (SELECT c.event_id, sp.id, inbound FROM (SELECT DISTINCT event_id, id FROM callers) c JOIN sp ON sp.id = c.id QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY inbound DESC, sp.id) <= 40),
    bl AS (SELECT *, 1 + ln(1 + CAST(inbound AS DOUBLE)) AS weight FROM (SELECT event_id, sp.id, inbound FROM seed JOIN sp ON sp.id = seed.id UNION SELECT * FROM ca)
           QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY 1 + ln(1 + CAST(inbound AS DOUBLE)) DESC, id) <= 40),
    ow AS (SELECT event_id, author_email, sum(lines * weight) AS mass FROM bl JOIN blame ON definition_id = bl.id GROUP BY ALL),
    sh AS (SELECT *, mass / sum(mass) OVER (PARTITION BY event_id) AS share, row_number() OVER (PARTITION BY event_id ORDER BY mass DESC, author_email) AS place FROM ow),
    cu AS (SELECT *, sum(share) OVER (PARTITION BY event_id ORDER BY place) AS cum FROM sh)"""

_COMPOSED_SQL = f"""
WITH given AS ({_GIVEN}),
b AS (SELECT *, CASE edit_class WHEN 'cosmetic' THEN 0 WHEN 'body-edit' THEN {_D.format(0.5)} ELSE 1 END AS danger,
        list_filter([CASE WHEN has_impact THEN cfr END, CASE WHEN NOT has_impact THEN NULL WHEN total_dependents >= 300 THEN 0.85 WHEN total_dependents >= 100 THEN 0.65 WHEN total_dependents >= 25 THEN 0.45 ELSE 0.2 END,
        CASE WHEN has_impact AND n_keystones > 0 THEN 0.9 END, CASE severity WHEN 'CRITICAL' THEN 0.95 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.6 WHEN 'LOW' THEN 0.3 END,
        {_LEVEL.format(c='ownership', h=0.85, m=0.6, l=0.25)}, {_LEVEL.format(c='compliance', h=0.9, m=0.55, l=0.25)}], lambda x: x IS NOT NULL) AS parts FROM given),
r AS (SELECT *, CASE WHEN len(parts) > 0 THEN (list_max(parts) * {_D.format(0.6)} + list_sum(parts) / len(parts) * {_D.format(0.4)}) * danger END AS risk FROM b),
l AS (SELECT *, CASE WHEN risk IS NULL THEN 'UNKNOWN' WHEN risk >= 0.8 THEN 'CRITICAL' WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r)
SELECT id, round(risk, 6) AS risk, level, CASE WHEN level = 'CRITICAL' THEN 'BLOCK' WHEN level = 'HIGH' OR (n_keystones > 0 AND danger >= 0.5) THEN 'SENIOR_REVIEW' WHEN level = 'MEDIUM' THEN 'REVIEW_REQUIRED'
    WHEN level = 'LOW' AND has_impact AND confidence >= 0.9 THEN 'AUTO_APPROVE' ELSE 'REVIEW_REQUIRED' END AS action FROM l
"""
_KEYSTONES = """i AS (SELECT target_id AS id, count(DISTINCT source_id) AS n FROM gl_calls GROUP BY 1), o AS (SELECT source_id AS id, count(DISTINCT target_id) AS n FROM gl_calls GROUP BY 1),
    t AS (SELECT d.id, lower(name) AS name, row_number() OVER (ORDER BY coalesce(i.n, 0) + coalesce(o.n, 0) DESC, d.id) AS rank FROM gl_definition d LEFT JOIN i ON i.id = d.id LEFT JOIN o ON o.id = d.id WHERE coalesce(i.n, 0) + coalesce(o.n, 0) > 10),
    f AS (SELECT name, min(rank) AS rank FROM t WHERE rank <= 30 GROUP BY name)"""
_MARKED = QUERIES["scar_files"][QUERIES["scar_files"].index("normal AS"):QUERIES["scar_files"].index("t AS (SELECT file_path")].strip().rstrip(",").replace("SELECT f.file_path, lower(g.subject) AS s", "SELECT f.file_path, f.commit_id, g.seq, lower(g.subject) AS s").replace("k AS (SELECT file_path,", "marked AS (SELECT file_path, commit_id, seq,")
_INTRO = "SELECT definition_id, merge_request_id AS mr_id FROM gl_definition_history QUALIFY row_number() OVER (PARTITION BY definition_id ORDER BY created_at, merge_request_id) = 1"

_EXPOSED = """fs AS (SELECT f.id AS event_id, d.name, f.id % 2 = 0 AS composed FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id), want AS (SELECT DISTINCT name FROM fs),
    walk AS (SELECT w.name, d.id, 0 AS depth FROM want w JOIN gl_definition d ON d.name = w.name UNION SELECT w.name, e.source_id, w.depth + 1 FROM gl_calls e JOIN walk w ON e.target_id = w.id WHERE w.depth < 10),
    x AS (SELECT w.name, d.project_id, bool_or(depth BETWEEN 1 AND 8) AS near FROM walk w JOIN gl_definition d ON d.id = w.id GROUP BY 1, 2),
    j AS (SELECT project_id, max(created_at) AS last FROM gl_job WHERE job_type = 'deploy' AND status = 'success' GROUP BY 1),
    exposed AS (SELECT fs.event_id, composed, p.id AS project_id, p.full_path, CASE WHEN NOT composed THEN j.last END AS last, composed OR j.last IS NOT NULL AS is_deployed
        FROM fs JOIN x ON x.name = fs.name AND (near OR NOT composed) JOIN gl_project p ON p.id = x.project_id LEFT JOIN j ON j.project_id = p.id)"""

_FUNCTIONS: list[Query] = [transitive_dependents, transitive_by_depth, batch_dependents, affected_files, affected_modules, test_prod_split, walk_depth_stats, closure_nodes, induced_edges,
                           neighbourhood_weights, pagerank_top, call_components, chokepoints, keystones, ownership_lens, impact_confidence, compliance_boundaries, risk_and_gate, event_verdicts,
                           backtest_tally, backtest_catches, scar_prior, scar_receipts, blast_definitions, blame_ownership, bus_factor, path_functions, strip_comments, throttle_stream,
                           direct_callers, symbol_defs, symbol_definition, called_symbols, definitions_by_id, all_call_edges, ownership_centrality, lineage_path, diff_symbols, lineage_lens, exposed_services, exposed_lineage, composed_grid, typed_lineage, typed_traversal]

_SQL: dict[str, str] = {
    "transitive_dependents": f"WITH RECURSIVE {_SEED}, {_WALK} SELECT count(DISTINCT d.id) AS total_dependents, count(DISTINCT d.project_id) AS affected_services, CAST(max(depth) AS BIGINT) AS max_depth FROM callers c JOIN gl_definition d ON d.id = c.id",
    "transitive_by_depth": f"WITH RECURSIVE {_SEED.replace('id = 60', 'id = 8')}, {_WALK} SELECT depth, count(*) AS n FROM callers GROUP BY depth",
    "batch_dependents": f"WITH RECURSIVE {_EVENT_WALK} SELECT c.event_id, count(DISTINCT d.id) AS total_dependents, count(DISTINCT d.project_id) AS affected_services, CAST(max(depth) AS BIGINT) AS max_depth FROM callers c JOIN gl_definition d ON d.id = c.id GROUP BY 1",
    "affected_files": f"WITH RECURSIVE {_EVENT_WALK} SELECT * FROM files",
    "affected_modules": f"WITH RECURSIVE {_EVENT_WALK} SELECT event_id, area, CAST(definitions AS BIGINT) AS definitions, files FROM areas",
    "test_prod_split": f"WITH RECURSIVE {_EVENT_WALK} SELECT event_id, CAST(sum(CASE WHEN {_TEST_SQL} THEN affected ELSE 0 END) AS BIGINT) AS test_definitions, CAST(sum(CASE WHEN {_TEST_SQL} THEN 0 ELSE affected END) AS BIGINT) AS prod_definitions FROM files GROUP BY 1",
    "walk_depth_stats": f"""WITH RECURSIVE {_SEED}, w AS (SELECT id, 0 AS depth FROM seed UNION ALL SELECT e.source_id, w.depth + 1 FROM gl_calls e JOIN w ON e.target_id = w.id WHERE w.depth < 5)
        SELECT count(*) AS walks, count(DISTINCT w.id) AS definitions, CAST(max(depth) AS BIGINT) AS max_depth, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(depth AS DOUBLE)) AS median_depth FROM w JOIN gl_definition d ON d.id = w.id""",
    "closure_nodes": f"WITH RECURSIVE {_SEED.replace('id = 60', 'id = 8')}, {_CLOSURE} SELECT id FROM clo",
    "induced_edges": f"WITH RECURSIVE {_SEED}, {_CLOSURE}, {_INDUCED} SELECT source_id, target_id, count(*) AS n FROM ind GROUP BY 1, 2",
    "neighbourhood_weights": f"WITH {_NEAR} SELECT * FROM near",
    "pagerank_top": _pagerank_sql(),
    "call_components": """WITH RECURSIVE u AS (SELECT DISTINCT source_id AS a, target_id AS b FROM gl_calls WHERE source_id <> target_id UNION SELECT target_id, source_id FROM gl_calls WHERE source_id <> target_id),
        low(id, c) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, low.c FROM low JOIN u ON u.a = low.id WHERE low.c < u.b) SELECT c AS component, count(*) AS n FROM (SELECT id, min(c) AS c FROM low GROUP BY id) GROUP BY c""",
    "chokepoints": f"""WITH RECURSIVE {_SEED}, {_CLOSURE}, {_INDUCED}, und AS (SELECT source_id AS a, target_id AS b FROM ind WHERE source_id <> target_id UNION SELECT target_id, source_id FROM ind WHERE source_id <> target_id),
        nodes AS (SELECT DISTINCT a AS id FROM und),
        reach AS (SELECT n.id AS x, m.id AS s, m.id AS t FROM (SELECT id FROM nodes UNION ALL SELECT -1000000) n, nodes m WHERE n.id <> m.id UNION SELECT r.x, r.s, u.b FROM reach r JOIN und u ON u.a = r.t WHERE u.b <> r.x),
        comp AS (SELECT x, s, min(t) AS c FROM reach GROUP BY 1, 2), sizes AS (SELECT x, c, count(*) AS n FROM comp GROUP BY 1, 2), per AS (SELECT x, count(*) AS parts, max(n) AS m FROM sizes GROUP BY x)
        SELECT x AS id, (SELECT count(*) FROM nodes) - 1 - m AS isolated, parts FROM per WHERE x <> -1000000 AND parts > (SELECT parts FROM per WHERE x = -1000000)""",
    "keystones": f"WITH {_KEYSTONES} SELECT DISTINCT event_id, f.name, f.rank FROM mr_event JOIN f ON f.name = lower(changed_symbol)",
    "ownership_lens": f"""WITH RECURSIVE {_EVENT_WALK}, t AS (SELECT * FROM areas QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY definitions DESC, area) <= 5),
        o AS (SELECT event_id, count(*) AS bus_factor, CAST(max(definitions) AS DOUBLE) / sum(definitions) AS c FROM t GROUP BY 1)
        SELECT event_id, bus_factor, round(c, 6) AS concentration, CASE WHEN bus_factor <= 1 OR c >= 0.9 THEN 'HIGH' WHEN c >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM o""",
    "impact_confidence": f"""WITH RECURSIVE {_EVENT_WALK} SELECT event_id, bool_or({_case_any('file_path', paths.CRITICAL)}) AS critical,
        round(greatest(0, {_D.format(0.95)} - count(CASE WHEN contains(lower(file_path), 'private') THEN 1 END) * {_D.format(0.05)} - CASE WHEN bool_or({_case_any('file_path', ('generated', '/gen/'))}) THEN {_D.format(0.1)} ELSE 0 END), 6) AS confidence
        FROM files WHERE rank <= 6 GROUP BY 1""",
    "compliance_boundaries": f"""WITH RECURSIVE {_EVENT_WALK} SELECT event_id, coalesce(string_agg(DISTINCT b, ',' ORDER BY b), '') AS crossed FROM
        (SELECT event_id, CASE WHEN {_case_any('file_path', paths.SECURITY)} THEN 'security' WHEN {_case_any('file_path', paths.PAYMENTS)} THEN 'payments' END AS b FROM files WHERE rank <= 6) GROUP BY 1""",
    "risk_and_gate": _GATE_SQL,
    "scar_receipts": f"""WITH {_MARKED}, newest AS (SELECT * FROM marked WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY seq) <= 5)
        SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY CASE kind WHEN 'revert' THEN 0 WHEN 'hotfix' THEN 1 ELSE 2 END, seq) AS place, commit_id, kind FROM newest
        QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY CASE kind WHEN 'revert' THEN 0 WHEN 'hotfix' THEN 1 ELSE 2 END, seq) <= 3""",
    "scar_prior": f"""WITH {_NEAR}, sc AS ({_SCARS.strip()}) SELECT event_id, count(*) AS contributors, round(least({_D.format(0.12)}, sum(weight * intensity) * {_D.format(0.1)}), 6) AS prior, sum(weight * intensity) * {_D.format(0.1)} >= {_D.format(0.12)} AS capped
        FROM near JOIN sc ON sc.file_path = near.path WHERE intensity > 0 GROUP BY 1""",
    "blast_definitions": f"WITH RECURSIVE {_BLAST} SELECT event_id, id, inbound, round(weight, 6) AS weight FROM bl",
    "blame_ownership": f"WITH RECURSIVE {_BLAST} SELECT event_id, author_email, round(share, 6) AS share FROM sh",
    "bus_factor": f"WITH RECURSIVE {_BLAST} SELECT event_id, coalesce(min(CASE WHEN cum > 0.5 THEN place END), count(*)) AS bus_factor, round(max(CASE WHEN place = 1 THEN share END), 6) AS concentration FROM cu GROUP BY 1",
    "path_functions": f"""SELECT id, array_to_string((string_split(file_path, '/'))[1:2], '/') AS module, {_case_any('file_path', paths.CRITICAL)} AS critical, {_TEST_SQL} AS test, {_case_any('file_path', ('generated', '/gen/'))} AS generated,
        CASE WHEN {_case_any('file_path', paths.SECURITY)} THEN 'security' WHEN {_case_any('file_path', paths.PAYMENTS)} THEN 'payments' END AS boundary FROM gl_definition""",
    "strip_comments": r"SELECT page_id AS id, md5(regexp_replace(regexp_replace(regexp_replace(html, '/\*.*?\*/', '', 'gs'), '//[^\n]*', '', 'g'), '\s+', '', 'g')) AS digest FROM pages",
    "throttle_stream": QUERIES["throttle_windows"],
    "diff_symbols": """SELECT DISTINCT e.id AS event_id, d.name AS changed_symbol FROM gl_definition e JOIN gl_definition d ON d.file_path = e.file_path
        AND d.start_line <= e.start_line + greatest(e.id % 3, 1) - 1 AND d.end_line >= e.start_line""",
    "lineage_lens": f"""WITH s AS (SELECT name, min(id) AS definition_id FROM gl_definition GROUP BY name),
        i AS ({_INTRO}), j AS (SELECT project_id, max(created_at) AS last FROM gl_job WHERE job_type = 'deploy' AND status = 'success' GROUP BY 1),
        r AS (SELECT f.id AS finding_id, d.name AS affected_symbol, s.definition_id, i.mr_id, u.username AS author, p.full_path AS project, f.id % 2 = 0 AS composed, j.last,
                2 + 1 + CASE WHEN i.mr_id IS NULL THEN 0 ELSE 1 END + CASE WHEN u.username IS NULL THEN 0 ELSE 1 END AS steps
              FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id JOIN s ON s.name = d.name JOIN gl_definition o ON o.id = s.definition_id LEFT JOIN i ON i.definition_id = s.definition_id
              LEFT JOIN gl_merge_request m ON m.id = i.mr_id LEFT JOIN gl_user u ON u.id = m.author_id LEFT JOIN gl_project p ON p.id = o.project_id LEFT JOIN j ON j.project_id = o.project_id)
        SELECT finding_id, affected_symbol, definition_id, mr_id, author, project, CAST(steps AS INTEGER) AS steps, composed, round(least(1, greatest(0, {_D.format(0.99)} - (5 - steps) * {_D.format(0.1)}
          - CASE WHEN last IS NULL THEN {_D.format(0.05)} ELSE 0 END + CASE WHEN composed THEN {_D.format(0.01)} ELSE 0 END)), 6) AS confidence FROM r""",
    "called_symbols": """SELECT c.id, c.name, c.definition_type, c.file_path, t.name AS called_symbol FROM gl_definition t JOIN gl_calls e ON e.target_id = t.id JOIN gl_definition c ON c.id = e.source_id
        WHERE t.name IN (SELECT d.name FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id) ORDER BY t.name, c.file_path, c.id, t.id LIMIT 100""",
    "exposed_services": f"WITH RECURSIVE {_EXPOSED} SELECT event_id AS finding_id, composed, project_id, full_path, EPOCH(last) AS last_deployment, is_deployed FROM exposed",
    "exposed_lineage": f"""WITH RECURSIVE {_EXPOSED}, s AS (SELECT name, min(id) AS definition_id FROM gl_definition GROUP BY name), i AS ({_INTRO}),
        n AS (SELECT event_id, count(*) AS services, bool_or(last IS NULL) AS unknown, bool_or({_case_any('full_path', paths.EXPOSED)}) AS critical FROM exposed GROUP BY 1),
        r AS (SELECT fs.event_id AS finding_id, u.username AS author, 3 + CASE WHEN i.mr_id IS NULL THEN 0 ELSE 1 END + CASE WHEN u.username IS NULL THEN 0 ELSE 1 END AS steps, composed,
                coalesce(services, 0) AS services, coalesce(unknown, false) AS unknown, coalesce(critical, false) AS critical
              FROM fs JOIN s ON s.name = fs.name LEFT JOIN n ON n.event_id = fs.event_id LEFT JOIN i ON i.definition_id = s.definition_id LEFT JOIN gl_merge_request m ON m.id = i.mr_id LEFT JOIN gl_user u ON u.id = m.author_id)
        SELECT finding_id, author, CAST(steps AS INTEGER) AS steps, composed, services, critical, round(least(1, greatest(0, {_D.format(0.99)} - (5 - steps) * {_D.format(0.1)}
          - CASE WHEN unknown THEN {_D.format(0.05)} ELSE 0 END + CASE WHEN composed THEN {_D.format(0.01)} ELSE 0 END)), 6) AS confidence FROM r""",
    "composed_grid": _COMPOSED_SQL,
    "typed_lineage": f"""WITH i AS ({_INTRO}) SELECT f.id AS finding_id, d.name AS symbol, d.id AS definition_id, i.mr_id, u.username AS author FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id
        JOIN i ON i.definition_id = d.id JOIN gl_merge_request m ON m.id = i.mr_id JOIN gl_user u ON u.id = m.author_id WHERE f.severity IN ('HIGH', 'CRITICAL')""",
    "typed_traversal": "SELECT id, name, file_path FROM gl_definition WHERE project_id = 3 AND definition_type = 'Class'",
}


_SQL |= edits.sql(_EVENT_WALK, _TEST_SQL, _NEAR, _SCARS.strip(), _MARKED, _BLAST, _KEYSTONES, _pagerank_sql(None), _case_any("file_path", paths.SECURITY), _case_any("file_path", paths.PAYMENTS))
_SQL |= lookups.sql(_SQL["call_components"], _SQL["pagerank_top"], _EVENT_WALK, _case_any("file_path", paths.SECURITY), _case_any("file_path", paths.PAYMENTS))
_SQL |= replay.sql(_EVENT_WALK)


def queries() -> dict[str, Query]:
    return {**{name: _named(name) for name in QUERIES}, **{f.__name__: f for f in (*_FUNCTIONS, *edits.FUNCTIONS, *lookups.FUNCTIONS, *replay.FUNCTIONS)}}


def oracle_sql() -> dict[str, str]:
    return {name: for_duckdb(sql).replace("AS STRING)", "AS VARCHAR)") for name, sql in {**QUERIES, **_SQL}.items()}
