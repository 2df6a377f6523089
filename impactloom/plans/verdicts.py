"""From events to verdicts: routing, lenses of findings, composition of lens results that are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..durable import Scratch
from ..functions import paths, spans, textdiff
from ..operators import scoring
from ..operators.impact import Impact
from ..streaming.intake import route

SHOWN_CALLERS, SHOWN_SYMBOLS, STEPS = 12, 3, 5


def keyed(events: DataFrame) -> DataFrame:
    """Adds ``key``, a number for each event id; operators take numbers as ids."""
    return route(events).withColumn("key", F.xxhash64("event_id"))


def changes(events: DataFrame) -> DataFrame:
    """(event_id, changed_symbol, edit_class) of keyed change events; an event without symbols has no row."""
    edit = F.coalesce("payload.edit_semantics.edit_class", "payload.edit_class", F.lit("unknown"))
    return events.where("kind = 'change'").select(F.col("key").alias("event_id"), F.explode("payload.changed_symbols").alias("changed_symbol"), edit.alias("edit_class"))


def findings(events: DataFrame) -> DataFrame:
    """(event_id, nth, finding_id, title, severity, affected_symbol): listed in changes, or events of their own."""
    own = F.struct(*(F.col(f"payload.{c}").alias(c) for c in ("finding_id", "title", "severity", "cvss_score", "affected_symbol")))
    listed = F.when(F.col("kind") == "finding", F.array(own)).when(F.col("kind") == "change", F.col("payload.findings"))
    return events.select(F.col("key").alias("event_id"), F.posexplode(listed).alias("nth", "f")).select("event_id", "nth", "f.finding_id", "f.title", "f.severity", "f.affected_symbol")


def provenance(found: DataFrame, changed: DataFrame, source) -> DataFrame:
    """The lineage of findings, one row each.

    (event_id, nth, finding_id, title, severity, affected_symbol, definition_id, mr_id, author, projects, deployed,
    steps, composed, critical, confidence).  A symbol with namesakes is its smallest definition id.  The
    lens is *composed* where the event changes that symbol.  Steps that are not found lower the confidence.
    """
    t = source.table
    d = t("gl_definition").groupBy(F.col("name").alias("affected_symbol")).agg(F.min("id").alias("definition_id"), F.min_by("project_id", "id").alias("project_id"))
    intro = t("gl_definition_history").groupBy("definition_id").agg(F.min_by("merge_request_id", F.struct("created_at", "merge_request_id")).alias("mr_id"))
    mr = t("gl_merge_request").select(F.col("id").alias("mr_id"), "author_id")
    user = t("gl_user").select(F.col("id").alias("author_id"), F.col("username").alias("author"))
    deployed = t("gl_job").where("job_type = 'deploy' AND status = 'success'").groupBy("project_id").agg(F.max("created_at").alias("last_deployment"))
    project = t("gl_project").select(F.col("id").alias("project_id"), "full_path")
    own = changed.select("event_id", F.col("changed_symbol").alias("affected_symbol"), F.lit(True).alias("composed")).distinct()
    row = (found.join(own, ["event_id", "affected_symbol"], "left").join(d, "affected_symbol", "left").join(intro, "definition_id", "left").join(mr, "mr_id", "left")
           .join(user, "author_id", "left").join(project, "project_id", "left").join(deployed, "project_id", "left"))
    steps = F.lit(1) + sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("affected_symbol", "definition_id", "mr_id", "author")), F.lit(0))
    composed = F.coalesce("composed", F.lit(False))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), scoring.provenance_confidence(F.lit(STEPS) - F.col("steps"), F.col("last_deployment").isNull(), F.col("composed"))))
    return (row.withColumn("steps", steps).withColumn("composed", composed)
            .select("event_id", "nth", "finding_id", "title", "severity", "affected_symbol", "definition_id", "mr_id", "author", F.col("full_path").alias("project"), "last_deployment", "steps", "composed",
                    paths.holds(F.col("full_path"), paths.EXPOSED).alias("critical"), confidence.alias("confidence")))


def exposed(found: DataFrame, impact: Impact, source) -> DataFrame:
    """The services that are exposed to findings: (event_id, nth, composed, project_id, full_path, last_deployment, is_deployed).

    Where an event changes the symbol of its finding, those are the services of all that the event reaches, from the
    traversal that its verdict rests on; they count as deployed and no deployment is looked up.  Else they are those
    from which the symbol can be reached by up to ten calls, its own included, walked once for each symbol.  A finding
    without a symbol, or with one that nothing defines, has no row.
    """
    t = source.table
    changed = impact.events.select("event_id", F.col("changed_symbol").alias("affected_symbol")).distinct()
    rows = found.where("affected_symbol IS NOT NULL").select("event_id", "nth", "affected_symbol").join(changed.withColumn("own", F.lit(True)), ["event_id", "affected_symbol"], "left")
    rows = impact.scratch.save(rows.select("event_id", "nth", "affected_symbol", F.coalesce("own", F.lit(False)).alias("composed")), "exposed", release=False)
    project = t("gl_project").select(F.col("id").alias("project_id"), "full_path")
    shared = (rows.where("composed").join(impact.services(), "event_id").join(project, "project_id")
              .select("event_id", "nth", "composed", "project_id", "full_path", F.lit(None).cast("timestamp").alias("last_deployment"), F.lit(True).alias("is_deployed")))
    alone = rows.where("NOT composed").withColumn("symbol_id", F.xxhash64("affected_symbol"))
    symbols = alone.select(F.col("symbol_id").alias("event_id"), F.col("affected_symbol").alias("changed_symbol")).distinct()
    own = scoring.exposure(symbols, t("gl_definition"), t("gl_calls"), t("gl_project"), t("gl_job"), Scratch(found.sparkSession, "exposed"))  # names of its own, beside the events'
    return shared.unionByName(alone.join(own, "symbol_id").select("event_id", "nth", "composed", "project_id", "full_path", F.col("last_deployment").cast("timestamp").alias("last_deployment"), "is_deployed"))


def exposed_lineage(lineage: DataFrame, exposure: DataFrame) -> DataFrame:
    """``provenance`` rows with ``services``, the number of exposed services, and the confidence and criticality that follow from them.

    A service without a known deployment lowers the confidence; any critical one makes the finding critical.
    """
    per = exposure.groupBy("event_id", "nth").agg(F.count("*").alias("services"), F.bool_or(F.col("last_deployment").isNull()).alias("unknown"), F.bool_or(paths.holds(F.col("full_path"), paths.EXPOSED)).alias("_critical"))
    rows = lineage.drop("critical", "confidence").join(per, ["event_id", "nth"], "left").fillna({"services": 0, "unknown": False, "_critical": False})
    confidence = scoring.provenance_confidence(F.lit(STEPS) - F.col("steps"), F.col("unknown"), F.col("composed"))
    return rows.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))).withColumnRenamed("_critical", "critical").drop("unknown")


def compose(rows: DataFrame) -> DataFrame:
    """Adds ``danger``, ``risk``, ``level`` and ``action`` to rows of lens results.

    Reads has_impact, cfr, total_dependents, n_keystones, confidence, severity, ownership, compliance
    and edit_class.  A lens that is null has no part; without any the level is UNKNOWN.
    """
    c = F.col
    edit = c("edit_class")
    rows = rows.withColumn("danger", F.when(edit.isNull(), 1.0).otherwise(textdiff.edit_danger(edit)))
    keys = F.coalesce(c("n_keystones"), F.lit(0))
    parts = scoring.risk_parts(F.coalesce(c("cfr"), F.lit(0.0)), F.coalesce(c("total_dependents"), F.lit(0)), keys, c("severity"), c("ownership"), c("compliance"), c("has_impact"))
    rows = rows.withColumn("risk", scoring.blended(parts, c("danger"))).withColumn("level", scoring.risk_level(c("risk")))
    return rows.withColumn("action", scoring.decision(c("level"), keys, c("danger"), c("has_impact"), F.coalesce(c("confidence"), F.lit(0.0))))


def compose_lenses(lenses: DataFrame) -> DataFrame:
    """(event_id, event_type, risk, level, action) from rows of ``events.LENSES``: lens results computed elsewhere."""
    given = lenses.select("event_id", "event_type", "edit_class", F.col("impact").isNotNull().alias("has_impact"), F.col("impact.change_failure_rate").alias("cfr"), F.col("impact.total_dependents").alias("total_dependents"),
                          F.coalesce(F.array_size("impact.keystone_symbols"), F.lit(0)).alias("n_keystones"), F.col("impact.confidence").alias("confidence"), F.when(F.col("provenance").isNotNull(), F.coalesce("provenance.severity", F.lit("?"))).alias("severity"),
                          F.when(F.col("ownership").isNotNull(), F.coalesce("ownership.risk_level", F.lit("?"))).alias("ownership"), F.when(F.col("compliance").isNotNull(), F.coalesce("compliance.risk_level", F.lit("?"))).alias("compliance"))
    return compose(given).select("event_id", "event_type", "edit_class", "total_dependents", "risk", "level", "action")


class Scored:
    """Verdicts of a batch of events of all kinds (rows of ``events.EVENT``) over one source."""

    def __init__(self, events: DataFrame, source) -> None:
        events = keyed(events)
        self.source = source
        self.found = findings(events)
        self.changed = changes(events)
        self.impact = Impact(self.changed, source.table("gl_definition"), source.table("gl_calls"))
        # One wide row per event is small next to the graph and read by several lenses.
        self.events = self.impact.scratch.save(events.select("key", "event_id", "event_type", "kind", "payload"), "events", release=False)
        self._lineage: DataFrame | None = None

    @property
    def lineage(self) -> DataFrame:
        """The lineage of findings with what is exposed to them."""
        if self._lineage is None:
            self._lineage = exposed_lineage(provenance(self.found, self.changed, self.source), exposed(self.found, self.impact, self.source))
        return self._lineage

    def verdicts(self) -> DataFrame:
        """One row per event; the last finding of an event gives its severity, unknown events need a review."""
        e = self.events
        last = self.found.groupBy("event_id").agg(F.max_by("severity", "nth").alias("severity"))
        controls = e.select(F.col("key").alias("event_id"), F.col("payload.mr_meta.approvals.non_author_approved").alias("approved"),
                            F.when(F.col("payload.mr_meta.pipeline_status") == "success", "passed").otherwise(F.col("payload.mr_meta.pipeline_status")).alias("pipeline"))
        scars = e.select(F.col("key").alias("event_id"), F.col("payload.scar_analysis.prior").alias("prior"))
        by_change = self.impact.verdicts(controls, scars, last.where("severity IS NOT NULL")).drop("edit_class", "danger", "risk", "level", "action").withColumnRenamed("event_id", "key").withColumn("has_impact", F.lit(True))
        edit = F.coalesce("payload.edit_semantics.edit_class", "payload.edit_class")
        rows = (e.select("key", "event_id", "event_type", "kind", edit.alias("edit_class")).join(by_change, "key", "left")
                .join(last.withColumnRenamed("event_id", "key"), "key", "left").withColumn("has_impact", F.coalesce("has_impact", F.lit(False))))
        return compose(rows)

    def reports(self) -> DataFrame:
        """Verdicts with short lists of what they rest on, as arrays: what renderers need, one row per event."""
        i = self.impact
        path = F.col("file_path")
        w = Window.partitionBy("event_id")
        first = lambda df, order, k: df.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= k)
        callers = (i.seeds.join(i.calls, i.seeds["id"] == i.calls["target_id"]).select("event_id", F.col("source_id").alias("id")).distinct()
                   .join(i.definitions.select("id", "name", "file_path", "start_line"), "id"))
        parts = [
            _listed("symbols", first(self.changed.select("event_id", "changed_symbol").distinct(), ["changed_symbol"], SHOWN_SYMBOLS), "changed_symbol"),
            _listed("files", i.top_files.withColumnRenamed("rank", "place").withColumn("critical", paths.is_critical(path)), "file_path", "affected", "critical"),
            _listed("areas", i.areas.where(F.col("rank") <= scoring.TOP_OWNERS).withColumnRenamed("rank", "place"), "area", "definitions"),
            _listed("keystones", i.ranked_keystones().withColumnRenamed("rank", "place"), "name", "pagerank_rank"),
            _listed("cuts", i.cuts(), "name", "isolated", "is_changed"),
            _listed("callers", first(callers, ["file_path", "start_line", "id"], SHOWN_CALLERS), "name", "file_path", "start_line"),
            _listed("lineage", self.lineage.withColumnRenamed("nth", "place"), "finding_id", "title", "severity", "affected_symbol", "mr_id", "author", "project", "confidence"),
        ]
        rows = self.verdicts()
        for part in parts:
            rows = rows.join(part.withColumnRenamed("event_id", "key"), "key", "left")
        return rows


def _listed(name: str, rows: DataFrame, *columns: str) -> DataFrame:
    """(event_id, <name>): the rows of each event as one array in the order of ``place``; callers bound their number."""
    return rows.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias(name))


def change_of(diffs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(event_id, changed_symbol) from diffs (event_id, diff): definitions whose span meets the changed lines of their file.

    Where no definition of an event's files is met, names that added lines define stand in.
    """
    from ..sources import git

    lines = git.diff_headers(diffs)
    start = F.regexp_extract("header", r"\+(\d+)", 1).try_cast("long")
    count = F.greatest(F.coalesce(F.nullif(F.regexp_extract("header", r"\+\d+,(\d+)", 1), F.lit("")).try_cast("long"), F.lit(1)), F.lit(1))
    span = lines.where(start.isNotNull()).groupBy("event_id", textdiff.plain_path(F.col("path")).alias("base")).agg(F.min(start).alias("lo"), F.max(start + count - 1).alias("hi"))
    met = spans.meeting(definitions.where("name IS NOT NULL"), span).select("event_id", F.col("name").alias("changed_symbol")).distinct()
    added = git.added_lines(diffs).select("event_id", textdiff.header_symbols(F.col("line")).alias("changed_symbol")).where("changed_symbol <> ''").distinct()
    return met.unionByName(added.join(met.select("event_id").distinct(), "event_id", "left_anti"))


