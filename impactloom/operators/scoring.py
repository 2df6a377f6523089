"""The risk model as column expressions over one wide row per event, so a batch of events is one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..durable import Scratch
from ..functions import paths
from . import traverse

TOP_FILES, TOP_OWNERS, TOP_KEYSTONES, MIN_DEGREE, TOP_CUTS, SHOWN_CUTS = 6, 5, 30, 10, 20, 5
EXPOSED_DEPTH, SHOWN_CATCHES = 10, 6


def _d(v: float) -> Column:
    return F.lit(float(v))


def file_impact(per: DataFrame) -> DataFrame:
    """(event_id, file_path, affected, rank) of rows (event_id, file_path, affected): largest first, ties by path."""
    return per.select("event_id", "file_path", "affected").withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("affected"), "file_path")))


def area(path: Column) -> Column:
    """The first two segments of a path; null for none."""
    return F.when(path != "", paths.module_of(path))


def ranked_areas(per: DataFrame) -> DataFrame:
    """Adds ``rank`` to (event_id, area, definitions, files): most definitions first, ties by area."""
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("definitions"), "area")))


def owner_areas(files: DataFrame) -> DataFrame:
    """(event_id, area, definitions, files, rank): files by their first two path segments."""
    per = files.where("file_path <> ''").groupBy("event_id", area(F.col("file_path")).alias("area")).agg(F.sum("affected").alias("definitions"), F.count("*").alias("files"))
    return ranked_areas(per)


def keystones(events: DataFrame, degrees: DataFrame, definitions: DataFrame) -> DataFrame:
    """(event_id, name, rank): changed names among the most connected definitions, matched without case."""
    top = (degrees.join(definitions.select("id", "name"), "id").withColumn("total", F.col("inbound") + F.col("outbound")).where(F.col("total") > MIN_DEGREE)
           .orderBy(F.desc("total"), "id").limit(TOP_KEYSTONES))
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "id")))  # over TOP_KEYSTONES rows
    first = top.groupBy(F.lower("name").alias("low")).agg(F.min("rank").alias("rank"), F.min_by("name", "rank").alias("name"))
    changed = events.select("event_id", F.lower("changed_symbol").alias("low")).distinct()
    return changed.join(F.broadcast(first), "low").select("event_id", "name", "rank")  # at most TOP_KEYSTONES rows


def with_ranks(keys: DataFrame, ranks: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds ``pagerank_rank`` to keystones: the best rank (id, rank) of any definition of that name, 0 without one."""
    best = definitions.select("id", "name").join(ranks.select("id", F.col("rank").alias("place")), "id").groupBy("name").agg(F.min("place").alias("pagerank_rank"))
    return keys.join(best, "name", "left").select("event_id", "name", "rank", F.coalesce("pagerank_rank", F.lit(0).cast("long")).alias("pagerank_rank"))


def boundary_files(files: DataFrame, k: int = TOP_FILES, shown: int = SHOWN_CUTS) -> DataFrame:
    """(event_id, crossed, boundary_files): of an event's first ``k`` files those in control boundaries, ``shown`` by path."""
    top = files.where(F.col("rank") <= k).withColumn("category", paths.boundary(F.col("file_path"))).where("category IS NOT NULL")
    return top.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("crossed"),
                                       F.array_join(F.slice(F.array_sort(F.collect_set("file_path")), 1, shown), ",").alias("boundary_files"))


def named_cuts(cuts: DataFrame, definitions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(event_id, name, isolated, parts, is_changed, place): the first cut vertices that isolate something and have a name."""
    w = Window.partitionBy("event_id").orderBy(F.desc("isolated"), F.desc("parts"), "id")
    few = cuts.where("isolated > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= TOP_CUTS)
    named = few.join(definitions.select("id", "name"), "id").join(seeds.withColumn("is_changed", F.lit(True)), ["event_id", "id"], "left")
    first = named.groupBy("event_id", "name").agg(F.min("r").alias("r"), F.min_by("isolated", "r").alias("isolated"), F.min_by("parts", "r").alias("parts"),
                                                  F.min_by(F.coalesce("is_changed", F.lit(False)), "r").alias("is_changed"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy("r"))).where(F.col("place") <= SHOWN_CUTS).drop("r")


def service_map(reached: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, full_path, definitions, names) of dependents (id, name, file_path, project_id)."""
    by = reached.join(projects.select(F.col("id").alias("project_id"), "full_path"), "project_id").groupBy("project_id", "full_path")
    return by.agg(F.countDistinct("id").alias("definitions"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def affected_authors(reached: DataFrame, authorship: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, username, definitions, services): whose files hold dependents."""
    # A definition has one file, so files are counted before their many authors meet them.
    per = reached.groupBy("file_path", "project_id").agg(F.countDistinct("id").alias("n"))
    of = per.join(authorship.select("file_path", "user_id").distinct(), "file_path").groupBy("user_id", "project_id").agg(F.sum("n").alias("n"))
    both = of.groupBy("user_id").agg(F.sum("n").alias("definitions"), F.count("project_id").alias("services"))
    return both.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").select("user_id", "username", "definitions", "services")


def exposure(symbols: DataFrame, definitions: DataFrame, calls: DataFrame, projects: DataFrame, jobs: DataFrame, scratch: Scratch, max_depth: int = EXPOSED_DEPTH) -> DataFrame:
    """(symbol_id, project_id, full_path, last_deployment, is_deployed): projects from which a symbol (event_id, changed_symbol) can be reached."""
    seeds = scratch.save(traverse.names_of(symbols, definitions), "names", release=False)
    own = traverse.projects_reaching(seeds, definitions, calls, scratch, max_depth, own=True)
    last = jobs.where("job_type = 'deploy' AND status = 'success'").groupBy("project_id").agg(F.max("created_at").alias("last_deployment"))
    per = traverse.of_events(symbols, own).distinct().join(projects.select(F.col("id").alias("project_id"), "full_path"), "project_id").join(last, "project_id", "left")
    return per.select(F.col("event_id").alias("symbol_id"), "project_id", "full_path", "last_deployment", F.col("last_deployment").isNotNull().alias("is_deployed"))


def catches(verdicts: DataFrame, k: int = SHOWN_CATCHES) -> DataFrame:
    """The ``k`` escalated or contract-breaking events with the most dependents, ties by id."""
    return verdicts.where("action IN ('BLOCK', 'SENIOR_REVIEW') OR edit_class = 'contract-break'").orderBy(F.desc("total_dependents"), "event_id").limit(k)


def change_failure_rate(n_keystones: Column, dependents: Column, changed_cut: Column, critical: Column, scar: Column) -> Column:
    size = F.when(dependents >= 300, 0.15).when(dependents >= 100, 0.10).when(dependents >= 25, 0.05).otherwise(0.0)
    raw = (_d(0.05) + F.least(_d(0.18), n_keystones * _d(0.06)) + size + F.when(changed_cut, 0.08).otherwise(0.0) + F.when(critical, 0.05).otherwise(0.0)
           + F.greatest(_d(0), F.least(_d(0.12), F.coalesce(scar, _d(0)))))
    return F.least(_d(0.90), raw)


def impact_confidence(n_private: Column, any_generated: Column) -> Column:
    return F.greatest(_d(0), _d(0.95) - n_private * _d(0.05) - F.when(any_generated, 0.10).otherwise(0.0))


def ownership_risk(concentration: Column, bus_factor: Column, has_keystones: Column) -> Column:
    return F.when((bus_factor <= 1) | (concentration >= 0.90), "HIGH").when((concentration >= 0.60) | has_keystones, "MEDIUM").otherwise("LOW")


def control(known: Column, passed: Column) -> Column:
    return F.when(~known, "NEEDS_DATA").when(passed, "PASS").otherwise("FAIL")


def compliance_risk(crossed: Column, any_fail: Column, needs_data: Column) -> Column:
    return F.when(any_fail, "HIGH").when(crossed & needs_data, "MEDIUM").otherwise("LOW")


def controlled(rows: DataFrame) -> DataFrame:
    """Adds approval_control, pipeline_control and compliance to rows with approved, pipeline and the array crossed; null controls are unknown."""
    crossed = F.size(F.coalesce("crossed", F.array())) > 0
    rows = rows.withColumns({"approval_control": control(F.col("approved").isNotNull(), F.coalesce("approved", F.lit(False))),
                             "pipeline_control": control(F.col("pipeline").isNotNull(), F.coalesce(F.col("pipeline") == "passed", F.lit(False)))})
    states = [F.col("approval_control"), F.col("pipeline_control")]
    return rows.withColumn("compliance", compliance_risk(crossed, crossed & ((states[0] == "FAIL") | (states[1] == "FAIL")), (states[0] == "NEEDS_DATA") | (states[1] == "NEEDS_DATA")))


def provenance_confidence(missing_steps: Column, any_undeployed: Column, composed: Column) -> Column:
    return _d(0.99) - missing_steps * _d(0.1) - F.when(any_undeployed, 0.05).otherwise(0.0) + F.when(composed, 0.01).otherwise(0.0)


def risk_parts(cfr: Column, dependents: Column, n_keystones: Column, severity: Column, ownership: Column, compliance: Column, has_impact: Column) -> Column:
    magnitude = F.when(dependents >= 300, 0.85).when(dependents >= 100, 0.65).when(dependents >= 25, 0.45).otherwise(0.20)
    level = lambda c, high, medium, low, other: F.when(c.isNull(), None).when(c == "HIGH", high).when(c == "MEDIUM", medium).when(c == "LOW", low).otherwise(other)
    sev = F.when(severity.isNull(), None).when(severity == "CRITICAL", 0.95).when(severity == "HIGH", 0.80).when(severity == "MEDIUM", 0.60).when(severity == "LOW", 0.30).otherwise(0.50)
    return F.array_compact(F.array(F.when(has_impact, cfr), F.when(has_impact, magnitude), F.when(has_impact & (n_keystones > 0), 0.90), sev,
                                   level(ownership, 0.85, 0.60, 0.25, 0.40), level(compliance, 0.90, 0.55, 0.25, 0.40)))


def blended(parts: Column, danger: Column) -> Column:
    mean = F.aggregate(parts, _d(0), lambda a, x: a + x) / F.size(parts)
    return F.when(F.size(parts) > 0, (F.array_max(parts) * _d(0.6) + mean * _d(0.4)) * F.coalesce(danger, _d(1)))


def risk_level(score: Column) -> Column:
    return F.when(score.isNull(), "UNKNOWN").when(score >= 0.80, "CRITICAL").when(score >= 0.60, "HIGH").when(score >= 0.40, "MEDIUM").otherwise("LOW")


def decision(level: Column, n_keystones: Column, danger: Column, has_impact: Column, confidence: Column) -> Column:
    return (F.when(level == "CRITICAL", "BLOCK").when((level == "HIGH") | ((n_keystones > 0) & (danger >= 0.5)), "SENIOR_REVIEW")
            .when(level == "MEDIUM", "REVIEW_REQUIRED").when((level == "LOW") & has_impact & (confidence >= 0.90), "AUTO_APPROVE").otherwise("REVIEW_REQUIRED"))
