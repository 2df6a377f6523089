"""One verdict per event: traversal once, then all lenses on its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..durable import Scratch
from ..functions import paths, textdiff
from ..session import ship
from . import centrality, cutsets, cutvertex, history, reach, scoring, traverse


class Impact:
    """The shared results of a batch of events, computed once and read by every lens.

    ``events`` has (event_id, changed_symbol, edit_class), one row per changed symbol; ``ranks`` (id, rank)
    are PageRank ranks that an earlier batch has computed.
    """

    def __init__(self, events: DataFrame, definitions: DataFrame, calls: DataFrame, ranks: DataFrame | None = None) -> None:
        spark = events.sparkSession
        ship(spark)
        self.scratch = Scratch(spark, "impact")
        self.events, self.definitions, self.calls = events, definitions, calls
        self.seeds = traverse.seeds_of(events, definitions)
        # Walks start from names; events share them.  What an event reaches is then a join and one aggregate.
        #: (event_id, name): changed names by their hashes.
        self.changed = traverse.changed_names(events, self.scratch)
        self.names = self.scratch.save(traverse.names_of(events, definitions), "names", release=False)
        self._reach: DataFrame | None = None
        self._names: DataFrame | None = None
        self._listed: DataFrame | None = None
        self._summary: DataFrame | None = None
        self._places: DataFrame | None = None
        self._first_cuts: DataFrame | None = None
        self._ranks = ranks

    @property
    def places(self) -> DataFrame:
        """Definitions by place; see ``reach``."""
        if self._places is None:
            self._places = reach.numbered(self.definitions, self.scratch)
        return self._places

    def digests(self, top: int | None, label: Column | None = None, slice_rows: int = reach.SLICE) -> DataFrame:
        """What each event reaches: counts, files and labels of files; see ``reach.digests``."""
        if self._names is None:
            self._names = self.scratch.save(reach.packed(self.reach, self.places), "packed", release=False)
        return reach.digests(self.changed, self._names, self.places, top, label, slice_rows)

    @property
    def reach(self) -> DataFrame:
        """(event_id, id, depth), ``event_id`` being a name's hash."""
        if self._reach is None:
            walked = traverse.callers_by_depth(self.names, self.calls, self.scratch, name="walk").groupBy("event_id", "id").agg(F.max("depth").alias("depth"))
            self._reach = self.scratch.save(walked, "reach", release=False)
        return self._reach

    @property
    def summary(self) -> DataFrame:
        """The digest that lenses share: the first files, and areas."""
        if self._summary is None:
            self._summary = self.scratch.save(self.digests(scoring.TOP_FILES, scoring.area(F.col("file_path"))), "summary")
        return self._summary

    @property
    def files(self) -> DataFrame:
        """(event_id, file_path, affected, rank): all files of all events, made anew for each reader."""
        return reach.file_counts(self.digests(None, slice_rows=reach.LISTED), self.places)

    @property
    def top_files(self) -> DataFrame:
        """The first ``TOP_FILES`` of ``files``."""
        return reach.file_counts(self.summary, self.places)

    @property
    def areas(self) -> DataFrame:
        """(event_id, area, definitions, files, rank); what scoring.owner_areas gives."""
        rows = reach.label_counts(self.summary, reach.labels_of(self.places, scoring.area(F.col("file_path"))))
        return scoring.ranked_areas(rows.withColumnRenamed("label", "area"))

    def split(self, label: Column) -> DataFrame:
        """(event_id, label, definitions, files): what each event reaches by a label of paths."""
        return reach.label_counts(self.digests(0, label), reach.labels_of(self.places, label))

    def totals(self) -> DataFrame:
        """(event_id, total_dependents, affected_services, max_depth)."""
        return reach.totals(self._summary if self._summary is not None else self.digests(0))

    def services(self) -> DataFrame:
        """(event_id, project_id): from what events reach where that is known, else carried down the calls without a row for a name and definition."""
        if self._summary is not None:
            return reach.services(self._summary)
        of_name = traverse.projects_reaching(self.names, self.definitions, self.calls, self.scratch)
        return self.changed.join(of_name.withColumnRenamed("event_id", "name"), "name").select("event_id", "project_id").distinct()

    def near(self) -> DataFrame:
        """(event_id, path, weight): the files around what each event changes."""
        return traverse.neighbourhood_of_events(self.changed, traverse.neighbourhood(self.names, self.calls, self.definitions), self.scratch)

    @property
    def listed(self) -> DataFrame:
        """(name, id, symbol, inbound, place): the heaviest definitions of each name, seeds and callers, in one order of all."""
        if self._listed is None:
            rows = history.heaviest(self.names, self.reach.select("event_id", "id"), centrality.degrees(self.calls), self.definitions)
            self._listed = self.scratch.save(history.placed(rows, self.scratch), "listed", release=False)
        return self._listed

    def blast(self) -> DataFrame:
        """(event_id, id, name, inbound, weight): seeds and callers, the heaviest of an event, which are among those of its names."""
        return history.of_listed(self.changed, self.listed)

    def blamed(self, blame: DataFrame) -> DataFrame:
        """The rows of ``blame`` that ``blast`` can meet, to be sent to all executors where these are few."""
        rows = self.scratch.save(blame.join(self.listed.select(F.col("id").alias("definition_id")).distinct(), "definition_id", "left_semi"), "blamed")
        return reach.few(rows, 4 * reach.SENT)

    def _cuts(self) -> DataFrame:
        """``cuts`` with names by their hashes."""
        if self._first_cuts is None:
            pairs = self.scratch.save(self.calls.where("source_id <> target_id").select("source_id", "target_id").distinct(), "pairs", release=False)
            if pairs.count() + self.definitions.count() <= cutsets.HELD:
                rows = cutsets.first_cuts(self.changed, self.names, pairs, self.definitions, scoring.TOP_CUTS, scoring.SHOWN_CUTS)
            else:
                nodes = traverse.closure(self.names, self.calls, self.scratch)
                # Closures hold all callers of their nodes, so an event's graph is that of its names together.
                edges = self.scratch.save(traverse.induced_edges(nodes, pairs), "induced", release=False)
                rows = scoring.named_cuts(cutvertex.chokepoints(traverse.of_events(self.events, edges), self.scratch), self.definitions, self.seeds).withColumn("name", F.xxhash64("name"))
            self._first_cuts = self.scratch.save(rows.select("event_id", "name", "isolated", "parts", "is_changed", "place"), "cuts")
        return self._first_cuts

    def cuts(self) -> DataFrame:
        """(event_id, name, isolated, parts, is_changed, place)."""
        names = self.definitions.select("name", F.xxhash64("name").alias("_name")).distinct()
        return self._cuts().withColumnRenamed("name", "_name").join(names, "_name").select("event_id", "name", "isolated", "parts", "is_changed", "place")

    def keystones(self) -> DataFrame:
        return scoring.keystones(self.events, centrality.degrees(self.calls), self.definitions)

    def ranked_keystones(self) -> DataFrame:
        """(event_id, name, rank, pagerank_rank); ranks of the whole graph are computed once."""
        if self._ranks is None:
            scratch = Scratch(self.events.sparkSession, "ranks")
            self._ranks = centrality.ranked(centrality.pagerank(self.calls, scratch), scratch)
        return scoring.with_ranks(self.keystones(), self._ranks, self.definitions)

    def verdicts(self, controls: DataFrame | None = None, scars: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
        """One row per event with all lens values, the blended risk and the decision.

        Optional: ``controls`` (event_id, approved boolean, pipeline string), ``scars`` (event_id,
        prior double), ``findings`` (event_id, severity); what is absent counts as unknown.
        """
        spark = self.events.sparkSession
        controls = controls if controls is not None else spark.createDataFrame([], "event_id long, approved boolean, pipeline string")
        scars = scars if scars is not None else spark.createDataFrame([], "event_id long, prior double")
        findings = findings if findings is not None else spark.createDataFrame([], "event_id long, severity string")
        per_event = self.events.groupBy("event_id").agg(F.max_by("edit_class", F.struct(textdiff.edit_danger(F.col("edit_class")), "edit_class")).alias("edit_class"))
        top = self.top_files
        path = F.col("file_path")
        reach = top.groupBy("event_id").agg(
            F.bool_or(paths.is_critical(path)).alias("critical"), F.count_if(F.lower(path).contains("private")).alias("n_private"),
            F.bool_or(F.lower(path).contains("generated") | F.lower(path).contains("/gen/")).alias("any_generated"),
            F.array_sort(F.collect_set(paths.boundary(path))).alias("crossed"))
        areas = self.areas.where(F.col("rank") <= scoring.TOP_OWNERS)
        owners = areas.groupBy("event_id").agg(F.count("*").alias("bus_factor"), (F.max("definitions") / F.sum("definitions")).alias("concentration"))
        keys = self.keystones().groupBy("event_id").agg(F.count("*").alias("n_keystones"))
        cuts = self._cuts().groupBy("event_id").agg(F.bool_or("is_changed").alias("changed_cut"), F.count("*").alias("n_cuts"))
        row = per_event
        for part in (self.totals(), reach, owners, keys, cuts, controls, scars, findings):
            row = row.join(part, "event_id", "left")
        zero = {"total_dependents": 0, "affected_services": 0, "max_depth": 0, "n_private": 0, "bus_factor": 0, "n_keystones": 0, "n_cuts": 0}
        row = row.fillna(zero).fillna({"critical": False, "any_generated": False, "changed_cut": False})
        has_owner = F.col("bus_factor") > 0
        row = (row.withColumn("cfr", scoring.change_failure_rate(F.col("n_keystones"), F.col("total_dependents"), F.col("changed_cut"), F.col("critical"), F.col("prior")))
               .withColumn("confidence", scoring.impact_confidence(F.col("n_private"), F.col("any_generated")))
               .withColumn("ownership", F.when(has_owner, scoring.ownership_risk(F.col("concentration"), F.col("bus_factor"), F.col("n_keystones") > 0)))
               .withColumn("danger", textdiff.edit_danger(F.col("edit_class"))))
        row = scoring.controlled(row)
        yes = F.lit(True)
        row = row.withColumn("parts", scoring.risk_parts(F.col("cfr"), F.col("total_dependents"), F.col("n_keystones"), F.col("severity"), F.col("ownership"), F.col("compliance"), yes))
        row = row.withColumn("risk", scoring.blended(F.col("parts"), F.col("danger"))).withColumn("level", scoring.risk_level(F.col("risk")))
        row = row.withColumn("action", scoring.decision(F.col("level"), F.col("n_keystones"), F.col("danger"), yes, F.col("confidence")))
        return row.select("event_id", "edit_class", "total_dependents", "affected_services", "max_depth", "n_keystones", "n_cuts", "changed_cut", "critical",
                          F.array_join("crossed", ",").alias("crossed"), "concentration", "bus_factor", "cfr", "confidence", "ownership", "compliance", "danger", "risk", "level", "action")
