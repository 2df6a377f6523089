"""The typed query surface: named queries with parameters, and the small JSON query language."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..durable import Scratch
from ..functions import paths
from ..operators import centrality, scoring, traverse

Names = Iterable[str] | DataFrame
ENTITIES = {"Definition": "gl_definition", "Finding": "gl_finding", "User": "gl_user", "MergeRequest": "gl_merge_request", "Project": "gl_project", "File": "gl_file"}
LIMIT = 1000


class GraphQueries:
    """Named queries over a source (``GraphTables`` or ``GraphSource``).

    Names and ids are lists or, where they are many, DataFrames of one column; they are joined and
    never pasted into text.  Unknown names, entities and operators raise.
    """

    def __init__(self, source) -> None:
        self.source = source
        self.spark = source.spark
        self.typed: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (
            self.transitive_dependents, self.affected_services, self.affected_owners, self.ownership_centrality, self.symbol_definition, self.subgraph_edges,
            self.definitions_by_id, self.all_call_edges, self.symbol_defs, self.direct_callers, self.called_symbols, self.lineage, self.mr_metadata, self.finding_metadata)}

    def query(self, name: str, **params) -> DataFrame:
        if name not in self.typed:
            raise ValueError(f"unknown query {name}; there are {', '.join(sorted(self.typed))}")
        return self.typed[name](**params)

    def _column(self, values, name: str, kind: str) -> DataFrame:
        if isinstance(values, DataFrame):
            return values.select(F.col(values.columns[0]).cast(kind).alias(name)).distinct()
        return self.spark.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{name} {kind}")

    def _named(self, symbols: Names) -> DataFrame:
        return self.source.table("gl_definition").join(self._column(symbols, "name", "string"), "name", "left_semi")

    def _seeds(self, symbols: Names) -> DataFrame:
        return self._named(symbols).select(F.lit(1).cast("long").alias("event_id"), "id").distinct()

    def _dependents(self, symbols: Names) -> DataFrame:
        walked = traverse.callers_by_depth(self._seeds(symbols), self.source.table("gl_calls"), Scratch(self.spark, "dependents"))
        return traverse.dependents(walked.groupBy("event_id", "id").agg(F.max("depth").alias("depth")), self.source.table("gl_definition"))

    def transitive_dependents(self, symbols: Names) -> DataFrame:
        """(total_dependents, affected_services, max_depth), one row also where there are none."""
        return self._dependents(symbols).agg(F.countDistinct("id").alias("total_dependents"), F.countDistinct("project_id").alias("affected_services"),
                                             F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))

    def affected_services(self, symbols: Names) -> DataFrame:
        """(service_id, file_path, affected, is_critical, is_test): files, most affected first."""
        path = F.col("file_path")
        return scoring.file_impact(self._dependents(symbols).groupBy("event_id", "file_path").agg(F.count("*").alias("affected"))).select(F.concat(F.lit("f"), "rank").alias("service_id"), "file_path", "affected", paths.is_critical(path).alias("is_critical"), paths.is_test(path).alias("is_test"))

    def affected_owners(self, symbols: Names) -> DataFrame:
        """(area_id, area, definitions, files)."""
        return scoring.owner_areas(scoring.file_impact(self._dependents(symbols).groupBy("event_id", "file_path").agg(F.count("*").alias("affected")))).select(F.concat(F.lit("area-"), "rank").alias("area_id"), "area", "definitions", "files")

    def ownership_centrality(self, least: int = scoring.MIN_DEGREE, k: int = scoring.TOP_KEYSTONES) -> DataFrame:
        """(id, name, definition_type, inbound, outbound) of the most connected definitions."""
        d = self.source.table("gl_definition").select("id", "name", "definition_type").join(centrality.degrees(self.source.table("gl_calls")), "id")
        total = F.col("inbound") + F.col("outbound")
        return d.where(total > least).orderBy(total.desc(), "id").limit(k).select("id", "name", "definition_type", "inbound", "outbound")

    def symbol_defs(self, symbols: Names) -> DataFrame:
        """(id, name, inbound) of all namesakes."""
        called = self.source.table("gl_calls").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("inbound"))
        return self._named(symbols).select("id", "name").join(called, "id", "left").fillna({"inbound": 0})

    def symbol_definition(self, symbol: str | DataFrame) -> DataFrame:
        """The namesake that is called most, with its place in the code."""
        d = self.source.table("gl_definition").select("id", "fqn", "file_path", "start_line", "end_line", "definition_type", "project_id")
        return self.symbol_defs(symbol if isinstance(symbol, DataFrame) else [symbol]).orderBy(F.desc("inbound"), "id").limit(1).join(d, "id")

    def subgraph_edges(self, symbols: Names) -> DataFrame:
        """(source_id, target_id, source_is_root, target_is_root): calls within the closure, multiplicity kept."""
        seeds = self._seeds(symbols)
        calls = self.source.table("gl_calls")
        nodes = traverse.closure(seeds, calls, Scratch(self.spark, "closure"))
        roots = seeds.select("id", F.lit(True).alias("root"))
        edges = traverse.induced_edges(nodes, calls)
        return (edges.join(roots.withColumnsRenamed({"id": "source_id", "root": "s"}), "source_id", "left").join(roots.withColumnsRenamed({"id": "target_id", "root": "t"}), "target_id", "left")
                .select("source_id", "target_id", F.coalesce("s", F.lit(False)).alias("source_is_root"), F.coalesce("t", F.lit(False)).alias("target_is_root")))

    def definitions_by_id(self, ids) -> DataFrame:
        return self.source.table("gl_definition").join(self._column(ids, "id", "long"), "id", "left_semi").select("id", "name", "file_path")

    def all_call_edges(self) -> DataFrame:
        return self.source.table("gl_calls").select("source_id", "target_id")

    def direct_callers(self, symbols: Names) -> DataFrame:
        """(id, name, fqn, file_path, start_line, is_test), ordered by place."""
        by = self.source.table("gl_calls").join(self._seeds(symbols).select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
        return (self.source.table("gl_definition").join(by, "id", "left_semi").select("id", "name", "fqn", "file_path", "start_line", paths.is_test(F.col("file_path")).alias("is_test"))
                .distinct().orderBy("file_path", "start_line", "id"))

    def called_symbols(self, symbols: Names, limit: int = 100) -> DataFrame:
        """(id, name, definition_type, file_path, called_symbol): who calls which of the symbols, a row for each call, the first ``limit`` by symbol, path and id.

        Only ``limit`` rows are ordered; a call that is listed twice has two rows.
        """
        called = self._named(symbols).select(F.col("id").alias("target_id"), F.col("name").alias("called_symbol"))
        callers = self.source.table("gl_definition").select(F.col("id").alias("source_id"), "name", "definition_type", "file_path")
        rows = self.source.table("gl_calls").join(called, "target_id").join(callers, "source_id").select(F.col("source_id").alias("id"), "name", "definition_type", "file_path", "called_symbol", "target_id")
        return rows.orderBy("called_symbol", "file_path", "id", "target_id").limit(limit).drop("target_id")

    def lineage(self, finding_id: int | None = None) -> DataFrame:
        """(finding_id, symbol, definition_id, mr_id, author): from findings to who introduced the code."""
        t = self.source.table
        found = t("gl_finding") if finding_id is None else t("gl_finding").where(F.col("id") == finding_id)
        intro = t("gl_definition_history").groupBy("definition_id").agg(F.min_by("merge_request_id", F.struct("created_at", "merge_request_id")).alias("mr_id"))
        return (found.select(F.col("id").alias("finding_id"), F.col("affected_definition_id").alias("definition_id"))
                .join(t("gl_definition").select(F.col("id").alias("definition_id"), F.col("name").alias("symbol")), "definition_id").join(intro, "definition_id")
                .join(t("gl_merge_request").select(F.col("id").alias("mr_id"), "author_id"), "mr_id").join(t("gl_user").select(F.col("id").alias("author_id"), F.col("username").alias("author")), "author_id")
                .select("finding_id", "symbol", "definition_id", "mr_id", "author"))

    def mr_metadata(self, mr_id: int) -> DataFrame:
        return self.source.table("gl_merge_request").where(F.col("id") == mr_id)

    def finding_metadata(self, finding_id: int) -> DataFrame:
        return self.source.table("gl_finding").where(F.col("id") == finding_id)

    def dsl(self, request: Mapping) -> DataFrame:
        """A JSON request: ``traversal`` of one entity, or ``pathfinding`` from findings to users."""
        q = request.get("query", request)
        kind, limit = q.get("query_type"), q.get("limit", LIMIT)
        if kind == "traversal":
            node = q.get("node") or {}
            return self._filtered(node.get("entity"), self.source.table(self._entity(node.get("entity"))), node.get("filters")).limit(limit)
        if kind == "pathfinding":
            start, end = q.get("start") or {}, q.get("end") or {}
            if (start.get("entity"), end.get("entity")) != ("Finding", "User"):
                raise ValueError(f"no path from {start.get('entity')} to {end.get('entity')}")
            chosen = self._filtered("Finding", self.source.table("gl_finding"), start.get("filters")).select(F.col("id").alias("finding_id"))
            return self.lineage().join(chosen, "finding_id", "left_semi").orderBy("finding_id").limit(limit)
        raise ValueError(f"unknown query type {kind}")

    @staticmethod
    def _entity(name: str | None) -> str:
        if name not in ENTITIES:
            raise ValueError(f"unknown entity {name}; there are {', '.join(ENTITIES)}")
        return ENTITIES[name]

    @staticmethod
    def _filtered(entity: str, rows: DataFrame, filters: Mapping | None) -> DataFrame:
        for column, f in (filters or {}).items():
            if column not in rows.columns:
                raise ValueError(f"{entity} has no {column}")
            if f.get("op") == "eq":
                rows = rows.where(F.col(column) == F.lit(f["value"]))
            elif f.get("op") == "in":
                rows = rows.where(F.col(column).isin(list(f["value"])))
            else:
                raise ValueError(f"unknown operator {f.get('op')}")
        return rows
