"""Graph, delivery and history tables from where they are kept: a folder, a catalogue or given DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .derive import dialect

#: The columns that operators read; further columns are allowed.
COLUMNS: dict[str, str] = {
    "gl_definition": "id name fqn definition_type file_path project_id start_line end_line",
    "gl_edge": "source_id target_id relationship_kind",
    "gl_file": "path language",
    "gl_project": "id name full_path",
    "gl_user": "id username name",
    "gl_file_authorship": "file_path user_id updated_at",
    "gl_merge_request": "id title state target_branch author_id created_at",
    "gl_merge_request_approval": "mr_id user_id",
    "gl_pipeline": "mr_id status",
    "gl_definition_history": "definition_id merge_request_id created_at is_intro",
    "gl_finding": "id title severity affected_definition_id",
    "gl_job": "project_id job_type status created_at",
    "git_commit": "commit_id committed_at seq subject",
    "git_commit_file": "commit_id file_path",
    "blame": "definition_id author_email lines",
}
NEEDED = ("gl_definition", "gl_edge")


class GraphTables:
    """Named tables with checked columns; ``gl_calls`` is derived from ``gl_edge``.

    A table that is not there raises when it is asked for: a missing source is never read as "nothing
    found".  Tables are registered as temporary views, so that ``sql`` can name them.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
        self.spark = spark
        self.tables = dict(tables)
        for name, df in self.tables.items():
            missing = set(COLUMNS.get(name, "").split()) - set(df.columns)
            if missing:
                raise ValueError(f"table {name} lacks {', '.join(sorted(missing))}")
        for name in NEEDED:
            if name not in self.tables:
                raise ValueError(f"no table {name}")
        calls = self.tables["gl_edge"].where((F.col("relationship_kind") == "CALLS") & F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
        self.tables.setdefault("gl_calls", calls.select("source_id", "target_id"))
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, kind: str = "parquet", names=None) -> GraphTables:
        """Tables ``<folder>/<name>`` or ``<folder>/<name>.<kind>``, those of ``names`` or all that are there."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        there = {s.getPath().getName() for s in files.listStatus(path)}
        found = {name: entry for name in COLUMNS for entry in (name, f"{name}.{kind}") if entry in there}
        for name in names or ():
            if name not in found:
                raise ValueError(f"no table {name} in {folder}")
        return cls(spark, {n: spark.read.format(kind).load(f"{folder}/{e}") for n, e in found.items() if not names or n in names or n in NEEDED})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> GraphTables:
        """Tables of a database of the session's catalogue."""
        return cls(spark, {n: spark.table(f"{database}.{n}") for n in COLUMNS if spark.catalog.tableExists(f"{database}.{n}")})

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"no table {name}")
        return self.tables[name]

    def sql(self, text: str, **args) -> DataFrame:
        return self.spark.sql(dialect(text, "spark"), args=args or None)

    def alive(self) -> bool:
        """Whether there are definitions; a source that cannot be read raises."""
        return not self.table("gl_definition").isEmpty()


def first_alive(*sources):
    """The first source that can be read and has definitions; each is asked once, in order.

    If none can, the error names what each one said; there is no made-up source behind them.
    """
    said = []
    for source in sources:
        try:
            if source.alive():
                return source
            said.append(f"{type(source).__name__}: no definitions")
        except Exception as error:  # noqa: BLE001  whatever a source raises, the next one is asked
            said.append(f"{type(source).__name__}: {error}")
    raise ValueError("no source can be read: " + "; ".join(said))
