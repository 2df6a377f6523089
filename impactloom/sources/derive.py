"""Code-graph and delivery tables derived from the star-schema test tables.

Each table is one SELECT that means the same in Spark SQL and DuckDB, so the checker can derive the
same tables on its side.  In production the tables come from a catalogue or Parquet folders instead
(``GraphSource``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")

_DIR = ("CASE p_partkey % 10 WHEN 0 THEN 'tests' WHEN 1 THEN 'security' WHEN 2 THEN 'gen' WHEN 3 THEN 'billing' "
        "WHEN 4 THEN 'auth' WHEN 5 THEN 'server' WHEN 6 THEN 'private' ELSE 'src' END")
_DOWN = "CAST(floor(p_partkey / {}.0) AS BIGINT)"


def _edges() -> str:
    p = "p_partkey"
    parts = [
        (p, _DOWN.format(3), "CALLS", "p_partkey > 0"),
        (p, _DOWN.format(7), "CALLS", "p_size % 5 = 0 AND p_partkey > 0"),
        (_DOWN.format(11), p, "CALLS", "p_partkey % 97 = 5"),
        (p, "p_partkey % 12", "CALLS", "p_size % 3 = 0"),
        (p, "-1 - p_partkey % 5", "CALLS", "p_partkey % 50 = 7"),
        (p, _DOWN.format(2), "CONTAINS", "p_partkey % 4 = 0"),
        (p, _DOWN.format(5), "IMPORTS", "p_partkey % 6 = 0"),
    ]
    return " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS source_id, CAST({b} AS BIGINT) AS target_id, '{kind}' AS relationship_kind FROM part WHERE {where}"
                              for a, b, kind, where in parts)


#: In dependency order.
TABLES: dict[str, str] = {
    "gl_definition": f"""
        SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 40 AS STRING) AS name,
               'crate::' || lower(p_type) || '::' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS fqn,
               CASE WHEN p_size % 4 = 0 THEN 'Class' ELSE 'Function' END AS definition_type,
               'crates/' || lower(p_type) || '/' || {_DIR} || '/m' || CAST(p_size % 6 AS STRING) || '.rs' AS file_path,
               CAST(p_size % 25 AS BIGINT) AS project_id, CAST((p_partkey * 7) % 400 + 1 AS BIGINT) AS start_line,
               CAST((p_partkey * 7) % 400 + 1 + p_size AS BIGINT) AS end_line
        FROM part""",
    "gl_edge": _edges(),
    "gl_calls": "SELECT source_id, target_id FROM gl_edge WHERE relationship_kind = 'CALLS' AND source_id IS NOT NULL AND target_id IS NOT NULL",
    "gl_file": "SELECT DISTINCT file_path AS path, 'rust' AS language FROM gl_definition",
    "gl_project": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name || '/' || n_name AS full_path FROM nation JOIN region ON n_regionkey = r_regionkey",
    "gl_user": "SELECT c_custkey AS id, 'u' || CAST(c_custkey AS STRING) AS username, c_name AS name FROM customer",
    "gl_file_authorship": """
        SELECT file_path, user_id, CASE WHEN length(file_path) % 2 = 0 THEN max(l_shipdate) - INTERVAL '730' DAY ELSE max(l_shipdate) END AS updated_at FROM
        (SELECT d.file_path, l_shipdate, length(d.file_path) + l_suppkey % CASE length(d.file_path) % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1000000 END AS user_id
         FROM lineitem JOIN gl_definition d ON d.id = l_partkey) a GROUP BY file_path, user_id""",
    "gl_merge_request": """
        SELECT o_orderkey AS id, o_orderkey % 1000 AS iid, 'MR ' || CAST(o_orderkey AS STRING) AS title,
               CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'opened' ELSE 'closed' END AS state,
               CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'main' ELSE 'develop' END AS target_branch,
               o_custkey AS author_id, o_orderdate AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '2' DAY END AS merged_at FROM orders""",
    "gl_merge_request_approval": """
        SELECT l_orderkey AS mr_id, CASE WHEN l_linestatus = 'F' THEN o_custkey ELSE l_suppkey END AS user_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'""",
    "gl_pipeline": "SELECT l_orderkey AS mr_id, CASE l_returnflag WHEN 'R' THEN 'success' WHEN 'N' THEN 'failed' END AS status FROM lineitem WHERE l_linenumber = 1",
    "gl_definition_history": """
        SELECT l_partkey AS definition_id, l_orderkey AS merge_request_id, l_shipdate AS created_at,
               row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) = 1 AS is_intro
        FROM lineitem WHERE l_partkey % 9 <> 0""",
    "gl_finding": """
        SELECT doc_id AS id, 'Finding ' || CAST(doc_id AS STRING) AS title,
               CASE WHEN toxic = 1 AND quality = 0 THEN 'CRITICAL' WHEN toxic = 1 AND quality = 1 THEN 'HIGH'
                    WHEN toxic = 0 AND quality = 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               CAST(doc_id * 7 % (SELECT count(*) FROM part) AS BIGINT) AS affected_definition_id FROM labels""",
    "gl_job": """
        SELECT user_id % 25 AS project_id, CASE WHEN event_type = 'purchase' THEN 'deploy' ELSE 'build' END AS job_type,
               CASE WHEN value < 20 THEN 'failed' ELSE 'success' END AS status, ts AS created_at FROM events""",
    "git_commit": """
        SELECT o_orderkey AS commit_id, o_orderdate AS committed_at, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS seq,
               CASE o_orderkey % 12 WHEN 0 THEN 'Revert "feat: add cache"' WHEN 1 THEN 'hotfix: restore login' WHEN 2 THEN 'fix: crash in planner'
                 WHEN 3 THEN 'fix typo in docs' WHEN 4 THEN 'bugfix for parser' WHEN 5 THEN 'roll back deploy' WHEN 6 THEN 'fix information schema'
                 ELSE 'feat: add option' END AS subject FROM orders""",
    "git_commit_file": "SELECT DISTINCT l_orderkey AS commit_id, d.file_path FROM lineitem JOIN gl_definition d ON d.id = l_partkey",
    "blame": """
        SELECT l_partkey AS definition_id, 'dev' || CAST(l_suppkey % 7 AS STRING) || '@example.com' AS author_email, CAST(sum(l_linenumber) AS BIGINT) AS lines
        FROM lineitem GROUP BY l_partkey, l_suppkey % 7""",
    "mr_event": """
        SELECT CAST(o_orderkey AS BIGINT) AS event_id, d.name AS changed_symbol,
               CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'contract-break' WHEN '2' THEN 'body-edit' WHEN '3' THEN 'body-edit' ELSE 'cosmetic' END AS edit_class
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN gl_definition d ON d.id = l_partkey""",
}

_REVERT, _HOTFIX, _FIX = r'^\s*revert[\s:"]', r"\b(hotfix|roll ?back|emergency|incident|sev[-\s]?\d)\b", r"\b(fix|fixe[sd]|bug|bugfix|regress\w*|broke[n]?|crash)\b"

_DIALECT = {
    "spark": [(r"SORTED_LIST\((\w[\w.]*)\)", r"array_join(array_sort(collect_set(\1)), ',')"), (r"DAYS\((\w[\w.]*), (\w[\w.]*)\)", r"datediff(\1, \2)"),
              (r"RX\((\w[\w.]*), '([^']*)'\)", r"regexp_like(\1, r'\2')"), (r"AS_OF", "TIMESTAMP '2001-08-01 00:00:00'"), (r"EPOCH\((\w+)\)", r"unix_timestamp(\1)")],
    "duck": [(r"SORTED_LIST\((\w[\w.]*)\)", r"array_to_string(list_sort(list(DISTINCT \1)), ',')"), (r"DAYS\((\w[\w.]*), (\w[\w.]*)\)", r"date_diff('day', CAST(\2 AS DATE), CAST(\1 AS DATE))"),
             (r"RX\((\w[\w.]*), '([^']*)'\)", r"regexp_matches(\1, '\2')"), (r"AS_OF", "TIMESTAMP '2001-08-01 00:00:00'"), (r"EPOCH\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)")],
}


def dialect(sql: str, engine: str) -> str:
    """Replaces the few forms that the two engines spell differently."""
    for pattern, by in _DIALECT[engine]:
        sql = re.sub(pattern, by, sql)
    return sql


class GraphSource:
    """Where graph tables come from: a catalogue or folder of them, or derived from the test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        for name in BASE:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        for name, sql in TABLES.items():
            spark.sql(sql).createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def sql(self, text: str, **args) -> DataFrame:
        return self.spark.sql(dialect(text, "spark"), args=args or None)

    def alive(self) -> bool:
        """Whether the graph can be read and has definitions; errors are raised, not hidden."""
        return not self.table("gl_definition").isEmpty()


def for_duckdb(sql: str) -> str:
    """A query over derived tables as one DuckDB statement that derives what it needs."""
    sql = dialect(sql.strip(), "duck")
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(TABLES[name])

    visit(sql)
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    body = sql[head.end() :] if head else sql
    ctes = [f"{name} AS ({TABLES[name]})" for name in TABLES if name in needed]
    if not ctes:
        return sql
    return f"WITH RECURSIVE {', '.join(ctes)}{', ' if head else ' '}{body}"
