"""Single-pass queries as SQL that means the same in Spark and DuckDB (apart from ``dialect`` forms)."""

from __future__ import annotations

SYMBOL = "(SELECT name FROM gl_definition WHERE id = 60)"
_TESTS = ("lower({c}) LIKE '%/tests/%' OR lower({c}) LIKE '%/test/%' OR lower({c}) LIKE '%integration-tests%' OR lower({c}) LIKE '%testkit%' OR lower({c}) LIKE '%testutil%' "
          "OR lower({c}) LIKE '%/spec%' OR lower({c}) LIKE '%/fixtures/%' OR lower({c}) LIKE '%/fuzz/%' OR lower({c}) LIKE '%/benches/%' OR lower({c}) LIKE '%/examples/%'")
_GENERATED = ("lower({c}) LIKE '%.pb.go' OR lower({c}) LIKE '%.pb.rs' OR lower({c}) LIKE '%_pb2.py' OR lower({c}) LIKE '%generated%' OR lower({c}) LIKE '%/gen/%' OR lower({c}) LIKE '%.gen.%'")


def _callers(least: int) -> str:
    return f"""
    SELECT d.id, d.name, d.fqn, d.file_path, count(DISTINCT e.source_id) AS total_callers,
           count(DISTINCT CASE WHEN {_TESTS.format(c='s.file_path')} THEN e.source_id END) AS test_callers
    FROM gl_definition d JOIN gl_calls e ON e.target_id = d.id JOIN gl_definition s ON s.id = e.source_id
    WHERE d.definition_type = 'Function' AND NOT ({_TESTS.format(c='d.file_path')}) AND NOT ({_GENERATED.format(c='d.file_path')})
    GROUP BY d.id, d.name, d.fqn, d.file_path HAVING count(DISTINCT e.source_id) >= {least}"""


_DEGREES = """
    ins AS (SELECT target_id AS id, count(DISTINCT source_id) AS n FROM gl_calls GROUP BY target_id),
    outs AS (SELECT source_id AS id, count(DISTINCT target_id) AS n FROM gl_calls GROUP BY source_id),
    degrees AS (SELECT d.id, d.name, d.definition_type, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound, coalesce(i.n, 0) + coalesce(o.n, 0) AS total
                FROM gl_definition d LEFT JOIN ins i ON i.id = d.id LEFT JOIN outs o ON o.id = d.id)"""

QUERIES: dict[str, str] = {
    "direct_callers": f"""
        SELECT DISTINCT c.id, c.name, c.fqn, c.file_path, c.start_line FROM gl_definition t JOIN gl_calls e ON e.target_id = t.id
        JOIN gl_definition c ON c.id = e.source_id WHERE t.name IN {SYMBOL}""",
    "callees": f"""
        SELECT DISTINCT c.id, c.name, c.file_path FROM gl_definition t JOIN gl_calls e ON e.source_id = t.id JOIN gl_definition c ON c.id = e.target_id WHERE t.name IN {SYMBOL}""",
    "callers_limited": "SELECT DISTINCT c.id, c.name FROM gl_definition t JOIN gl_calls e ON e.target_id = t.id JOIN gl_definition c ON c.id = e.source_id WHERE t.id = 1 ORDER BY c.id LIMIT 20",
    "symbol_defs": f"SELECT d.id, d.name, count(DISTINCT e.source_id) AS inbound FROM gl_definition d LEFT JOIN gl_calls e ON e.target_id = d.id WHERE d.name IN {SYMBOL} GROUP BY d.id, d.name",
    "symbol_definition": f"""
        SELECT d.id, d.name, d.fqn, d.file_path, d.start_line, d.end_line, count(DISTINCT e.source_id) AS inbound FROM gl_definition d LEFT JOIN gl_calls e ON e.target_id = d.id
        WHERE d.name IN {SYMBOL} GROUP BY d.id, d.name, d.fqn, d.file_path, d.start_line, d.end_line ORDER BY inbound DESC, d.id LIMIT 1""",
    "definitions_by_id": "SELECT id, name, file_path FROM gl_definition WHERE id IN (1, 8, 60, 61, 99999999)",
    "all_call_edges": "SELECT source_id, target_id, count(*) AS n FROM gl_calls GROUP BY source_id, target_id",
    "ownership_centrality": f"WITH {_DEGREES} SELECT id, name, definition_type, inbound, outbound FROM degrees WHERE total > 10 ORDER BY total DESC, id LIMIT 30",
    "most_called": "SELECT target_id AS id, count(DISTINCT source_id) AS callers FROM gl_calls GROUP BY target_id HAVING count(DISTINCT source_id) > 0 ORDER BY callers DESC, id LIMIT 20",
    "centrality_percentile": f"""
        WITH {_DEGREES} SELECT id, name, total, round(percent_rank() OVER (ORDER BY total), 6) AS centrality_percentile FROM degrees WHERE total > 5 ORDER BY total DESC, id LIMIT 20""",
    "local_centrality": f"WITH {_DEGREES} SELECT id, name, inbound, outbound, total FROM degrees WHERE total > 5 ORDER BY total DESC, id LIMIT 30",
    "defs_per_file": "SELECT f.path, count(d.id) AS definitions FROM gl_file f LEFT JOIN gl_definition d ON d.file_path = f.path GROUP BY f.path HAVING count(d.id) > 0 ORDER BY definitions DESC, f.path LIMIT 30",
    "entity_counts": """
        SELECT 'definitions' AS entity, count(*) AS n FROM gl_definition UNION ALL SELECT 'edges', count(*) FROM gl_edge
        UNION ALL SELECT 'files', count(*) FROM gl_file UNION ALL SELECT 'projects', count(*) FROM gl_project""",
    "kind_counts": "SELECT relationship_kind, count(*) AS n FROM gl_edge GROUP BY relationship_kind",
    "name_search": "SELECT id, name, file_path FROM gl_definition WHERE name LIKE '%bolt%' ORDER BY id LIMIT 10",
    "fragile_functions": f"""
        WITH c AS ({_callers(8)}), top AS (SELECT *, total_callers - test_callers AS prod_callers FROM c ORDER BY total_callers - test_callers DESC, id LIMIT 60)
        SELECT id, name, file_path, total_callers, prod_callers FROM top WHERE prod_callers >= 8 AND test_callers = 0
        ORDER BY CASE WHEN lower(file_path) LIKE '%auth%' OR lower(file_path) LIKE '%security%' OR lower(file_path) LIKE '%redaction%' OR lower(file_path) LIKE '%compiler%'
          OR lower(file_path) LIKE '%code-graph%' OR lower(file_path) LIKE '%indexer%' OR lower(file_path) LIKE '%pipeline%' OR lower(file_path) LIKE '%billing%'
          OR lower(file_path) LIKE '%config%' OR lower(file_path) LIKE '%evaluat%' THEN 0 ELSE 1 END, prod_callers DESC, id LIMIT 12""",
    "risk_map": f"WITH c AS ({_callers(6)}) SELECT id, name, file_path, total_callers, test_callers, test_callers = 0 AS untested FROM c ORDER BY total_callers DESC, id LIMIT 18",
    "finding_definition": "SELECT f.id, f.severity, d.name, d.file_path FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id",
    "introducing_mr": """
        SELECT definition_id, h.merge_request_id, m.title, m.author_id FROM
          (SELECT definition_id, merge_request_id, row_number() OVER (PARTITION BY definition_id ORDER BY created_at, merge_request_id) AS r FROM gl_definition_history) h
        JOIN gl_merge_request m ON m.id = h.merge_request_id WHERE r = 1""",
    "lineage_path": """
        SELECT f.id AS finding_id, d.name AS symbol, d.id AS definition_id, m.id AS mr_id, u.username AS author FROM gl_finding f JOIN gl_definition d ON d.id = f.affected_definition_id
        JOIN (SELECT definition_id, min(merge_request_id) AS mr FROM gl_definition_history WHERE is_intro GROUP BY definition_id) h ON h.definition_id = d.id
        JOIN gl_merge_request m ON m.id = h.mr JOIN gl_user u ON u.id = m.author_id""",
    "approval_control": """
        WITH a AS (SELECT m.id, count(DISTINCT p.user_id) AS approvals FROM gl_merge_request_approval p JOIN gl_merge_request m ON m.id = p.mr_id AND p.user_id <> m.author_id GROUP BY m.id)
        SELECT m.id, m.title, coalesce(a.approvals, 0) AS approvals, CASE WHEN coalesce(a.approvals, 0) > 0 THEN 'PASS' ELSE 'FAIL' END AS control_status,
               CASE WHEN coalesce(a.approvals, 0) > 0 THEN NULL ELSE 'no approval by another user' END AS violation_reason
        FROM gl_merge_request m LEFT JOIN a ON a.id = m.id WHERE m.target_branch = 'main' AND m.state = 'merged' AND m.created_at > AS_OF - INTERVAL '900' DAY""",
    "pipeline_control": """
        SELECT m.id, p.status, CASE WHEN p.status = 'success' THEN 'PASS' ELSE 'FAIL' END AS control_status,
               CASE WHEN p.status <> 'success' THEN 'pipeline ' || p.status END AS violation_reason, count(*) AS n
        FROM gl_merge_request m LEFT JOIN gl_pipeline p ON p.mr_id = m.id WHERE m.target_branch = 'main' AND m.state = 'merged' AND m.created_at > AS_OF - INTERVAL '900' DAY
        GROUP BY m.id, p.status""",
    "authorship_decay": """
        SELECT d.id, d.name, count(DISTINCT a.user_id) AS authors, CAST(max(DAYS(as_of_ts, a.updated_at)) AS BIGINT) AS oldest_days,
               CASE WHEN count(DISTINCT a.user_id) = 1 AND min(DAYS(as_of_ts, a.updated_at)) > 365 THEN 'HIGH' WHEN count(DISTINCT a.user_id) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS orphan_risk
        FROM gl_definition d JOIN (SELECT *, AS_OF AS as_of_ts FROM gl_file_authorship) a ON a.file_path = d.file_path GROUP BY d.id, d.name HAVING count(DISTINCT a.user_id) <= 2""",
    "graph_completeness": """
        SELECT count(*) AS total, count(e.id) AS mapped, round(100.0 * CAST(count(e.id) AS DOUBLE) / count(*), 2) AS pct,
               CASE WHEN count(e.id) >= 0.99 * count(*) THEN 'A' WHEN count(e.id) >= 0.95 * count(*) THEN 'B' WHEN count(e.id) >= 0.85 * count(*) THEN 'C' WHEN count(e.id) >= 0.70 * count(*) THEN 'D' ELSE 'E' END AS tier
        FROM gl_definition d LEFT JOIN (SELECT DISTINCT source_id AS id FROM gl_calls) e ON e.id = d.id""",
    "lineage_completeness": """
        SELECT count(*) AS total, count(h.definition_id) AS with_mr, round(100.0 * CAST(count(h.definition_id) AS DOUBLE) / count(*), 2) AS pct FROM gl_definition d
        LEFT JOIN (SELECT DISTINCT definition_id FROM gl_definition_history WHERE is_intro) h ON h.definition_id = d.id""",
    "finding_by_id": "SELECT id, title, severity FROM gl_finding WHERE id = 4",
    "merge_request_by_id": "SELECT id, title, state, target_branch, author_id FROM gl_merge_request WHERE id = 8",
    "changed_symbols_range": """
        SELECT DISTINCT d.name, d.file_path FROM gl_definition d JOIN (SELECT file_path AS base, CAST(100 AS BIGINT) AS lo, CAST(140 AS BIGINT) AS hi FROM gl_definition WHERE id IN (8, 60)) r
        ON d.file_path = r.base AND d.start_line <= r.hi AND d.end_line >= r.lo""",
    "scar_files": """
        WITH normal AS (SELECT commit_id FROM git_commit_file GROUP BY commit_id HAVING count(*) <= 50),
        c AS (SELECT f.file_path, lower(g.subject) AS s FROM git_commit_file f JOIN normal n ON n.commit_id = f.commit_id JOIN git_commit g ON g.commit_id = f.commit_id
              WHERE NOT NOISE),
        k AS (SELECT file_path, CASE WHEN RX(s, '^\\s*revert[\\s:"]') THEN 'revert' WHEN RX(s, '\\b(hotfix|roll ?back|emergency|incident|sev[-\\s]?\\d)\\b') THEN 'hotfix'
              WHEN RX(s, '\\b(fix|fixe[sd]|bug|bugfix|regress\\w*|broke[n]?|crash)\\b') AND NOT (EXCLUDED) THEN 'fix' END AS kind FROM c),
        t AS (SELECT file_path, count(*) AS total, count(CASE WHEN kind = 'revert' THEN 1 END) AS reverts, count(CASE WHEN kind = 'hotfix' THEN 1 END) AS hotfixes,
                     count(CASE WHEN kind = 'fix' THEN 1 END) AS fixes FROM k GROUP BY file_path)
        SELECT file_path, total, reverts, hotfixes, fixes, round(CAST(fixes AS DOUBLE) / total, 6) AS fix_density,
               round(least(CAST(1 AS DOUBLE), CAST(0.4 AS DOUBLE) * reverts + CAST(0.22 AS DOUBLE) * hotfixes + CASE WHEN total >= 4 THEN CAST(0.3 AS DOUBLE) * least(CAST(fixes AS DOUBLE) / total, CAST(0.6 AS DOUBLE))
                 + CAST(0.05 AS DOUBLE) * least(fixes, 6) ELSE CAST(0 AS DOUBLE) END), 6) AS intensity FROM t""",
    "throttle_windows": """
        SELECT user_id, window_start, n, least(n, 10) AS allowed FROM (SELECT user_id, EPOCH(ts) - EPOCH(ts) % 60 AS window_start, count(*) AS n FROM events GROUP BY user_id, EPOCH(ts) - EPOCH(ts) % 60)""",
}

# Files that do not count and words that make a subject no fix.
_NOISE = ("(lower(f.file_path) LIKE '%generated%' OR lower(f.file_path) LIKE '%/gen/%' OR lower(f.file_path) LIKE '%.gen.%' OR lower(f.file_path) LIKE '%.pb.go' OR lower(f.file_path) LIKE '%_pb2.py' OR lower(f.file_path) LIKE '%.g.dart' "
          "OR lower(f.file_path) LIKE '%.pb.rs' OR RX(f.file_path, '(?i)(^|/)(cargo.lock|package-lock.json|yarn.lock|go.sum|pnpm-lock.yaml|poetry.lock|gemfile.lock|composer.lock)$'))")
_EXCLUDED = " OR ".join(f"s LIKE '%{w}%'" for w in ("typo", "lint", "rustfmt", "gofmt", "clippy", "format", "fmt", "whitespace", "comment", "spelling", "changelog", "readme", "doc ", "docs", "rename", "clean up", "cleanup", "warning"))
QUERIES["scar_files"] = QUERIES["scar_files"].replace("NOISE", _NOISE).replace("EXCLUDED", _EXCLUDED)
