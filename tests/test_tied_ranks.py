"""Ranks of nodes that tie but for rounding, against SQL."""

from __future__ import annotations

import duckdb
import pytest

from impactloom.durable import Scratch
from impactloom.operators import centrality
from impactloom.plans.queries import _pagerank_sql
from impactloom.sources.derive import TABLES


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_all_ranks_equal_the_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '/root/testdata/{sf}/part.parquet'")
    for name in ("gl_edge", "gl_calls"):
        db.execute(f"CREATE TABLE {name} AS {TABLES[name]}")
    want = db.execute(f"SELECT id, rank FROM ({_pagerank_sql(None)})").fetchall()
    calls = spark.createDataFrame(db.execute("SELECT source_id, target_id FROM gl_calls").fetchdf())
    scratch = Scratch(spark, "t")
    got = centrality.ranked(centrality.pagerank(calls, scratch, tolerance=0.0), scratch).select("id", "rank").collect()
    assert sorted(tuple(x) for x in got) == sorted(want)
