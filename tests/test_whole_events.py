"""Events and diffs of the derived tables cover all orders, lines and definitions."""

from impactloom.plans import queries
from impactloom.sources.derive import GraphSource

SF = "/root/testdata/sf0.001"


def test_events_come_from_all_orders_lines_and_definitions(spark):
    g = GraphSource(spark, SF)
    lines = spark.sql("SELECT count(*), count(DISTINCT l_orderkey), count(DISTINCT p_partkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey").first()
    names = spark.sql("SELECT count(DISTINCT name) FROM gl_definition WHERE id IN (SELECT l_partkey FROM lineitem)").first()[0]
    found = g.table("mr_event").selectExpr("count(*)", "count(DISTINCT event_id)", "count(DISTINCT changed_symbol)").first()
    assert tuple(found) == (lines[0], lines[1], names) and lines[1] > 1000


def test_diffs_of_all_definitions_are_looked_up(spark):
    d = GraphSource(spark, SF).table("gl_definition").collect()
    want = {(e.id, o.name) for e in d for o in d if o.file_path == e.file_path and o.start_line <= e.start_line + max(e.id % 3, 1) - 1 and o.end_line >= e.start_line}
    got = queries.diff_symbols(spark, SF).collect()
    assert {(r.event_id, r.changed_symbol) for r in got} == want and len(got) == len(want) and {i for i, _ in want} == {e.id for e in d}
