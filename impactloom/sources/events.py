"""Events and lens results as JSON: files, strings and standard input."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

_FINDING = "finding_id:string,title:string,severity:string,cvss_score:double,affected_symbol:string"
PAYLOAD = (f"mr_id:string,project_id:string,changed_symbols:array<string>,mr_title:string,findings:array<struct<{_FINDING}>>,edit_semantics:struct<edit_class:string>,"
           "edit_class:string,scar_analysis:struct<prior:double>,mr_meta:struct<approvals:struct<non_author_approved:boolean>,pipeline_status:string>," + _FINDING)
EVENT = f"event_id string, event_type string, timestamp string, payload struct<{PAYLOAD}>"
LENSES = ("event_id string, event_type string, edit_class string, impact struct<total_dependents:long,change_failure_rate:double,confidence:double,keystone_symbols:array<struct<name:string>>>, "
          "provenance struct<severity:string>, ownership struct<risk_level:string>, compliance struct<risk_level:string>")


def read_json(spark: SparkSession, source: str, schema: str = EVENT) -> DataFrame:
    """Rows of ``schema`` from a path of JSON lines, one JSON text, or ``-`` for standard input.

    JSON that does not parse raises.
    """
    text = sys.stdin.read() if source == "-" else source if source.lstrip()[:1] in ("{", "[") else None
    if text is None:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(source)
    parsed = json.loads(text)
    rows = [(json.dumps(r),) for r in (parsed if isinstance(parsed, list) else [parsed])]
    return spark.createDataFrame(rows, "value string").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
