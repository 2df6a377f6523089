"""Command line: python -m impactloom {verdict,compose,query,dsl,fragile,risk-map,scars,backtest} ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from .operators import history
from .plans.catalogue import QUERIES
from .plans.replay import read_replay
from .plans.typed import GraphQueries
from .plans.verdicts import Scored, compose_lenses
from .sinks import output, render
from .sources import events, git
from .sources.tables import GraphTables


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="impactloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, tables: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        if tables:
            p.add_argument("--tables", required=True, help="folder of Parquet tables, or catalog:<database>")
        return p

    p = command("verdict", "score events and print verdicts as JSON")
    p.add_argument("events", help="path of JSON lines, JSON text, or - for standard input")
    p.add_argument("--markdown", help="folder for a report per event")
    p.add_argument("--enforce", action="store_true", help="exit with 1 where a verdict blocks")
    p = command("compose", "score lens results that are given", tables=False)
    p.add_argument("lenses", help="path of JSON lines, JSON text, or -")
    p = command("query", "a typed query, with parameters as JSON")
    p.add_argument("name")
    p.add_argument("params", nargs="?", default="{}")
    p = command("dsl", "a JSON request")
    p.add_argument("request")
    command("fragile", "much called functions without tests")
    p = command("risk-map", "the most called functions as SVG")
    p.add_argument("--out")
    p = command("scars", "files by their history of fixes", tables=False)
    p.add_argument("log", help="output of git log --no-merges --name-only --date=short --format=" + git.LOG_FORMAT.replace("%", "%%"))
    p = command("backtest", "how often each decision is taken over events, or over commits from their diffs")
    p.add_argument("events", nargs="?", help="events as for verdict; not with --diffs")
    p.add_argument("--diffs", help="JSON lines of commit_id and diff, the output of git diff --unified=0 --no-color <parent> <commit>")
    p.add_argument("--texts", help="JSON lines of commit_id, path, old_text and new_text, one for each changed file")
    p.add_argument("--log", help="output of git log as for scars, with --first-parent: subjects, and the order for --newest")
    p.add_argument("--newest", type=int, help="how many commits with changed functions, out of the newest of --log")
    p.add_argument("--own", action="append", default=[], help="prefix of paths that count for nothing; may be repeated")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.command == "backtest" and (bool(args.events) == bool(args.diffs) or bool(args.diffs) != bool(args.texts) or (args.newest and not args.log)):
        parser.error("backtest takes events, or --diffs with --texts; --newest needs --log")
    spark = spark or SparkSession.builder.appName("impactloom").getOrCreate()
    source = None
    if "tables" in args:
        try:
            source = GraphTables.from_catalog(spark, args.tables[8:]) if args.tables.startswith("catalog:") else GraphTables.from_folder(spark, args.tables)
            alive = source.alive()
        except Exception as error:  # noqa: BLE001  told and turned into the exit code that says so
            print(f"source cannot be read: {error}", file=sys.stderr)
            return output.SOURCE_DOWN
        if not alive:
            print("source has no definitions", file=sys.stderr)
            return output.SOURCE_DOWN

    def lines(df) -> None:
        for row in output.as_json(df).toLocalIterator():
            print(row.value)

    if args.command == "verdict":
        scored = Scored(events.read_json(spark, args.events), source)
        verdicts = scored.impact.scratch.save(scored.verdicts().drop("key"), "verdicts")
        lines(verdicts)
        if args.markdown:
            output.write_markdown(render.render(scored.reports()), args.markdown)
        return output.exit_code(verdicts, args.enforce)
    if args.command == "compose":
        lines(compose_lenses(events.read_json(spark, args.lenses, events.LENSES)))
    elif args.command == "query":
        lines(GraphQueries(source).query(args.name, **json.loads(args.params)))
    elif args.command == "dsl":
        lines(GraphQueries(source).dsl(json.loads(args.request)))
    elif args.command == "fragile":
        print(render.shown(source.sql(QUERIES["fragile_functions"])))
    elif args.command == "risk-map":
        svg = render.risk_map_svg([r.asDict() for r in source.sql(QUERIES["risk_map"]).collect()])  # at most 18 rows
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(svg)
        else:
            print(svg)
    elif args.command == "scars":
        scarred = history.scars(history.usable_changes(*git.read_log(spark, args.log)))
        print(render.shown(history.ranked_scars(scarred)))
    elif args.command == "backtest" and args.diffs:
        replay, ids = read_replay(spark, args.diffs, args.texts, source, args.log, args.newest, tuple(args.own))
        verdicts = replay.verdicts()
        caught = replay.catches(verdicts).join(ids, "event_id").select("commit_id", "action", "edit_class", "total_dependents", "contract_changed", "subject")
        for table in (render.tally(verdicts), replay.classes(), caught.orderBy(F.desc("total_dependents"), "commit_id")):
            print(render.shown(table))
    elif args.command == "backtest":
        print(render.shown(render.tally(Scored(events.read_json(spark, args.events), source).verdicts())))
    return 0


if __name__ == "__main__":
    sys.exit(main())
