"""A backtest from commits: diffs and texts to changed functions, edit classes, one shared traversal and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..durable import Scratch
from ..functions import textdiff
from ..operators import scoring
from ..operators.impact import Impact
from ..sinks import render
from ..sources import git
from ..sources.derive import GraphSource
from . import edits

#: Changed files of a slice of commits.
SLICE_FILES = 2_000_000


class Replay:
    """What would have been decided on past commits, all of them in one batch.

    ``diffs``: (event_id, diff), ``diff --unified=0`` texts, one or more rows a commit; ``texts``: (event_id, path,
    old_text, new_text), a row per changed file; ids are numbers.  Changed are the functions of the new texts that
    hold a line of a hunk.  Files under ``own_prefixes`` count for nothing.  A commit without files or without
    changed functions is left out; a changed function that the graph does not know reaches nothing.  Null texts are
    empty, null diffs have no hunks, repeated diffs count once.  With ``commits`` (event_id, seq, subject) and
    ``newest`` only so many commits with changed functions are replayed, by ``seq``, out of the newest and a few more.
    """

    def __init__(self, diffs: DataFrame, texts: DataFrame, definitions: DataFrame, calls: DataFrame, commits: DataFrame | None = None,
                 newest: int | None = None, own_prefixes: tuple[str, ...] = (), slice_files: int = SLICE_FILES) -> None:
        self.scratch = Scratch(diffs.sparkSession, "replay")
        self.definitions, self.calls, self.commits = definitions, calls, commits
        if commits is not None and newest is not None:
            recent = git.mainline(commits, newest).select("event_id")
            diffs, texts = diffs.join(recent, "event_id", "left_semi"), texts.join(recent, "event_id", "left_semi")
        for prefix in own_prefixes:
            texts = texts.where(~textdiff.plain_path(F.col("path")).startswith(prefix))
        texts = texts.where("path IS NOT NULL").select("event_id", "path", "old_text", "new_text")
        # What is shuffled with paths and texts is shuffled for a slice of the events at a time, and let go of before the next.
        slices = max(1, -(-texts.select("event_id").count() // slice_files))
        part = lambda df, k: df.where(F.pmod(F.xxhash64(F.col("event_id").cast("long")), F.lit(slices)) == k)
        newest_only = commits is not None and newest is not None

        def read(k: int) -> tuple[DataFrame, DataFrame]:
            """What the files of a slice hold, each text read once, and its changed functions; one look at all texts costs one pass over their source."""
            cosmetic = textdiff.is_cosmetic(F.col("old_text"), F.col("new_text"), textdiff.extension(F.col("path")))
            files = part(texts, k).select("event_id", "path", textdiff.function_spans("new_text").alias("spans"), textdiff.contracts("old_text").alias("old"), textdiff.contracts("new_text").alias("new"), cosmetic.alias("cosmetic"))
            files = self.scratch.save(files, f"files-{k}", release=slices > 1)
            return files, self.scratch.save(textdiff.functions_meeting(files, git.new_ranges(part(diffs, k))), f"names-{k}", release=slices > 1)

        ahead = [read(k) for k in range(slices)] if newest_only else None
        if ahead:
            first = commits.select("event_id", "seq").join(reduce(DataFrame.unionByName, (n for _, n in ahead)), "event_id", "left_semi").orderBy("seq").limit(newest)
            first = self.scratch.save(first.select("event_id"), "first", release=False)
            ahead = [(f, n.join(first, "event_id", "left_semi")) for f, n in ahead]
        broken, classes, events = [], [], []
        for k in range(slices):
            files, names = ahead[k] if ahead else read(k)
            held = files.join(names, "event_id", "left_semi")
            broken.append(self.scratch.save(textdiff.broken_among(held, names), f"broken-{k}", release=False))
            classes.append(self.scratch.save(textdiff.classes_of(held, broken[k]), f"edits-{k}", release=False))
            events.append(self.scratch.save(names.join(classes[k], "event_id").select("event_id", F.col("name").alias("changed_symbol"), "edit_class"), f"events-{k}", release=slices > 1))
            for done in ("files", "names"):
                self.scratch.drop(f"{done}-{k}")
        #: (event_id, changed_symbol, edit_class): changed functions with the class of their commit.
        self.events = reduce(DataFrame.unionByName, events)
        #: (event_id, name): changed functions.
        self.names = self.events.select("event_id", F.col("changed_symbol").alias("name"))
        #: (event_id, name): those whose signature is gone or differs.
        self.broken = reduce(DataFrame.unionByName, broken)
        #: (event_id, files, edit_class, broken), one row per replayed commit.
        self.edits = reduce(DataFrame.unionByName, classes)
        self._impact: Impact | None = None

    @property
    def impact(self) -> Impact:
        if self._impact is None:
            self._impact = Impact(self.events, self.definitions, self.calls)
        return self._impact

    def verdicts(self) -> DataFrame:
        """One row per replayed commit: all lens values, the blended risk and the decision."""
        return self.scratch.save(self.impact.verdicts(), "verdicts", release=False)

    def classes(self) -> DataFrame:
        """(edit_class, n, share)."""
        return render.tally(self.edits.select(F.col("edit_class").alias("action"))).withColumnRenamed("action", "edit_class")

    def catches(self, verdicts: DataFrame) -> DataFrame:
        """(event_id, action, edit_class, total_dependents, contract_changed, subject): the few escalated or contract-breaking commits of most dependents."""
        few = scoring.catches(verdicts).select("event_id", "action", "edit_class", "total_dependents")
        changed = self.broken.join(few, "event_id", "left_semi").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("contract_changed"))
        out = few.join(changed, "event_id", "left")
        subjects = self.commits.select("event_id", "subject") if self.commits is not None else None
        out = out.join(subjects, "event_id", "left") if subjects is not None else out.withColumn("subject", F.lit(None).cast("string"))
        return out.orderBy(F.desc("total_dependents"), "event_id")


def read_replay(spark: SparkSession, diffs: str, texts: str, source, log: str | None = None, newest: int | None = None, own_prefixes: tuple[str, ...] = ()) -> tuple[Replay, DataFrame]:
    """A replay of JSON lines (commit_id, diff) and (commit_id, path, old_text, new_text), and its ids (event_id, commit_id).

    Commit ids are texts; their 64-bit hashes stand for them.
    """
    read = lambda path, columns: spark.read.schema(", ".join(f"{c} string" for c in ("commit_id", *columns))).option("mode", "FAILFAST").json(path).withColumn("event_id", F.xxhash64("commit_id"))
    d, t = read(diffs, ["diff"]), read(texts, ["path", "old_text", "new_text"])
    commits = git.read_log(spark, log)[0].withColumn("event_id", F.xxhash64("commit_id")) if log else None
    return Replay(d, t, source.table("gl_definition"), source.table("gl_calls"), commits, newest, own_prefixes), d.select("event_id", "commit_id").distinct()


#: The edits of an order's definitions as one commit: two hunks a file, files that are gone, files of the tool itself.
_FILES = f"""SELECT l.event_id, e.event_id AS id, e.name, CASE WHEN e.event_id % 16 = 9 THEN 'vendored/' ELSE '' END || replace(e.path, '.rs', '_' || CAST(e.event_id AS STRING) || '.rs') AS path,
    old_text, new_text, first_line, last_line FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS event_id, l_partkey FROM lineitem) l JOIN ({edits._EDITS}) e ON e.event_id = l.l_partkey"""
_DIFF = """SELECT event_id, 'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ ' || CASE WHEN id % 8 = 7 THEN '/dev/null' ELSE 'b/' || path END || chr(10) ||
    '@@ -1 +' || CAST(first_line AS STRING) || ' @@' || chr(10) || '+x' || chr(10) || '@@ -1 +' || CAST(last_line AS STRING) || ',1 @@' || chr(10) || '+y' || chr(10) AS diff FROM files"""


def _replay(spark: SparkSession, sf_dir: str) -> Replay:
    g = GraphSource(spark, sf_dir)
    return Replay(g.sql(f"WITH files AS ({_FILES}) {_DIFF}"), g.sql(_FILES), g.table("gl_definition"), g.table("gl_calls"), own_prefixes=("vendored/",))


def replay_edits(spark, sf_dir) -> DataFrame:
    """Changed functions of all commits, whether their contract broke, and the commit's edit class."""
    r = _replay(spark, sf_dir)
    broken = r.broken.withColumn("broken_name", F.lit(True))
    return r.names.join(broken, ["event_id", "name"], "left").join(r.edits, "event_id").select("event_id", "name", F.coalesce("broken_name", F.lit(False)).alias("is_broken"), "files", "edit_class")


def replay_dependents(spark, sf_dir) -> DataFrame:
    """What the changed functions of all commits reach, by the traversal that verdicts share."""
    r = _replay(spark, sf_dir)
    totals = r.impact.totals().select("event_id", "total_dependents", "affected_services")
    return r.edits.select("event_id", "edit_class").join(totals, "event_id", "left").fillna({"total_dependents": 0, "affected_services": 0})


def replay_verdicts(spark, sf_dir) -> DataFrame:
    """The decision on every commit, from diffs alone."""
    return _replay(spark, sf_dir).verdicts().select("event_id", "edit_class", "total_dependents", "n_keystones", "changed_cut", F.round("risk", 6).alias("risk"), "level", "action")


FUNCTIONS = [replay_edits, replay_dependents, replay_verdicts]


def sql(event_walk: str) -> dict[str, str]:
    """What the forms of edits must give, stated outright."""
    n = edits.FORMS
    parts = f"""f AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS event_id, d.id, d.id % {n} AS form, d.id % 3 AS hunk, d.name FROM lineitem JOIN gl_definition d ON d.id = l_partkey WHERE d.id % 16 <> 9),
        changed AS (SELECT DISTINCT event_id, CASE WHEN form = 5 THEN 'renamed' ELSE name END AS changed_symbol FROM f WHERE hunk <> 1 AND form NOT IN (3, 7)
            UNION SELECT event_id, 'other' FROM f WHERE (hunk = 1 AND form IN (0, 1, 2, 5)) OR (hunk <> 1 AND form = 3)),
        gone AS (SELECT event_id, name FROM f WHERE form IN (2, 3, 5, 7) UNION SELECT event_id, 'other' FROM f WHERE form = 7),
        named AS (SELECT c.event_id, c.changed_symbol AS name, g.name IS NOT NULL AS is_broken FROM changed c LEFT JOIN gone g ON g.event_id = c.event_id AND g.name = c.changed_symbol),
        classes AS (SELECT event_id, files, CASE WHEN b THEN 'contract-break' WHEN cosmetic THEN 'cosmetic' ELSE 'body-edit' END AS edit_class FROM
            (SELECT event_id, count(*) AS files, bool_and(form IN (0, 4)) AS cosmetic FROM f GROUP BY 1) JOIN (SELECT event_id, bool_or(is_broken) AS b FROM named GROUP BY 1) USING (event_id))"""
    walk = event_walk.replace("mr_event v", "changed v")
    return {
        "replay_edits": f"WITH {parts} SELECT event_id, name, is_broken, files, edit_class FROM named JOIN classes USING (event_id)",
        "replay_dependents": f"""WITH RECURSIVE {parts}, {walk}, t AS (SELECT event_id, count(DISTINCT id) AS total_dependents, count(DISTINCT project_id) AS affected_services FROM deps GROUP BY 1)
            SELECT c.event_id, c.edit_class, coalesce(t.total_dependents, 0) AS total_dependents, coalesce(t.affected_services, 0) AS affected_services FROM classes c LEFT JOIN t USING (event_id)""",
    }
