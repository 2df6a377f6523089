"""Event intake: scoring in micro-batches, throttle windows, keyed upserts."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..durable import Scratch, shared_folder
from ..operators import centrality
from ..operators.impact import Impact

EVENT_SCHEMA = "event_id long, event_type string, timestamp timestamp, payload struct<mr_id:long,changed_symbols:array<string>,edit_class:string,severity:string>"
THROTTLE_SECONDS, THROTTLE_LIMIT = 60, 10


def route(events: DataFrame) -> DataFrame:
    """Adds ``kind``: change, finding or unknown, by what the event type contains."""
    kind = F.col("event_type")
    return events.withColumn("kind", F.when(kind.contains("merge_request.opened") | kind.contains("mr_opened"), "change")
                             .when(kind.contains("vulnerability.created") | kind.contains("finding_created"), "finding").otherwise("unknown"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


def changed(events: DataFrame) -> DataFrame:
    """(event_id, changed_symbol, edit_class), one row per symbol of change events."""
    return route(events).where("kind = 'change'").select("event_id", F.explode("payload.changed_symbols").alias("changed_symbol"), F.col("payload.edit_class").alias("edit_class"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class Versions:
    """Keyed rows in immutable version folders, named by numbered manifests.

    A manifest lists (first batch, last batch, folder) and is written beside its place, then renamed to a
    number that must be new; that is the only step that readers can see.  Folders that no manifest names
    are left over from steps that broke off, and are deleted by the next compaction.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[str]:
        at = self._path(f"{self.folder}/{part}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def _number(self) -> int:
        return max((int(n) for n in self._names("manifest") if n.isdigit()), default=0)

    def entries(self) -> list[tuple[int, int, str]]:
        """What the newest manifest names."""
        number = self._number()
        if not number:
            return []
        text = "".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest/{number:012d}", wholetext=True).collect())
        return [tuple(x) for x in json.loads(text)]

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return name

    def _commit(self, entries: list[tuple[int, int, str]]) -> None:
        draft, number = f"{self.folder}/manifest/draft-{uuid.uuid4().hex}", self._number() + 1
        stream = self._files.create(self._path(draft), False)
        stream.write(bytearray(json.dumps(sorted(entries)).encode()))
        stream.close()
        if not self._files.rename(self._path(draft), self._path(f"{self.folder}/manifest/{number:012d}")):
            raise RuntimeError(f"another writer has made manifest {number} of {self.folder}")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """A batch's rows as a version; a replayed batch takes the place of its own version, or is left out once that is compacted."""
        held = self.entries()
        if any(lo <= batch <= hi and lo < hi for lo, hi, _ in held):
            return
        name = self._write(rows.withColumn("batch_id", F.lit(batch).cast("long")))
        self._commit([*(e for e in held if e[:2] != (batch, batch)), (batch, batch, name)])

    def rows(self) -> DataFrame:
        """All versions' rows."""
        held = self.entries()
        if not held:
            raise FileNotFoundError(f"no version of {self.folder} is complete")
        return self.spark.read.parquet(*(f"{self.folder}/data/{name}" for _, _, name in held))

    def compact(self, keys: list[str]) -> None:
        """All versions but the newest become one; what no manifest names any more is deleted last."""
        held = sorted(self.entries())
        old = held[:-1]
        if len(old) > 1:
            merged = latest(self.spark.read.parquet(*(f"{self.folder}/data/{name}" for _, _, name in old)), keys, "batch_id")
            self._commit([(old[0][0], old[-1][1], self._write(merged)), held[-1]])
        self._clear()

    def _clear(self) -> None:
        named, number = {name for _, _, name in self.entries()}, self._number()
        for name in self._names("data"):
            if name not in named:
                self._files.delete(self._path(f"{self.folder}/data/{name}"), True)
        for name in self._names("manifest"):
            if not name.isdigit() or int(name) < number:
                self._files.delete(self._path(f"{self.folder}/manifest/{name}"), True)


def upsert(spark: SparkSession, rows: DataFrame, folder: str, keys: list[str], batch: int) -> None:
    """Keyed upsert of one batch; see ``Versions``."""
    Versions(spark, folder).upsert(rows, batch)


def current(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """What the upserts amount to: the newest row of each key."""
    return latest(Versions(spark, folder).rows(), keys, "batch_id")


def compact(spark: SparkSession, folder: str, keys: list[str]) -> None:
    """Merges all versions but the newest into one, so that readers need not go through the whole history."""
    Versions(spark, folder).compact(keys)


class GraphState:
    """What batches of one graph share, by version of the graph: PageRank ranks, kept in the shared folder.

    A version is known by its edges, whatever their order: their number and two sums of their hashes.  An
    unchanged graph reads what is there, in this driver or another; a changed one begins with the scores
    of the version before.
    """

    def __init__(self, source, folder: str | None = None) -> None:
        self.source, self._held = source, {}
        self.folder = folder or f"{shared_folder(source.spark)}/graph-state-{uuid.uuid4().hex}"
        jvm = source.spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(source.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str:
        sums = (F.sum(F.xxhash64(F.lit(seed), "source_id", "target_id").cast("decimal(38,0)")) for seed in (0, 1))
        found = self.source.table("gl_calls").agg(F.count("*"), *sums).first()
        return hashlib.sha256("/".join(map(str, found)).encode()).hexdigest()[:32]

    def _complete(self) -> list[str]:
        if not self._files.exists(self._path(self.folder)):
            return []
        states = sorted(self._files.listStatus(self._path(self.folder)), key=lambda s: s.getModificationTime())
        return [s.getPath().getName() for s in states if self._files.exists(self._path(f"{s.getPath()}/_SUCCESS"))]

    def scores(self) -> DataFrame:
        """(id, score, change, rounds, rank) of the graph as it is now."""
        spark, version, known = self.source.spark, self.version(), self._complete()
        if version not in known:
            scratch = Scratch(spark, "state")
            start = spark.read.parquet(f"{self.folder}/{known[-1]}") if known else None
            scores = centrality.pagerank(self.source.table("gl_calls"), scratch, start=start)
            placed = centrality.ranked(scores, scratch).join(scores.select("id", "change", "rounds"), "id")
            placed.write.mode("overwrite").parquet(f"{self.folder}/{version}")
            for old in known[:-1]:
                self._files.delete(self._path(f"{self.folder}/{old}"), True)
        return spark.read.parquet(f"{self.folder}/{version}")

    def ranks(self) -> DataFrame:
        version = self.version()
        if version not in self._held:
            self._held = {version: self.scores().select("id", "score", "rank")}
        return self._held[version]

    def impact(self, batch: DataFrame) -> Impact:
        """The shared results of one batch of (event_id, changed_symbol, edit_class)."""
        return Impact(batch, self.source.table("gl_definition"), self.source.table("gl_calls"), self.ranks())


def score_stream(events: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch of events with one job for all of them and upserts the verdicts."""

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.sparkSession, score(changed(batch)), folder, ["event_id"], batch_id)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttle(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = THROTTLE_SECONDS, limit: int = THROTTLE_LIMIT) -> DataFrame:
    """(key, window_start, n, allowed) by tumbling windows; works on batches and on streams with late data up to two windows."""
    if events.isStreaming:
        events = events.withWatermark(ts, f"{2 * seconds} seconds")
    per = events.groupBy(key, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return per.select(key, F.unix_timestamp("w.start").alias("window_start"), "n", F.least("n", F.lit(limit)).cast("long").alias("allowed"))
