"""Operator 11 - lines that come again across documents, by levelled sorted runs of line hashes.

A line's key is the line without white space at both ends and with A-Z lower-cased; keys of fewer than
``MIN_CHARS`` code points are left alone.  Keys are held as two 64-bit hashes.

A *run* is a table of (h, g, n, last): the hash, in how many documents it is found and the largest of
their ids; it is bucketed and sorted by the hash.  Documents come in batches.  Each new batch

1. is reduced to one row a key,
2. merge-anti-joins the runs: a key that a run has settled (``min_docs`` documents, and none of the batch
   comes later) goes, as the batch can add nothing to it.  Runs lie in buckets, so only the batch is shuffled,
3. adds what is left as a run of its own.  ``FAN_OUT`` runs of one level are compacted to one of the next.

So a key is rewritten once a level, and at most ``FAN_OUT`` - 1 runs a level are read.  A run's folder is
named after the batches it covers; a run counts once it is complete, and runs covered by a larger one
do not, so a step that breaks off leaves the store as it was or as it should be, and a replayed batch is known.

A whole table is taken in ``BATCHES`` ranges of doc_id from the largest down, so the first run that has
a key has its largest document.  The runs' sum then says which lines go: those of keys in ``min_docs``
documents or more, but for the last document.  Line numbers to drop are gathered by document and joined
to the texts, which are shuffled once.

All of it is DataFrame functions.  Defined cases: a null or empty text is one empty line and stays; a
null doc_id is one id before all others; rows of one id are one document for counting, and are rewritten one by
one; equal rows lose the same lines; a line that a document repeats is found in it once and goes or stays with all its
repeats; an empty table gives an empty result; further columns stay.  A text is one row and has to fit a task; dropped
lines are looked up in constant time, so long texts cost in proportion.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .cases import free, known, lower_ascii
from .scratch import Scratch

MIN_CHARS, MIN_DOCS, FAN_OUT, BATCHES = 40, 5, 4, 8
#: Keys of one bucket of a run over the whole table, at most, and the fewest buckets.
BUCKET_KEYS, FEWEST_BUCKETS = 1 << 20, 8
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h", "g"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(_SPACE)))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, pos, h, g): the lines whose key is long enough."""
    lines = (docs.select(known(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
             .select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("id", "th", "pos", line_key(F.col("line")).alias("key")))
    return lines.where(F.length("key") >= min_chars).select("id", "th", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), "key").alias("g"))


def by_key(lines: DataFrame) -> DataFrame:
    """(h, g, n, last) of some lines: a key's documents are made distinct before they meet."""
    return lines.select(*_KEY, "id").distinct().groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("id").alias("last"))


class LineRuns:
    """The runs in one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = FEWEST_BUCKETS, min_docs: int = MIN_DOCS, fan_out: int = FAN_OUT) -> None:
        self.spark, self.folder, self.buckets, self.min_docs, self.fan_out = spark, folder, buckets, min_docs, fan_out
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self) -> list[tuple[int, int]]:
        if not self._files.exists(self._path(self.folder)):
            return []
        names = (re.fullmatch(r"run-(\d+)-(\d+)", x.getPath().getName()) for x in self._files.listStatus(self._path(self.folder)))
        found = [(int(m[1]), int(m[2])) for m in names if m]
        return sorted(x for x in found if self._files.exists(self._path(f"{self._at(x)}/_SUCCESS")))

    def _at(self, run: tuple[int, int]) -> str:
        return f"{self.folder}/run-{run[0]}-{run[1]}"

    def live(self) -> list[tuple[int, int]]:
        """The batches that each run covers, without runs that a larger one covers."""
        runs = self._complete()
        return [x for x in runs if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in runs)]

    def _read(self, run: tuple[int, int]) -> DataFrame:
        """A run as a bucketed table; the catalogue's entry is needed only while the plan is made."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (h BIGINT, g BIGINT, n BIGINT, last BIGINT) USING parquet CLUSTERED BY (h, g) SORTED BY (h, g) INTO {self.buckets} BUCKETS LOCATION '{self._at(run)}'")
        try:
            return self.spark.table(name).select("*")
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        """A task for each bucket, so that each bucket is one sorted file."""
        name = f"line_run_{uuid.uuid4().hex}"
        self._files.delete(self._path(self._at(run)), True)
        try:
            rows.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", self._at(run)).saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def has(self, batch: int) -> bool:
        return any(lo <= batch <= hi for lo, hi in self.live())

    def settled(self, run: tuple[int, int]) -> DataFrame:
        return self._read(run).where(F.col("n") >= self.min_docs).select("h", "g", F.col("last").alias("settled"))

    def add(self, batch: int, keys: DataFrame) -> None:
        """Add what the runs have not settled of a batch's (h, g, n, last); a batch that is there already is left out.

        Batches are numbered from 0 without gaps.
        """
        if not self.has(batch):
            fresh = keys.repartition(self.buckets, *_KEY)
            for run in self.live():
                known_ = self.settled(run)
                fresh = fresh.join(known_.hint("merge"), (fresh["h"] == known_["h"]) & (fresh["g"] == known_["g"]) & (fresh["last"] <= known_["settled"]), "left_anti")
            self._write(fresh, (batch, batch))
        self.compact()

    def compact(self) -> None:
        """Runs of one level that have become ``fan_out`` are one of the next level."""
        while True:
            runs = self.live()
            levels: dict[int, list[tuple[int, int]]] = {}
            for run in runs:
                levels.setdefault(run[1] - run[0], []).append(run)
            full = next((x[: self.fan_out] for x in levels.values() if len(x) >= self.fan_out), None)
            if full is None:
                break
            self._write(self._summed(full).repartition(self.buckets, *_KEY), (full[0][0], full[-1][1]))
            self._clear()
        self._clear()

    def _clear(self) -> None:
        """Delete runs that a larger one covers; nothing reads them any more."""
        live = self.live()
        for run in self._complete():
            if run not in live:
                self._files.delete(self._path(self._at(run)), True)

    def _summed(self, runs: list[tuple[int, int]]) -> DataFrame:
        # Read as plain files: a union of bucketed tables that is grouped without a shuffle gave wrong sums in Spark 4.1.
        rows = self.spark.read.schema("h long, g long, n long, last long").parquet(*(self._at(run) for run in runs))
        return rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def common(self) -> DataFrame:
        """(h, g, last) of the keys in enough documents of all batches."""
        runs = self.live()
        if not runs:
            return self.spark.createDataFrame([], "h long, g long, last long")
        return self._summed(runs).where(F.col("n") >= self.min_docs).select(*_KEY, "last")


def _without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str, out: tuple[str, str, str]) -> DataFrame:
    """``docs`` with (lines, dropped lines, kept text) as the columns ``out``; ``dropped``: (id, th, pos)."""
    id_, th, at, text = free([*docs.columns, *out], "_id", "_th", "_at", "_text")
    gone = (dropped.groupBy(F.col("id").alias(id_), F.col("th").alias(th)).agg(F.sort_array(F.collect_set("pos")).alias(at)))
    told = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumns({id_: known(id_col), th: F.xxhash64(text)})
    # A byte for each line up to the last that goes; a byte of a binary is found at once, however long the text.
    q = f"`{at}`"
    mask = f"cast(array_join(transform({q}, (p, k) -> concat(repeat('0', p - if(k = 0, -1, {q}[k - 1]) - 1), '1')), '') as binary)"
    kept = F.expr(f"array_join(transform(filter(transform(split(`{text}`, '\\n', -1), (x, i) -> struct(x, i)), y -> substring({mask_name(at)}, y.i + 1, 1) <> X'31'), y -> y.x), '\\n')")
    joined = told.join(gone, [id_, th], "left").withColumn(mask_name(at), F.expr(mask))
    return joined.select(*docs.columns, F.size(F.split(text, "\n", -1)).cast("long").alias(out[0]), F.coalesce(F.size(at), F.lit(0)).cast("long").alias(out[1]),
                         F.when(F.col(at).isNull(), F.col(text)).otherwise(kept).alias(out[2]))


def mask_name(at: str) -> str:
    return f"{at}_mask"


def strip_common_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text",
                       out: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
    """All rows and columns of ``docs`` and their number of lines, of dropped lines and the text that is left."""
    scratch = Scratch(spark, "lines")
    ends = docs.select(F.percentile_approx(known(id_col), [k / batches for k in range(1, batches)], 10_000).alias("ends")).first()["ends"] or []
    batch = F.lit(0)
    for end in sorted(set(ends)):
        batch = batch + F.when(F.col("id") <= end, 1).otherwise(0)
    lines = lines_of(docs, id_col, text_col, min_chars).withColumn("batch", batch)
    # A folder for each batch, which reads nothing of the others.
    lines.write.partitionBy("batch").parquet(f"{scratch.root}/lines")
    lines = spark.read.schema(lines.schema).parquet(f"{scratch.root}/lines")
    store = LineRuns(spark, f"{scratch.root}/runs", max(FEWEST_BUCKETS, -(-lines.count() // BUCKET_KEYS)), min_docs)
    for number in range(len(set(ends)) + 1):
        store.add(number, by_key(lines.where(F.col("batch") == number)))
    common = scratch.save(store.common(), "common", release=False)
    dropped = lines.join(common, _KEY).where("id < last").select("id", "th", "pos")
    return _without(docs, dropped, id_col, text_col, out)


def strip_seen_lines(spark: SparkSession, docs: DataFrame, store: LineRuns, number: int, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text",
                     out: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
    """One batch of a stream of documents: without the lines that earlier batches have settled; its own lines are added.

    With ``min_docs`` = 1 a line stays only in the first batch that has it.  A document that comes again in a
    later batch counts again.  The result is written before the store grows, so a batch may be repeated until it is added.
    """
    scratch = Scratch(spark, "lines")
    lines = scratch.save(lines_of(docs, id_col, text_col, min_chars), "lines")
    rest = lines.repartition(store.buckets, *_KEY)
    earlier = [run for run in store.live() if run[1] < number]
    seen = [store.settled(run).select(*_KEY) for run in earlier]
    fresh = rest
    for keys in seen:
        fresh = fresh.join(keys.hint("merge"), _KEY, "left_anti")
    result = scratch.save(_without(docs, lines.select("id", "th", "pos").exceptAll(fresh.select("id", "th", "pos")) if seen else lines.limit(0), id_col, text_col, out), "out")
    store.add(number, by_key(lines))
    return result


def lines_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    return strip_common_lines(spark, docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
