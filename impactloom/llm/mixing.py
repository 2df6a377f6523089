"""Operator 2 - mixing sources to target weights by drawing fixed-length blocks.

Sizes are words (maximal runs of bytes other than space and 0x09-0x0D).  Sources in code-point order,
null last, weigh 5, 2, 1, repeating.  They share ``share`` = 150 % of all words; a target stops at
twice its source's size and the excess is shared again by weight until none is above.

The words of a source are packed end to end into blocks of ``block`` words.  A source gives as many
block draws, its *slots*, as its target needs; the last one is cut so that the words drawn equal the
target.  Output shards draw multinomial source counts from the slots that are left, and the last
shard takes the rest.  A slot is mapped to a block by a keyed pseudorandom permutation of the block
indices, a new one for each pass, so no block comes again before all others have come, and none more
than twice.  Slots meet documents by joining on (source, block index).

What the driver holds is one row per source, and one per source and shard (a shard has ``2**20``
blocks; there are 64 at least).  Everything is a function of the input rows and the seed.

Defined cases: a null text has size 0; documents of size 0 are returned with nothing taken; a null
source is a source of its own, as is the empty string; texts of any length are cut into blocks whole;
repeated rows are separate documents; a null
doc_id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textscan
from .cases import free, if_small, known
from .ranks import running_totals
from .scratch import Scratch

BLOCK_WORDS, SHARE, WEIGHTS, REPEAT_LIMIT, SEED = 512, 1.5, (5, 2, 1), 2, 20240301
SHARD_BLOCKS, MIN_SHARDS = 1 << 20, 64
#: Characters of one batch of mixed texts.
OUT_CHARS = 4 << 20


def share_targets(sizes: list[int], weights: list[float], share: float = SHARE, limit: float = REPEAT_LIMIT) -> list[float]:
    """Targets proportional to weights, none above ``limit`` times its size, the excess reshared."""
    targets = [0.0] * len(sizes)
    open_, rest = [i for i, s in enumerate(sizes) if s], share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if rest * weights[i] / total > limit * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = rest * weights[i] / total
            break
        for i in above:
            targets[i] = float(limit * sizes[i])
            rest -= targets[i]
        gone = set(above)
        open_ = [i for i in open_ if i not in gone]
    return targets


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1, element by element: a Feistel network with cycle walking."""
    x, n, key = (np.asarray(a).astype(np.uint64) for a in (x, n, key))
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) // 2)).astype(np.uint64)
    half = half + ((np.uint64(1) << (np.uint64(2) * half)) < n).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in (range(4) if not inverse else range(3, -1, -1)):
            salt = np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            if inverse:
                left, right = right ^ (textscan.mix(left ^ k ^ salt) & m), left
            else:
                left, right = right, left ^ (textscan.mix(right ^ k ^ salt) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _pass_key(seed: int, source: int, pass_: int) -> int:
    return int(textscan.mix(np.array([seed * 1_000_003 + source * 7919 + pass_], dtype=np.uint64))[0] >> np.uint64(1))


def plan_slots(index: int, size: int, target: float, block: int, seed: int) -> dict:
    """How many slots a source has, and where the last one is cut."""
    n, taken = -(-size // block), min(round(target), REPEAT_LIMIT * size)
    passes, rest = divmod(taken, size) if size else (0, 0)
    slots, cut = passes * n, block
    if rest:
        short, missing = int(permute(np.array([n - 1]), np.array([n]), np.array([_pass_key(seed, index, passes)]), inverse=True)[0]), n * block - size
        words = lambda m: m * block - missing * (short < m)  # noqa: E731  of the first m slots of the pass
        k = -(-rest // block)
        k += words(k) < rest
        slots, cut = slots + k, rest - words(k - 1)
    return {"idx": index, "n": n, "slots": slots, "cut": cut, "passes": passes}


def draw_shards(slots: list[int], seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, end slot): multinomial counts that never overdraw and end exactly."""
    left = np.array(slots, dtype=np.int64)
    shards = max(MIN_SHARDS, -(-int(left.sum()) // SHARD_BLOCKS))
    rng, at, rows = np.random.default_rng(seed), np.zeros(len(left), dtype=np.int64), []
    for shard in range(shards):
        want, got = -(-int(left.sum()) // (shards - shard)), np.zeros(len(left), dtype=np.int64)
        while (missing := want - int(got.sum())) > 0:
            open_ = left - got
            got += np.minimum(rng.multinomial(missing, open_ / open_.sum()), open_)
        rows += [(shard, int(s), int(at[s]), int(at[s] + got[s])) for s in np.flatnonzero(got)]
        at, left = at + got, left - got
    return rows


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [w.counts for _, _, w in textscan.chunks(batch.column(3))]
        yield pa.record_batch([*batch.columns[:3], pa.array(np.concatenate(counts) if counts else [], type=pa.int64())],
                              names=["doc_id", "source", "tie", "size"])


def _map_slots(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in pdfs:
        yield pd.DataFrame({"idx": p["idx"], "shard": p["shard"], "slot": p["slot"], "pass": p["slot"] // p["n"],
                            "block": permute((p["slot"] % p["n"]).to_numpy(), p["n"].to_numpy(), p["key"].to_numpy()), "take": p["take"]})


class Mix:
    """The mix of a table of documents.

    ``sized``: (doc_id, source, tie, size); ``sources``: one row per source; ``segments``: (idx, block,
    lo, hi, start, doc_id, tie) the words of a document in a block; ``slots``: (idx, shard, slot, pass,
    block, take) the draws, ``take`` being how many words of the block are taken.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 block: int = BLOCK_WORDS, share: float = SHARE, weights: tuple = WEIGHTS, seed: int = SEED) -> None:
        scratch = Scratch(spark, "mixing")
        read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                           F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
        self.sized = scratch.save(read.mapInArrow(_sizes, "doc_id long, source string, tie long, size long"), "sized")
        # One row per source, which the driver holds; the table of sources is broadcast if it is short.
        rows = self.sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
        rows = sorted(((r["source"], r["size"] or 0) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
        sizes = [size for _, size in rows]
        targets = share_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], share)
        plans = [plan_slots(i, size, target, block, seed) for i, (size, target) in enumerate(zip(sizes, targets))]
        self.sources = spark.createDataFrame(
            [(i, name, size, float(target), p["passes"]) for i, ((name, size), target, p) in enumerate(zip(rows, targets, plans))],
            "idx int, source string, source_size long, target double, passes int")
        self.n_sources = len(rows)
        named = self.sized.join(self._few(self.sources), self.sized["source"].eqNullSafe(self.sources["source"])).select("idx", "doc_id", "tie", "size")
        placed = running_totals(named.where("size > 0"), scratch, "idx", ["doc_id", "tie", "size"], "size", "start")
        self.segments = (placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
                         .select("idx", "block", "doc_id", "tie", "start", "size",
                                 F.greatest(F.col("start") - F.col("block") * block, F.lit(0)).alias("lo"),
                                 F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)).alias("hi")))
        drawn = draw_shards([p["slots"] for p in plans], seed) if plans else []
        keys = {(p["idx"], k): _pass_key(seed, p["idx"], k) for p in plans for k in range(REPEAT_LIMIT + 1)}
        shards = spark.createDataFrame([(shard, s, lo, hi, plans[s]["n"], plans[s]["slots"] - 1, plans[s]["cut"], [keys[s, k] for k in range(REPEAT_LIMIT + 1)])
                                        for shard, s, lo, hi in drawn],
                                       "shard int, idx int, lo long, hi long, n long, last long, cut long, keys array<bigint>")
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.slots = (shards.repartition(width, "shard", "idx").withColumn("slot", F.explode(F.expr("sequence(lo, hi - 1)")))
                      .select("idx", "shard", "slot", "n", F.expr("keys[int(slot div n)]").alias("key"),
                              F.when(F.col("slot") == F.col("last"), F.col("cut")).otherwise(F.lit(block)).alias("take"))
                      .mapInPandas(_map_slots, "idx int, shard int, slot long, pass int, block long, take long"))
        self.block = block

    def _few(self, sources: DataFrame) -> DataFrame:
        return if_small(sources, self.n_sources)

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), one row per document."""
        draws = self.slots.groupBy("idx", "block").agg(F.count_if(F.col("take") == self.block).alias("whole"),
                                                       F.sum(F.when(F.col("take") < self.block, F.col("take")).otherwise(0)).alias("part"))
        words = F.col("whole") * (F.col("hi") - F.col("lo")) + F.greatest(F.least("hi", "part") - F.col("lo"), F.lit(0))
        # Spark's estimate of the draws knows nothing of their expansion and would have them broadcast.
        # A document of some size is known by its source and its place there; others have nothing to take.
        per_doc = (self.segments.join(draws.hint("merge"), ["idx", "block"], "left").groupBy("idx", "start", "doc_id", "size")
                   .agg(F.sum(F.coalesce(words, F.lit(0))).cast("long").alias("taken")))
        empty = (self.sized.where("size = 0").join(self._few(self.sources), self.sized["source"].eqNullSafe(self.sources["source"]))
                 .select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
        return per_doc.join(self._few(self.sources), "idx").select("doc_id", "size", "source_size", "target", "taken").unionByName(empty)

    def pieces(self) -> DataFrame:
        """(doc_id, tie, source, copies, ranges, times): whole passes and the word ranges of the last, partial one, of so many equal rows."""
        partial = self.slots.join(self._few(self.sources.select("idx", "passes")), "idx").where(F.col("pass") == F.col("passes")).select("idx", "block", "take")
        ranges = (self.segments.join(partial.hint("merge"), ["idx", "block"], "left")
                  .withColumn("until", F.when(F.col("take").isNotNull(), F.least("hi", "take"))).withColumn("base", F.col("block") * self.block - F.col("start"))
                  .groupBy("idx", "start", "doc_id", "tie", "size")
                  .agg(F.sort_array(F.collect_list(F.when(F.col("until") > F.col("lo"), F.struct((F.col("lo") + F.col("base")).alias("lo"),
                                                                                                (F.col("until") + F.col("base")).alias("hi"))))).alias("ranges")))
        return (ranges.join(self._few(self.sources.select("idx", "source", F.col("passes").alias("copies"))), "idx")
                .groupBy("doc_id", "tie", "source", "copies", "ranges").agg(F.count("*").alias("times")))


def _merged(ranges: list) -> list[tuple[int, int]]:
    """Ranges of words in order, neighbours as one."""
    out: list[list[int]] = []
    for r in ranges:
        if out and out[-1][1] == r["lo"]:
            out[-1][1] = r["hi"]
        else:
            out.append([r["lo"], r["hi"]])
    return [(lo, hi) for lo, hi in out]


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: one row for each whole pass over a document and
    for each run of neighbouring words that the last pass takes.  Texts of no size are not taken.

    Rows with equal id, text and source are one row here, and how often they come is a number: one of
    them stands for all, and repeats that are cut alike are one entry.
    """
    mix = Mix(spark, docs)
    names, schema = docs.columns, docs.schema
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None
    key = free(names, "_id", "_tie", "_source", "_none")
    copies, ranges, times = free([*names, *key], "_copies", "_ranges", "_times")

    def keyed(df: DataFrame, tie) -> DataFrame:
        return df.withColumns(dict(zip(key, (known("doc_id"), tie, F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("source").isNull()))))

    own = keyed(docs, F.xxhash64("text")).dropDuplicates(key)
    given = keyed(mix.pieces(), F.col("tie")).select(*key, F.col("copies").alias(copies), F.col("ranges").alias(ranges), F.col("times").alias(times))
    rows = own.join(given.hint("merge"), key).select(*names, copies, ranges, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, take: list[int], texts: list[str]) -> pa.RecordBatch:
            out = batch.take(pa.array(take, type=pa.int64()))
            columns = [out.column(j) for j in range(len(names))]
            columns[text_at] = pa.array(texts, type=batch.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array([len(t) for t in texts]).cast(batch.schema.field(chars_at).type)
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            take, texts, size = [], [], 0
            for i, (text, whole, parts, n) in enumerate(zip(*(batch.column(j).to_pylist() for j in (text_at, len(names), len(names) + 1, len(names) + 2)))):
                merged, cut = _merged(parts), []
                if merged:
                    raw = text.encode()
                    words = textscan.Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
                    cut = [raw[words.start[lo] : words.end[hi - 1]].decode() for lo, hi in merged]
                for _ in range(n):
                    for t in [*[text] * whole, *cut]:
                        take.append(i)
                        texts.append(t)
                        size += len(t)
                        if size > OUT_CHARS:
                            yield made(batch, take, texts)
                            take, texts, size = [], [], 0
            if take:
                yield made(batch, take, texts)

    return rows.mapInArrow(run, schema)


def mix_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of the production mix."""
    return Mix(spark, docs).taken()
