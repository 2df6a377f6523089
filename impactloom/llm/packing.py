"""Operator 5 - best-fit packing planned on a histogram of lengths.

Texts become token ids (byte-level BPE, then the end id); longer ones are cut into full pieces, the
first of which may be shorter.  How many pieces there are of each length up to the sequence length
is a table of at most ``limit`` rows, whatever the corpus.  Best-fit decreasing runs on that table:
lengths from long to short, each going to the sequences with the least room that still take it, all
sequences with the same history at once.  The plan is a list of runs - (length, first rank, count,
first sequence, offset) - and each piece finds its place by joining its rank within its length.

Token ids: ``tiktoken`` reads the same vocabulary and pattern as the tokenizer file and is several
times faster; texts with characters above U+052F, with the tokenizer's special token or with more than
``LONG_RUN`` characters of white space on end go through ``tokenizers`` itself, so that differing Unicode
tables cannot matter and no text is too long.

Defined cases: null and empty texts are one piece that holds the end id only; texts of any length,
blanks on end included, are encoded whole; repeated rows and rows
that share an id are packed one by one; an empty table gives an empty result; a null doc_id stays
null; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .ranks import running_totals
from .scratch import Scratch

LIMIT, END_ID = 1024, 2
#: Characters of white space on end from which a text goes to ``tokenizers``.
LONG_RUN = 10_000
_WHITE = re.compile(r"\s+")
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, tie long"


class Encoder:
    """Token ids of ``byte_bpe_50k.json``; paths are parameters and are opened on the executors."""

    def __init__(self, tokenizer_path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        self.path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if "<|endoftext|>" in text or (not text.isascii() and max(text) > "ԯ") or (len(text) > LONG_RUN and self._long_run(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    @staticmethod
    def _long_run(text: str) -> bool:
        """Whether white space runs on so long that the pattern of ``tiktoken`` runs out of stack."""
        return any(m.end() - m.start() > LONG_RUN for m in _WHITE.finditer(text))

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)


@lru_cache(maxsize=1)
def _encoder(tokenizer_path: str | None, ranks_path: str | None) -> Encoder:
    """One encoder per worker process, whatever the number of its tasks."""
    return Encoder(tokenizer_path, ranks_path)


def _cut(limit: int, end_id: int, tokenizer_path: str | None, ranks_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, ranks_path)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc, text, tie in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                n, start, piece = len(ids), 0, 0
                end = n % limit or min(n, limit)
                while start < n:
                    for column, value in zip(rows, (doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), tie)):
                        column.append(value)
                    start, end, piece = end, end + limit, piece + 1
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()),
                                   pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int64()), pa.array(rows[5], pa.int64())],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    return run


def plan_best_fit(histogram: dict[int, int], limit: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: runs (length, first rank, count, first sequence, offset), and sequences used.

    Sequences with equal room are kept as ranges of ids; placing many pieces moves whole ranges.
    """
    room: dict[int, list[list[int]]] = {}
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            best = min((r for r, ranges in room.items() if r >= length and ranges), default=None)
            if best is None:
                # As many new sequences as the rest fills with this length alone, or a last one.
                fresh = max(1, left // (limit // length))
                room.setdefault(limit, []).append([opened, fresh])
                opened += fresh
                best = limit
            first, size = room[best][-1]
            take = min(left, size)
            if take == size:
                room[best].pop()
            else:
                room[best][-1] = [first + take, size - take]
            runs.append((length, rank, take, first, limit - best))
            if best > length:
                room.setdefault(best - length, []).append([first, take])
            left, rank = left - take, rank + take
    return runs, opened


def pack_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                   end_id: int = END_ID, tokenizer_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    scratch = Scratch(spark, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    pieces = scratch.save(docs.mapInArrow(_cut(limit, end_id, tokenizer_path, ranks_path), _PIECES), "pieces")
    # At most ``limit`` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_best_fit(histogram, limit)
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    plan = spark.createDataFrame([(length, parts) for length, parts in by_length.items()],
                                 "length int, plan array<struct<rank:bigint,count:bigint,sequence:bigint,offset:bigint>>")
    ranked = running_totals(pieces.withColumn("one", F.lit(1)), scratch, "length", ["doc_id", "piece", "tie", "start", "ids_crc32"], "one", "rank")
    # One row for each length: bounded by ``limit``, so it can go to every executor.
    slot = F.element_at(F.filter("plan", lambda r: (r["rank"] <= F.col("rank")) & (F.col("rank") < r["rank"] + r["count"])), 1)
    return (ranked.join(F.broadcast(plan), "length").withColumn("slot", slot)
            .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                    (F.col("slot.sequence") + F.col("rank") - F.col("slot.rank")).alias("sequence_id"), F.col("slot.offset").alias("offset")))
