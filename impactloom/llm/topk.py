"""Operator 7 - exact top-k inner products by pivot-table elimination.

Components x become floor(256 x).  Queries are the rows whose vec_id is divisible by ``every``; all
other rows than the query's own are candidates; the score is the integer inner product.

Since 2 q.x = |q|^2 + |x|^2 - d(q, x)^2 and, for any pivot p, d(q, x) >= |d(q, p) - d(x, p)|, the
largest such difference over a table of pivots bounds a candidate's score from above, as |q| |x| does.
All bounds are widened by their rounding error, so the answer is exact.  The plan:

1. The pivot table: each vector's distances to all pivots and its length, computed once and written.
   Vectors are put into blocks by their nearest pivot; a block keeps the range of its distances to
   each pivot and its greatest length, which bound the scores of all its members.
2. Each query meets the block it lies in; its k-th score there is a score to beat.
3. Queries meet the summaries of all blocks (a stated query set against all rows, in blocks): only
   blocks whose bound reaches the score to beat are wanted, and only wanted ones are shuffled.
4. In a meeting a query takes candidates in the order of their bounds, in batches, and stops when the
   next bound is below its k-th best score.  What blocks report, k rows a query, is merged by a window.

Pivots are drawn from the vectors with the smallest hashes, ``n_pivots`` for each of the ``MOST_DIMS``
most frequent lengths; they only affect speed, and vectors of other lengths have the bound |q| |x|.

Defined cases: vectors that are null, empty or hold nulls or non-finite components take no part;
vectors of another length are not comparable and never meet; equal rows count once, rows that share
a vec_id with other contents are candidates each, and none is its own id's answer; ties go to the
smaller vec_id; a null vec_id takes no part; inner products outside the range of a long are clipped
to it; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import Scratch
from .vectors import matrix, usable

K, EVERY, SCALE, PIVOTS = 5, 50, 256, 32
BLOCK, QUERY_BLOCK, BATCH, MOST_DIMS = 4096, 1024, 256, 64


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with several vectors."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * len(q)
    if largest < 2**53:
        return (x @ q).astype(np.int64)
    products = [sum(int(a) * int(b) for a, b in zip(q, row)) for row in x]
    return np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in products], dtype=np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _slack(total: np.ndarray) -> np.ndarray:
    return 1e-9 * total + 1e-6


def _table(pivots: dict[int, np.ndarray]):
    """Vectors to rows of the pivot table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, sq, near = [], [], []
            for d, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.frombuffer(v, dtype="<f8")
                sq.append(float(x @ x))
                row = _distances(x[None], pivots[d])[0] if d in pivots else np.zeros(0)
                far.append(row.astype("<f8").tobytes())
                near.append(int(row.argmin()) if len(row) else 0)
            yield pa.record_batch([*batch.columns, pa.array(far, type=pa.binary()), pa.array(sq, type=pa.float64()), pa.array(near, type=pa.int32())],
                                  names=["vec_id", "dim", "v", "far", "sq", "near"])

    return run


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    far = matrix(pdf["far"]) if len(pdf["far"].iloc[0]) else np.zeros((len(pdf), 0))
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "near": pdf["near"].iloc[:1], "sub": pdf["sub"].iloc[:1], "lo": [far.min(axis=0).tobytes()], "hi": [far.max(axis=0).tobytes()], "most": [pdf["sq"].max()]})


def _wanted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a block of queries and some summaries: (query row, block) where the block's bound reaches the score to beat."""
    out = []
    for _, part in pdf.groupby(["dim", "qb", "chunk"], sort=False):
        q, blocks = part[part["is_query"]], part[~part["is_query"]]
        if not len(q) or not len(blocks):
            continue
        n = len(q["far"].iloc[0]) // 8
        far, sq, beat = matrix(q["far"]) if n else np.zeros((len(q), 0)), q["sq"].to_numpy(), q["beat"].to_numpy()
        for near, sub, low, high, most in zip(*(blocks[c] for c in ("near", "sub", "lo", "hi", "most"))):
            low, high = np.frombuffer(low, dtype="<f8"), np.frombuffer(high, dtype="<f8")
            gap = np.maximum(np.maximum(low - far, far - high), 0).max(axis=1, initial=0)
            bound = np.minimum((sq + most - gap * gap) / 2, np.sqrt(sq * most)) + _slack(sq + most)
            ask = q[(bound >= beat) & ~((q["near"].to_numpy() == near) & (q["sub"].to_numpy() == sub))]
            if len(ask):
                out.append(ask.assign(near=near, sub=sub))
    columns = ["vec_id", "dim", "v", "far", "sq", "near", "sub", "qb", "beat"]
    return pd.concat(out)[columns] if out else pdf.iloc[:0][columns]


def _search(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for _, tile in pdf.groupby(["dim", "near", "sub", "qb"], sort=False):
            qs, xs = tile[tile["is_query"]].sort_values("vec_id"), tile[~tile["is_query"]].sort_values("vec_id")
            if not len(qs) or not len(xs):
                continue
            q, x = matrix(qs["v"]), matrix(xs["v"])
            q_id, x_id = qs["vec_id"].to_numpy(), xs["vec_id"].to_numpy()
            n = len(xs["far"].iloc[0]) // 8
            q_far, x_far = (matrix(t["far"]) if n else np.zeros((len(t), 0)) for t in (qs, xs))
            q_sq, x_sq, beat = qs["sq"].to_numpy(), xs["sq"].to_numpy(), qs["beat"].to_numpy()
            for i in range(len(q)):
                gap = np.zeros(len(x))
                for p in range(n):
                    np.maximum(gap, np.abs(x_far[:, p] - q_far[i, p]), out=gap)
                bound = np.minimum((q_sq[i] + x_sq - gap * gap) / 2, np.sqrt(q_sq[i] * x_sq)) + _slack(q_sq[i] + x_sq)
                bound[x_id == q_id[i]] = -np.inf
                order = np.argsort(-bound, kind="stable")
                score, which = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                at, batch = 0, BATCH
                while at < len(order) and bound[order[at]] > -np.inf and bound[order[at]] >= beat[i]:
                    if len(score) >= k and bound[order[at]] < score[k - 1]:
                        break
                    some = order[at : at + batch]
                    some = some[bound[some] > -np.inf]
                    score, which = np.r_[score, _exact(q[i], x[some])], np.r_[which, some]
                    best = np.lexsort((x_id[which], -score.astype(np.float64) if np.abs(score).max() < 2**53 else [-int(v) for v in score]))[:k]
                    score, which = score[best], which[best]
                    at, batch = at + batch, batch * 2
                out += [(int(q_id[i]), int(x_id[j]), int(s)) for s, j in zip(score, which)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


_FOUND = "query_id long, vec_id long, score long"


def exact_top_k(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, n_pivots: int = PIVOTS,
                id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    scratch = Scratch(spark, "topk")

    def whole(batches):
        for batch in batches:
            v = [np.floor(scale * np.array(x, dtype=np.float64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in v], type=pa.int32()),
                                   pa.array([x.astype("<f8").tobytes() for x in v], type=pa.binary())], names=["vec_id", "dim", "v"])

    rows = scratch.save(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
                        .where(F.col("vec_id").isNotNull() & usable("e")).mapInArrow(whole, "vec_id long, dim int, v binary").distinct(), "rows")
    # The driver holds at most ``n_pivots`` vectors of each of ``MOST_DIMS`` lengths.
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MOST_DIMS).collect()}
    first = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "vec_id")
    few = rows.where(F.col("dim").isin(list(sizes)) & (F.pmod(F.xxhash64("v", "vec_id"), F.lit(max(1, max(sizes.values(), default=1) // 4096))) == 0))
    chosen = few.withColumn("r", F.row_number().over(first)).where(F.col("r") <= n_pivots).select("dim", "v").collect()
    pivots = {d: np.stack([np.frombuffer(r["v"], dtype="<f8") for r in chosen if r["dim"] == d]) for d in {r["dim"] for r in chosen}}

    table = rows.mapInArrow(_table(pivots), "vec_id long, dim int, v binary, far binary, sq double, near int")
    table = scratch.save(table, "pivot-table")
    # As a table it is broadcast while it is small.
    blocks = scratch.save(table.groupBy("dim", "near").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")), "blocks")
    placed = table.join(blocks, ["dim", "near"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", "v"), F.col("nb")).cast("int")).drop("nb")
    asked = F.col("vec_id") % every == 0
    summaries = scratch.save(placed.select("dim", "near", "sub", "far", "sq").groupBy("dim", "near", "sub").applyInPandas(_summary, "dim int, near int, sub int, lo binary, hi binary, most double"), "summaries")

    # Queries in the blocks they lie in; ``qb`` deals a block's queries out.
    n_queries = table.where(asked).count()
    qb = F.pmod(F.xxhash64("v", "vec_id"), F.lit(max(1, -(-n_queries // QUERY_BLOCK)))).cast("int")
    queries = placed.where(asked).withColumn("qb", qb)
    nothing = F.lit(float("-inf"))
    candidates = lambda df: df.select("dim", "near", "sub", "qb", "vec_id", "v", "far", "sq", nothing.alias("beat"), F.lit(False).alias("is_query"))
    asking = lambda df: df.select("dim", "near", "sub", "qb", "vec_id", "v", "far", "sq", "beat", F.lit(True).alias("is_query"))
    meet = lambda q: (candidates(placed.join(q.select("dim", "near", "sub", "qb").distinct(), ["dim", "near", "sub"])).unionByName(asking(q))
                      .groupBy("dim", "near", "sub", "qb").applyInPandas(_search(k), _FOUND))
    own = scratch.save(meet(queries.withColumn("beat", nothing)), "own")
    # Rows that share an id share their results too, so the score to beat is the least k-th one of its rows' results.
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    beat = own.withColumn("r", F.row_number().over(nth)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("beat"))
    several = queries.groupBy("vec_id").agg(F.count("*").alias("contents"))
    queries = (queries.join(beat, "vec_id", "left").join(several, "vec_id")
               .withColumn("beat", F.when(F.col("contents") == 1, F.coalesce("beat", nothing)).otherwise(nothing)).drop("contents"))

    n_chunks = max(1, -(-summaries.count() // QUERY_BLOCK))
    ask = queries.select("dim", "qb", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), "vec_id", "v", "far", "sq", "near", "sub", "beat", F.lit(True).alias("is_query"),
                         F.lit(None).cast("binary").alias("lo"), F.lit(None).cast("binary").alias("hi"), F.lit(None).cast("double").alias("most"))
    groups = queries.select("dim", "qb").distinct()
    offer = (summaries.withColumn("chunk", F.pmod(F.xxhash64("dim", "near", "sub"), F.lit(n_chunks)).cast("int")).join(groups, "dim")
             .select("dim", "qb", "chunk", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("binary").alias("v"), F.lit(None).cast("binary").alias("far"), F.lit(None).cast("double").alias("sq"),
                     "near", "sub", F.lit(None).cast("double").alias("beat"), F.lit(False).alias("is_query"), "lo", "hi", "most"))
    wanted = ask.unionByName(offer).groupBy("dim", "qb", "chunk").applyInPandas(_wanted, "vec_id long, dim int, v binary, far binary, sq double, near int, sub int, qb int, beat double")
    wanted = scratch.save(wanted, "wanted")
    met = own.unionByName(meet(wanted))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
