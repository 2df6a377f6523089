"""Operator 10 - near-duplicate vectors: rotated binary codes, unbiased estimates, confidence bounds.

Links are pairs with cosine at least ``threshold``, computed in double precision.  Plan:

1. Equal vectors collapse to one row with a multiplicity.
2. Each unit vector is multiplied by random orthogonal matrices.  The signs after the first are its
   binary code c; kept with it, once and for all, are the correction factor f = <c, rotated> / sqrt(d)
   and the rotated vector itself on a grid of 16 levels, whose upper bits are the signs.  For another
   vector y, <c, y> / (f sqrt(d)) estimates the inner product without bias, and
   sqrt((1 - f^2) / f^2) * EPSILON / sqrt(d - 1) bounds its error with high probability; the grid's
   error, of which the length is kept too, widens that bound in the same way.
3. Sign bits of further rotations, ``b`` at a time, make ``L`` tables of buckets; b grows with
   log2 of the number of vectors and L so that a pair at the threshold shares a bucket in at least
   one table with probability ``RECALL`` (closer pairs more often).
4. Buckets are cut into tiles, to which codes, factors and keys go, not vectors.  In a tile the
   estimates of all pairs come from one matrix product; pairs whose estimate plus bound reaches the
   threshold, in the first table in which they meet, make their vectors *survivors* of the tile.
5. Only survivors fetch their vectors, and the tile's surviving pairs are computed exactly.  A tile
   reports link counts per vector and a spanning forest, never its pairs; components come from the
   forests.

Every row is indexed; nothing is sampled.  Recall against brute force is measured in the tests.

Defined cases: vectors that are null, empty, zero or hold nulls or non-finite components link with
nothing, not even with equal ones, and are returned with n_links 0; vectors of other lengths never
link; vectors are scaled by powers of two first, so that very long and very short ones neither
overflow nor vanish; equal vectors of several rows all link with each other; rows that share a vec_id are separate
rows with a shared component id; a null vec_id is one id before all others; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .cases import NULL_ID, known, shown
from .components import connected_components
from .scratch import Scratch
from .vectors import matrix, usable

THRESHOLD, RECALL, EPSILON, SEED = 0.9, 0.995, 3.0, 20240302
BUCKET_ROWS, TILE_ROWS = 64, 1024


def table_shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors: about ``BUCKET_ROWS`` a bucket, ``recall`` at the threshold."""
    bits = max(6, math.ceil(math.log2(max(2, n / BUCKET_ROWS))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def rotations(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrices, the same for all tasks."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def _key_type(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times powers of two, which rounds nothing, with largest components near 1; and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(axis=1))


def _record(dim: int) -> np.dtype:
    """What is stored of a vector: factor, step of the grid, length of the grid's error, and the grid, two components a byte."""
    return np.dtype([("f", "<f4"), ("step", "<f4"), ("off", "<f4"), ("grid", "u1", (dim + 1) // 2)])


def _encode(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    rotated = unit @ turn.T
    n, d = rotated.shape
    step = np.abs(rotated).max(axis=1, keepdims=True) / 7.5
    level = np.clip(np.floor(rotated / step + 8), 0, 15).astype(np.uint8)
    out = np.zeros(n, dtype=_record(d))
    out["f"] = (np.where(level > 7, 1.0, -1.0) * rotated).sum(axis=1) / math.sqrt(d)
    out["step"] = step[:, 0]
    out["off"] = np.sqrt(((rotated - (level - 7.5) * step) ** 2).sum(axis=1)) * (1 + 1e-6)
    pairs = np.concatenate((level, np.zeros((n, d % 2), dtype=np.uint8)), axis=1)
    out["grid"] = pairs[:, ::2] << 4 | pairs[:, 1::2]
    return out


def _codes(bits: int, tables: int, real: str):
    """Vectors to what is stored of them: codes with factors, and their buckets in all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            dims, keys, codes = np.array(batch.column(2).to_pylist()), [None] * batch.num_rows, [None] * batch.num_rows
            vectors = batch.column(1).to_pylist()
            for d in np.unique(dims) if len(dims) else []:
                if d not in made:
                    made[d] = rotations(int(d), 1 + -(-bits * tables // int(d)))
                at = np.flatnonzero(dims == d)
                x, length = _scaled(np.frombuffer(b"".join(vectors[i] for i in at), dtype=real).reshape(len(at), -1).astype(np.float64))
                x /= length[:, None]
                sign = np.concatenate([x @ r.T > 0 for r in made[d][1:]], axis=1)[:, : bits * tables].reshape(len(at), tables, bits)
                found = (sign @ (np.int64(1) << np.arange(bits, dtype=np.int64))).astype(_key_type(bits))
                for i, k, c in zip(at, found, _encode(x, made[d][0])):
                    keys[i], codes[i] = k.tobytes(), c.tobytes()
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(codes, type=pa.binary()), pa.array(keys, type=pa.binary())],
                                  names=["node", "dim", "code", "keys"])

    return run


def _spread(bits: int):
    """One row per vector and table, with the keys of the tables before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(_key_type(bits)).itemsize
        for batch in batches:
            packed = batch.column(3).to_pylist()
            if not packed:
                continue
            tables = len(packed[0]) // width
            keys = np.stack([np.frombuffer(k, dtype=_key_type(bits)) for k in packed])
            for tab in range(tables):
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.full(len(keys), tab, dtype=np.int32)), pa.array(keys[:, tab].astype(np.int64)), batch.column(2),
                                       pa.array([k[: tab * width] for k in packed], type=pa.binary())], names=["node", "dim", "tab", "bucket", "code", "earlier"])

    return run


_SPREAD = "node long, dim int, tab int, bucket long, code binary, earlier binary"
#: Rows of one side whose estimates are made at a time.
_STRIP = 256


def _reaching(dim: int, tab: int, codes: pd.Series, earlier: pd.Series, at: np.ndarray, t1: int, t2: int, threshold: float, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that meet here first and whose estimate plus bound reaches the threshold."""
    c = np.frombuffer(b"".join(codes), dtype=_record(dim))
    level = np.stack((c["grid"] >> 4, c["grid"] & 15), axis=2).reshape(len(c), -1)[:, :dim].astype(np.float64)
    sign, about = np.where(level > 7, 1.0, -1.0), (level - 7.5) * c["step"][:, None]
    f = c["f"].astype(np.float64)
    met = np.frombuffer(b"".join(earlier), dtype=key).reshape(len(c), tab) if tab else None
    a, b = np.flatnonzero(at == t1), np.flatnonzero(at == t2)
    # The estimate is of b's code against a's vector; the bound adds b's error and, spread alike, that of a's grid.
    spread = EPSILON / math.sqrt(max(1, dim - 1))
    error = np.sqrt(np.maximum(0, 1 - f[b] ** 2)) / f[b] * spread
    left, right = [], []
    for lo in range(0, len(a), _STRIP):
        some = a[lo : lo + _STRIP]
        estimate = (about[some] @ sign[b].T) / (f[b] * math.sqrt(dim))
        i, j = np.nonzero(estimate + error + np.outer(c["off"][some], spread / f[b]) >= threshold - 1e-6)
        i, j = some[i], b[j]
        if t1 == t2:
            i, j = i[i < j], j[i < j]
        if tab and len(i):
            first = np.ones(len(i), dtype=bool)
            for k in range(0, len(i), 65536):
                part = slice(k, k + 65536)
                first[part] = ~(met[i[part]] == met[j[part]]).any(axis=1)
            i, j = i[first], j[first]
        left.append(i)
        right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=int),) * 2


_TILE = ["dim", "tab", "bucket", "t1", "t2"]


def _survivors(threshold: float, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (dim, tab, _, t1, t2), tile in pdf.groupby(_TILE, sort=False):
            if len(tile) > 1:
                tile = tile.sort_values("node")  # estimates are of the later against the earlier one
                i, j = _reaching(int(dim), int(tab), tile["code"], tile["earlier"], tile["at"].to_numpy(), t1, t2, threshold, _key_type(bits))
                if len(i):
                    out.append(tile.iloc[np.union1d(i, j)])
        return pd.concat(out) if out else pdf.iloc[:0]

    return run


def _exact(threshold: float, bits: int, real: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for (dim, tab, _, t1, t2), tile in pdf.groupby(_TILE, sort=False):
            tile = tile.sort_values("node")
            i, j = _reaching(int(dim), int(tab), tile["code"], tile["earlier"], tile["at"].to_numpy(), t1, t2, threshold, _key_type(bits))
            (x, length), copies, node = _scaled(matrix(tile["v"], real).astype(np.float64)), tile["copies"].to_numpy(), tile["node"].to_numpy()
            links, parent = np.zeros(len(x), dtype=np.int64), np.arange(len(x))

            def root(u):
                while parent[u] != u:
                    parent[u] = parent[parent[u]]
                    u = parent[u]
                return u

            for lo in range(0, len(i), 65536):
                p, q = i[lo : lo + 65536], j[lo : lo + 65536]
                near = np.einsum("ij,ij->i", x[p], x[q]) / (length[p] * length[q]) >= threshold
                p, q = p[near], q[near]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                for u, v in zip(p.tolist(), q.tolist()):
                    ru, rv = root(u), root(v)
                    if ru != rv:
                        parent[rv] = ru
                        out.append((int(node[u]), int(node[v]), 0))
            out += [(int(node[u]), int(node[u]), int(links[u])) for u in np.flatnonzero(links)]
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    return run


def near_vector_components(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    scratch = Scratch(spark, "near-vectors")

    # Single-precision components are kept as such: the same numbers in half the bytes.
    real = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"

    def pack(batches):
        for batch in batches:
            v = [None if x is None else np.array(x, dtype=np.float64) + 0.0 for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([0 if x is None else len(x) for x in v], type=pa.int32()),
                                   pa.array([None if x is None else x.astype(real).tobytes() for x in v], type=pa.binary())], names=["vec_id", "dim", "v"])

    good = usable("e") & F.exists("e", lambda x: x != 0)
    rows = scratch.save(vectors.select(known(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
                        .withColumn("e", F.when(good, F.col("e"))).mapInArrow(pack, "vec_id long, dim int, v binary"), "rows")
    classes = scratch.save(rows.where("v IS NOT NULL").groupBy("dim", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "classes")
    # Rows that share an id may be the smallest of several vectors; nodes are then told apart by a number of their own.
    total = classes.count()
    bits, tables = table_shape(total, threshold, recall)
    nodes = classes.select(F.xxhash64("dim", "v").alias("node"), "v", "dim", "copies")
    coded = scratch.save(nodes.mapInArrow(_codes(bits, tables, real), "node long, dim int, code binary, keys binary"), "coded")
    spread = coded.mapInArrow(_spread(bits), _SPREAD)
    buckets = coded.mapInArrow(_spread(bits), _SPREAD).groupBy("dim", "tab", "bucket").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("nb"))
    # As a table it is broadcast while it is small; beyond that the join shuffles both sides.
    crowded = scratch.save(buckets.where("nb > 1"), "crowded")
    group = F.pmod(F.xxhash64(*_TILE), F.lit(max(16, total * tables // 8192)))
    # A bucket of several blocks has a tile for each two of them; others are one tile.
    tiles = (spread.join(crowded, ["dim", "tab", "bucket"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
             .withColumn("at", F.pmod(F.xxhash64("node", "tab"), F.col("nb")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
             .withColumn("t1", F.least("at", "other")).withColumn("t2", F.greatest("at", "other")).drop("nb", "other").withColumn("g", group))
    kept = tiles.groupBy("g").applyInPandas(_survivors(threshold, bits), tiles.schema)
    kept = scratch.save(kept, "survivors")
    # Each tile asks for the vectors of its survivors only; both sides are shuffled, by node.
    fetched = kept.join(nodes.select("node", "v", "copies").hint("merge"), "node")
    found = scratch.save(fetched.groupBy("g").applyInPandas(_exact(threshold, bits, real), "a long, b long, links long"), "found")
    component = connected_components(found.where("a <> b").select("a", "b"), scratch)
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select("dim", "v", F.col("node").alias("low"), "copies", F.xxhash64("dim", "v").alias("node"))
    of = named.join(component, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(lows, "component").select("dim", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    # As a table, so that both sides of the last join are shuffled and a large class of copies can be split.
    of = scratch.save(of, "of")
    out = rows.join(of, ["dim", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select(shown("vec_id"), "n_links", F.nullif(F.col("component_id"), F.lit(NULL_ID)).alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
