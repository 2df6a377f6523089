"""Operator 9 - exact n-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact intersection.

Two texts link when the Jaccard similarity of their sets of distinct k-word shingles (A-Z folded)
is at least ``percent`` / 100.  The result has one row per input row with its set size and the
smallest document id of its component of links.

Plan, all steps linear in the text but the last, which is confined to near-duplicate families:

1. One scan makes every shingle set.  A set that reaches the threshold with any other shares at
   least ``ceil(t n)`` of its n shingles with other documents, so shingle hashes are counted over the
   whole corpus (packed rows, 4 bytes a shingle) and only sets with that many repeated ones stay.
   Nothing is sampled: a truncated hash can only let too many sets through, never too few.
2. Equal sets collapse to one node, which stands for them in all later steps; its text is that of the
   smallest (document id, text hash), found by both, so that an id with many texts multiplies nothing.
3. Representatives are counted again by full hashes; each then offers its rarest
   ``n - ceil(t n) + 1`` shingles (by document frequency, then hash).  Two sets over the threshold
   must share one of those, so components of "shares such a shingle" contain all links.  Frequent
   passages are late in that order and offer nothing.
4. Inside a component, sets meet in tiles.  Rows of a tile are ordered by set size, so a row is
   compared with one contiguous band of sizes; hashed bitmaps bound the overlap from above by bit
   counts, and sorted arrays are intersected only where the bound reaches the threshold and the two
   are not linked yet.  Large components are tiled along a ring first; those that this does not join
   completely get all remaining tiles between their parts, except within the largest part.
5. Only then do ids come back: the sets of one id are united, and a component is named by its
   smallest document id.

Defined cases: null, empty and blank texts have an empty set and link with nothing; a text of fewer
than k words has its whole sequence as its one shingle; rows that repeat a doc_id are one document
for linking and get a row each (a null doc_id is one such id, smaller than all); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import packed, textscan
from .cases import NULL_ID, known, shown
from .components import connected_components
from .scratch import Scratch

#: Rows of one side of a tile.
TILE_ROWS = 512

_SIGS = "doc_id long, n int, s1 long, s2 long, th long, shared int"
_SETS = "node long, n int, shingles binary"


def _need(n: np.ndarray | int, percent: int):
    """How many common shingles a set of n needs at least with any partner: ceil(t n)."""
    return -(-n * percent // 100)


def _set_ids(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit ids of each set (0 for empty ones): sums of independently mixed members."""
    edges = np.r_[0, np.cumsum(counts)]
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        total = np.r_[np.uint64(0), np.cumsum(textscan.mix(s ^ np.uint64(salt)))]
        out.append((total[edges[1:]] - total[edges[:-1]]).astype(np.int64))
    return out[0], out[1]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _record(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ROW_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("slots", pa.binary()),
                         ("runs", pa.binary()), ("items", pa.binary()), ("more", pa.binary())])


def _scan_shingles(k: int, n_buckets: int):
    """Texts to packed shingles (upper 32 bits, bucket by the whole hash) and one row of set ids a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20
        slots, sets, sigs, size, texts = [], [], [], 0, 0

        def flush():
            nonlocal chunk, slots, sets, sigs, size, texts
            items = np.concatenate(sets)
            rows = packed.split_rows(chunk, np.concatenate(slots), items, n_buckets,
                                     lambda at: ((items[at] >> np.uint64(32)).astype("<u4").tobytes(), None))
            # The chunk's own row passes through the counting step; its bucket is negative.
            rows.append({"bucket": -1 - chunk % n_buckets, "chunk": chunk, "more": np.concatenate(sigs).tobytes()})
            chunk, slots, sets, sigs, size, texts = chunk + 1, [], [], [], 0, 0
            return _record(rows, _ROW_SCHEMA)

        for batch in batches:
            ids, hashes = _ids(batch.column(0)), _ids(batch.column(2))
            for lo, hi, words in textscan.chunks(batch.column(1)):
                if texts and (texts + hi - lo > packed.CHUNK_TEXTS or size + len(words.data) > packed.CHUNK_BYTES):
                    yield flush()
                s, counts = textscan.shingle_sets(words, k)
                s1, s2 = _set_ids(s, counts)
                slots.append(np.repeat(np.arange(texts, texts + hi - lo), counts))
                sets.append(s)
                sigs.append(np.stack([ids[lo:hi], counts, s1, s2, hashes[lo:hi]]).astype("<i8").T.ravel())
                size, texts = size + len(words.data), texts + hi - lo
        if texts:
            yield flush()

    return run


def _count_shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket: how many of each text's shingles occur in other texts too."""
    out = []
    own = pdf["bucket"].to_numpy() < 0
    for chunk, more in zip(pdf["chunk"][own], pdf["more"][own]):
        out.append((chunk, None, None, more))
    rows = pdf[~own]
    if len(rows):
        arrays = [np.frombuffer(x, dtype="<u4") for x in rows["items"]]
        again = packed.repeated(np.concatenate(arrays))
        at = 0
        for chunk, slots, runs, items in zip(rows["chunk"], rows["slots"], rows["runs"], arrays):
            slot, run = packed.unpack(slots, runs)
            total = np.add.reduceat(again[at : at + len(items)].astype(np.int64), np.r_[0, np.cumsum(run)[:-1]])
            at += len(items)
            keep = total > 0
            if keep.any():
                out.append((chunk, slot[keep].tobytes(), total[keep].astype("<u4").tobytes(), None))
    return pd.DataFrame(out, columns=["chunk", "slots", "runs", "more"])


def _sum_shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk: the rows of its texts with the counts of all buckets added up."""
    sig = np.frombuffer(pdf["more"].dropna().iloc[0], dtype="<i8").reshape(-1, 5)
    shared = np.zeros(len(sig), dtype=np.int64)
    for slots, runs in zip(pdf["slots"], pdf["runs"]):
        if slots is not None:
            slot, run = packed.unpack(slots, runs)
            shared[slot] += run
    return pd.DataFrame({"doc_id": sig[:, 0], "n": sig[:, 1].astype(np.int32), "s1": sig[:, 2],
                         "s2": sig[:, 3], "th": sig[:, 4], "shared": shared.astype(np.int32)})


def _sets_of(k: int):
    """Shingle sets of chosen texts, kept where they are the set that was asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, want = _ids(batch.column(0)), _ids(batch.column(2))
            for lo, hi, words in textscan.chunks(batch.column(1)):
                s, counts = textscan.shingle_sets(words, k)
                s1, _ = _set_ids(s, counts)
                edges = np.r_[0, np.cumsum(counts)]
                keep = np.flatnonzero(s1 == want[lo:hi])
                yield pa.record_batch([pa.array(ids[lo:hi][keep]), pa.array(counts[keep], type=pa.int32()),
                                       pa.array([s[edges[i] : edges[i + 1]].astype("<u8").tobytes() for i in keep],
                                                type=pa.binary())], names=["node", "n", "shingles"])

    return run


def _scan_sets(n_buckets: int):
    """Packed full hashes of shingle sets, and one row of nodes and sizes a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20
        held, size = [], 0

        def flush():
            nonlocal chunk, held, size
            items = np.concatenate([x[2] for x in held])
            slots = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
            rows = packed.split_rows(chunk, slots, items, n_buckets, lambda at: (items[at].astype("<u8").tobytes(), None))
            rows.append({"bucket": -1 - chunk % n_buckets, "chunk": chunk,
                         "more": np.array([x[:2] for x in held], dtype="<i8").tobytes()})
            chunk, held, size = chunk + 1, [], 0
            return _record(rows, _ROW_SCHEMA)

        for batch in batches:
            for node, n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held and (len(held) >= packed.CHUNK_TEXTS or size + len(s) > packed.CHUNK_BYTES):
                    yield flush()
                held.append((node, n, np.frombuffer(s, dtype="<u8")))
                size += len(s)
        if held:
            yield flush()

    return run


def _count_frequency(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket: the shingles of each set that others have too, with their document frequency."""
    out = []
    own = pdf["bucket"].to_numpy() < 0
    for chunk, more in zip(pdf["chunk"][own], pdf["more"][own]):
        out.append((chunk, None, None, None, more))
    rows = pdf[~own]
    if len(rows):
        arrays = [np.frombuffer(x, dtype="<u8") for x in rows["items"]]
        _, inverse, freq = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
        freq = freq[inverse]
        at = 0
        for chunk, slots, runs, items in zip(rows["chunk"], rows["slots"], rows["runs"], arrays):
            slot, run = packed.unpack(slots, runs)
            f = freq[at : at + len(items)]
            at += len(items)
            keep = f > 1
            if keep.any():
                out.append((chunk, np.repeat(slot, run)[keep].astype("<u2").tobytes(), f[keep].astype("<u4").tobytes(),
                            items[keep].tobytes(), None))
    return pd.DataFrame(out, columns=["chunk", "slots", "freq", "items", "more"])


def _choose_keys(percent: int):
    """Per chunk: the shared ones among the rarest ``n - ceil(t n) + 1`` shingles of each set."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(pdf["more"].dropna().iloc[0], dtype="<i8").reshape(-1, 2)
        rows = pdf[pdf["items"].notna()]
        if not len(rows):
            return pd.DataFrame({"key": [], "node": []}).astype("int64")
        slot = np.concatenate([np.frombuffer(x, dtype="<u2") for x in rows["slots"]]).astype(np.int64)
        freq = np.concatenate([np.frombuffer(x, dtype="<u4") for x in rows["freq"]])
        item = np.concatenate([np.frombuffer(x, dtype="<u8") for x in rows["items"]])
        order = np.lexsort((item, freq, slot))
        slot, item = slot[order], item[order]
        shared = np.bincount(slot, minlength=len(own))
        n = own[:, 1]
        offer = n - _need(n, percent) + 1 - (n - shared)
        rank = np.arange(len(slot)) - np.r_[0, np.cumsum(shared)][slot]
        keep = rank < offer[slot]
        return pd.DataFrame({"key": item[keep].astype(np.int64), "node": own[slot[keep], 0]})

    return run


def _link_tile(nodes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], group: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a tile's sets; ``group`` says which are joined already."""
    order = np.lexsort((nodes, sizes))
    nodes, sizes, group = nodes[order], sizes[order].astype(np.int64), group[order]
    sets = [sets[i] for i in order]
    _, label = np.unique(group, return_inverse=True)
    if label.max() == 0:
        return []
    n_bits = int(np.clip(1 << int(2 * sizes[-1] - 1).bit_length(), 256, 1 << 14))
    bitmap = np.zeros((len(sets), n_bits // 8), dtype=np.uint8)
    for i, s in enumerate(sets):
        flat = np.zeros(n_bits, dtype=bool)
        flat[(s & np.uint64(n_bits - 1)).astype(np.int64)] = True
        bitmap[i] = np.packbits(flat)
    bitmap = bitmap.view(np.uint64)
    last = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    found = []
    for i in range(len(sets) - 1):
        band = np.arange(i + 1, last[i])
        band = band[label[band] != label[i]]
        if not len(band):
            continue
        both = sizes[i] + sizes[band]
        least = -(-percent * both // (100 + percent))
        outside = np.bitwise_count(bitmap[i] & ~bitmap[band]).sum(axis=1, dtype=np.int64)
        fits = sizes[i] - outside >= least
        band, least = band[fits], least[fits]
        if not len(band):
            continue
        outside = np.bitwise_count(bitmap[band] & ~bitmap[i]).sum(axis=1, dtype=np.int64)
        fits = sizes[band] - outside >= least
        for j, enough in zip(band[fits], least[fits]):
            if label[j] == label[i]:
                continue
            # Both arrays are sorted and free of repeats.
            merged = np.concatenate((sets[i], sets[j]))
            merged.sort(kind="stable")
            if np.count_nonzero(merged[1:] == merged[:-1]) >= enough:
                found.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return found


def _link_tiles(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, tile in pdf.groupby(["cc", "t1", "t2"], sort=False):
            tile = tile.drop_duplicates("node")
            if len(tile) > 1:
                found += _link_tile(tile["node"].to_numpy(), tile["n"].to_numpy(),
                                    [np.frombuffer(x, dtype="<u8") for x in tile["shingles"]],
                                    tile["part"].to_numpy(), percent)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _tile_links(tiles: DataFrame, percent: int, n_groups: int) -> DataFrame:
    """Links of all tiles; tiles of components of one block share a task's group, others have one each."""
    tile = F.xxhash64("cc", "t1", "t2")
    return (tiles.withColumn("g", F.when(F.col("alone"), tile).otherwise(F.pmod(tile, F.lit(n_groups)))).drop("alone")
            .groupBy("g").applyInPandas(_link_tiles(percent), "a long, b long"))


def _ring_tiles(members: DataFrame) -> DataFrame:
    """Each set goes to the tile of its block and, in a component of several blocks, to the one before."""
    blocks = F.ceil(F.col("members") / TILE_ROWS).cast("int")
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (members.withColumn("blocks", blocks).withColumn("at", at)
            .withColumn("t1", F.explode(F.array_distinct(F.array("at", F.expr("pmod(at - 1, blocks)")))))
            .select("cc", "t1", F.lit(-1).alias("t2"), "node", "n", "shingles", F.col("node").alias("part"), (F.col("blocks") > 1).alias("alone")))


def _rest_tiles(open_: DataFrame, parts: DataFrame) -> DataFrame:
    """All tiles between the parts of components that the ring left in several, but within the largest.

    ``open_``: (cc, node, n, shingles, part, side), side 1 for the largest part of its component.
    """
    blocks = parts.select("cc", F.ceil(F.col("small") / TILE_ROWS).cast("int").alias("b0"),
                          F.ceil(F.col("large") / TILE_ROWS).cast("int").alias("b1"))
    rows = open_.join(blocks, "cc").withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 1, F.col("b1")).otherwise(F.col("b0"))).cast("int"))
    # Blocks are numbered 0..b0-1 for the small parts, then b0..b0+b1-1 for the largest.
    own = rows.withColumn("at", F.col("at") + F.when(F.col("side") == 1, F.col("b0")).otherwise(0))
    other = F.expr("CASE WHEN side = 1 THEN sequence(0, b0 - 1) ELSE sequence(0, b0 + b1 - 1) END")
    return (own.withColumn("with", F.explode(other))
            .select("cc", F.least("at", "with").alias("t1"), F.greatest("at", "with").alias("t2"), "node", "n", "shingles", "part", F.lit(True).alias("alone")))


def _linked_sets(spark: SparkSession, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sigs, classes, links, joined) of ``docs`` (doc_id, text).

    ``sigs``: a row per row with its set; ``classes``: (node, rep) per distinct non-empty set, ``rep`` the
    smallest (doc_id, th) that has it; ``links``: (a, b) that span the links of nodes; ``joined``: their
    components.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    n_buckets = packed.bucket_count(docs)

    counted = (docs.mapInArrow(_scan_shingles(k, n_buckets), packed.ROW)
               .groupBy("bucket").applyInPandas(_count_shared, "chunk long, slots binary, runs binary, more binary")
               .groupBy("chunk").applyInPandas(_sum_shared, _SIGS))
    sigs = scratch.save(counted, "sigs")

    classes = (sigs.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.max("shared").alias("shared"))
               .withColumn("node", _node()))
    wanted = classes.where(F.col("shared") >= F.ceil(F.col("n") * percent / 100.0)).select("rep.doc_id", "rep.th", "node", "s1")
    # A row that is repeated, id and text, is one set.
    texts = docs.join(wanted, ["doc_id", "th"]).select("node", "text", "s1").dropDuplicates(["node"])
    sets = scratch.save(texts.mapInArrow(_sets_of(k), _SETS), "sets")

    keys = scratch.save(sets.mapInArrow(_scan_sets(n_buckets), packed.ROW)
                        .groupBy("bucket").applyInPandas(_count_frequency, "chunk long, slots binary, freq binary, items binary, more binary")
                        .groupBy("chunk").applyInPandas(_choose_keys(percent), "key long, node long"), "keys")
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    # As a table, so that the join shuffles both sides and a shingle of many sets can be split.
    hubs = scratch.save(hubs, "hubs")
    meets = keys.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    families = connected_components(meets, scratch, "meet").select("node", F.col("component").alias("cc"))
    scratch.drop("keys")

    # Sizes meet narrow rows, not sets: as a table they are broadcast while that is small, and beyond it
    # a large family can be split.  Sets are only ever dealt by node and by tile.
    sizes = scratch.save(families.groupBy("cc").agg(F.count("*").alias("members")), "sizes")
    members = scratch.save(sets.join(families.join(sizes, "cc"), "node"), "members")
    scratch.drop("sets")
    n_groups = max(16, members.count() // 256)
    links = scratch.save(_tile_links(_ring_tiles(members), percent, n_groups), "ring")
    joined = connected_components(links, scratch, "joined")

    parts = families.join(joined, "node", "left").select("cc", "node", F.coalesce("component", "node").alias("part"))
    by_part = parts.groupBy("cc", "part").agg(F.count("*").alias("m"))
    largest = by_part.groupBy("cc").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("all"), F.count("*").alias("k"))
    several = scratch.save(largest.where(f"k > 1 AND all > {TILE_ROWS}").select("cc", F.col("top.part").alias("main"), F.col("top.m").alias("large"),
                                                             (F.col("all") - F.col("top.m")).alias("small")), "several")
    if not several.isEmpty():
        open_ = (members.join(parts.select("node", "part"), "node").join(several.select("cc", "main"), "cc")
                 .withColumn("side", (F.col("part") == F.col("main")).cast("int")).drop("main"))
        more = _tile_links(_rest_tiles(open_, several), percent, n_groups)
        links = scratch.save(links.unionByName(more), "links")
        joined = connected_components(links, scratch, "all")

    return sigs, classes.select("node", "rep"), links, joined


def _node():
    """The identity of a non-empty set; ids have no part in it."""
    return F.xxhash64("n", "s1", "s2")


def first_texts(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th): the smallest id and text hash (``xxhash64``) of each group of linked texts; null ids as ``NULL_ID``.

    Texts are grouped by what they say alone: texts of one id that do not link are in groups of their
    own.  Texts without words are in none.
    """
    scratch = Scratch(spark, "first-texts")
    _, classes, _, joined = _linked_sets(spark, docs.select(known(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, percent, scratch)
    return (classes.join(joined, "node", "left").groupBy(F.coalesce("component", "node").alias("group"))
            .agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.th"))


def ngram_jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80,
                             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``; see the module's docstring."""
    scratch = Scratch(spark, "ngram-join")
    sigs, classes, links, joined = _linked_sets(spark, docs.select(known(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, percent, scratch)

    rows = sigs.select("doc_id", "n", F.when(F.col("n") > 0, _node()).alias("node"))
    # Ids with several sets, or with a set and a text without words: their rows share a component.
    several = scratch.save(rows.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count_if(F.col("node").isNull()).alias("blanks"))
                           .where("lo < hi OR (lo IS NOT NULL AND blanks > 0)").select("doc_id", "lo"), "several-sets")
    if not several.isEmpty():
        rows = rows.join(several, "doc_id", "left").withColumn("node", F.coalesce("node", "lo"))
        own = rows.where("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct()
        joined = connected_components(links.unionByName(own), scratch, "by-id")

    roots = scratch.save(joined.join(classes, "node").groupBy("component").agg(F.min("rep.doc_id").alias("root")), "roots")
    named = (classes.select("node", F.col("rep.doc_id").alias("least")).join(joined, "node", "left").join(roots, "component", "left")
             .select("node", F.coalesce("root", "least").alias("component")))
    # As a table, so that both sides of the last join are shuffled and a large class of copies can be split.
    named = scratch.save(named, "named")
    return (rows.join(named, "node", "left")
            .select(shown("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                    F.nullif(F.coalesce("component", "doc_id"), F.lit(NULL_ID)).alias("component_id")))
