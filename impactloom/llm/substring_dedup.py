"""Operator 6 - exact substring deduplication by difference-cover anchors.

A window is ``WINDOW`` = 20 consecutive words of one text.  A word is removed when a window that
covers it also starts earlier: in a smaller document, or further up in the same one.

The residues {0, 1, 3, 9} modulo 13 are a difference cover: for any two positions i and j some shift
d < 13 puts both i + d and j + d on them.  So only runs of 8 words at such positions are hashed (4
of 13), and since 13 + 8 - 1 = 20 any repeated window holds an *anchor* that repeats with it at the
same offset.  The plan:

1. One scan hashes anchors and counts them over the whole corpus (packed rows, 4 bytes an anchor).
   A truncated hash may report too many repeats, never too few.
2. Texts with repeated anchors are read again; each window with such an anchor at one of its offsets
   0 to 12 is extended to its full 20 words and hashed to 96 bits.  Grouped by that, every window
   but the first by (document, position) is marked.  A window in thousands of texts costs one row
   part for each, never a pair.
3. Marked windows become word runs per document, which are cut out of the text.

Defined cases: null, empty and blank texts have no words, nothing removed and the hash of the empty
string; texts under 20 words lose nothing; rows with the same doc_id and text are one document and
get a row each, so they do not remove each other; rows with one doc_id but other texts count as one
document for "earlier" and are ordered by position; a null doc_id comes before all others; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import packed, textscan
from .cases import known, shown
from .ngram_join import _ROW_SCHEMA, _ids, _record
from .scratch import Scratch

WINDOW, ANCHOR, PERIOD, COVER = 20, 8, 13, (0, 1, 3, 9)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_BASE = "doc_id long, th long, n_words long, kept_sha256 string, flags binary"
_KEY = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                  ("kept_sha256", pa.string()), ("kept", pa.string())])


def _anchors(words: textscan.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in the text, hash) of the anchors of texts that have a window at all."""
    owner = words.text_of()
    at = np.arange(len(owner)) - words.first[:-1][owner]
    counts = words.counts[owner]
    keep = np.flatnonzero(_IN_COVER[at % PERIOD] & (at + ANCHOR <= counts) & (counts >= WINDOW))
    return owner[keep], at[keep], textscan.span_hashes(hashes, keep, ANCHOR)


def _scan_anchors(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20
        slots, items, keys, shas, size, texts = [], [], [], [], 0, 0

        def flush():
            nonlocal chunk, slots, items, keys, shas, size, texts
            h = np.concatenate(items)
            rows = packed.split_rows(chunk, np.concatenate(slots), h, n_buckets,
                                     lambda at: ((h[at] >> np.uint64(32)).astype("<u4").tobytes(), None))
            rows.append({"bucket": -1 - chunk % n_buckets, "chunk": chunk, "items": b"".join(shas),
                         "more": np.concatenate(keys).tobytes()})
            chunk, slots, items, keys, shas, size, texts = chunk + 1, [], [], [], [], 0, 0
            return _record(rows, _ROW_SCHEMA)

        for batch in batches:
            ids, th, column = _ids(batch.column(0)), _ids(batch.column(2)), batch.column(1)
            for lo, hi, words in textscan.chunks(column):
                if texts and (texts + hi - lo > packed.CHUNK_TEXTS or size + len(words.data) > packed.CHUNK_BYTES):
                    yield flush()
                owner, _, h = _anchors(words, words.hashes())
                slots.append(owner + texts)
                items.append(h)
                keys.append(np.stack([ids[lo:hi], th[lo:hi], words.counts]).astype("<i8").T.ravel())
                data = words.data.tobytes()
                shas += [hashlib.sha256(b" ".join(data[a:b].split())).digest()
                         for a, b in zip(words.offsets[:-1], words.offsets[1:])]
                size, texts = size + len(data), texts + hi - lo
        if texts:
            yield flush()

    return run


def _flag_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket: one bit for each anchor, set where its hash occurs again."""
    out = []
    own = pdf["bucket"].to_numpy() < 0
    for chunk, items, more in zip(pdf["chunk"][own], pdf["items"][own], pdf["more"][own]):
        out.append((chunk, -1, None, None, items, more))
    rows = pdf[~own]
    if len(rows):
        arrays = [np.frombuffer(x, dtype="<u4") for x in rows["items"]]
        again = packed.repeated(np.concatenate(arrays))
        at = 0
        for chunk, b, slots, runs, items in zip(rows["chunk"], rows["bucket"], rows["slots"], rows["runs"], arrays):
            out.append((chunk, b, slots, runs, np.packbits(again[at : at + len(items)]).tobytes(), None))
            at += len(items)
    return pd.DataFrame(out, columns=["chunk", "bucket", "slots", "runs", "items", "more"])


def _gather_flags(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk: a row for each text, with its anchors' bits in (bucket, position) order if any is set."""
    pdf = pdf.sort_values("bucket", kind="stable")
    own = pdf[pdf["bucket"] < 0].iloc[0]
    keys = np.frombuffer(own["more"], dtype="<i8").reshape(-1, 3)
    slot, flag = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint8)]
    for slots, runs, bits in zip(pdf["slots"], pdf["runs"], pdf["items"]):
        if slots is not None:
            s, r = packed.unpack(slots, runs)
            slot.append(np.repeat(s.astype(np.int64), r))
            flag.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(slot[-1])))
    slot, flag = np.concatenate(slot), np.concatenate(flag)
    order = np.argsort(slot, kind="stable")
    flag = flag[order]
    edges = np.searchsorted(slot[order], np.arange(len(keys) + 1))
    return pd.DataFrame({
        "doc_id": keys[:, 0], "th": keys[:, 1], "n_words": keys[:, 2],
        "kept_sha256": [own["items"][32 * i : 32 * i + 32].hex() for i in range(len(keys))],
        "flags": [np.packbits(flag[a:b]).tobytes() if flag[a:b].any() else None for a, b in zip(edges[:-1], edges[1:])]})


def _scan_windows(n_buckets: int):
    """Hashes of the windows around repeated anchors, with their positions and document ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20
        held, keys, size, texts, previous = [], [], 0, 0, None

        def flush():
            nonlocal chunk, held, keys, size, texts
            slot, at, h, h2 = (np.concatenate([x[i] for x in held]) for i in range(4))
            ids = np.array([x[0] for x in keys], dtype=np.int64)

            def encode(pick):
                owner = slot[pick]
                who = ids[owner[np.r_[True, owner[1:] != owner[:-1]]]]
                body = h[pick].astype("<u8").tobytes() + (h2[pick] >> np.uint64(32)).astype("<u4").tobytes() + at[pick].astype("<u4").tobytes()
                return body, who.astype("<i8").tobytes()

            rows = packed.split_rows(chunk, slot, h, n_buckets, encode)
            rows.append({"bucket": -1 - chunk % n_buckets, "chunk": chunk, "more": np.array(keys, dtype="<i8").tobytes()})
            chunk, held, keys, size, texts = chunk + 1, [], [], 0, 0
            return _record(rows, _ROW_SCHEMA)

        for batch in batches:
            ids, th, flags = _ids(batch.column(0)), _ids(batch.column(2)), batch.column(3)
            for lo, hi, words in textscan.chunks(batch.column(1)):
                if texts and (texts + hi - lo > packed.CHUNK_TEXTS or size + len(words.data) > packed.CHUNK_BYTES):
                    yield flush()
                hashes = words.hashes()
                owner, at, anchor = _anchors(words, hashes)
                edges = np.searchsorted(owner, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    key = (int(ids[lo + i]), int(th[lo + i]))
                    if key == previous:  # rows come sorted, so repeats of a row are neighbours
                        continue
                    previous = key
                    where = at[edges[i] : edges[i + 1]]
                    order = np.argsort((anchor[edges[i] : edges[i + 1]] % np.uint64(n_buckets)).astype(np.int64), kind="stable")
                    bits = np.unpackbits(np.frombuffer(flags[lo + i].as_py(), dtype=np.uint8), count=len(where))
                    hits = where[order][bits.astype(bool)]
                    n = int(words.counts[i])
                    # The windows that have such an anchor at one of the offsets 0 to PERIOD - 1.
                    step = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(step, np.maximum(hits - PERIOD + 1, 0), 1)
                    np.add.at(step, hits + 1, -1)
                    start = np.flatnonzero(np.cumsum(step[: n - WINDOW + 1]) > 0)
                    own = hashes[words.first[i] : words.first[i + 1]]
                    held.append((np.full(len(start), len(keys)), start, textscan.span_hashes(own, start, WINDOW),
                                 textscan.span_hashes(own, start, WINDOW, 1)))
                    keys.append(key)
                    texts += 1
                size += len(words.data)
        if texts:
            yield flush()

    return run


def _mark_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket: the positions of all windows but the first of each content."""
    out = []
    own = pdf["bucket"].to_numpy() < 0
    for chunk, more in zip(pdf["chunk"][own], pdf["more"][own]):
        out.append((chunk, None, None, more))
    rows = pdf[~own]
    if len(rows):
        h, h2, at, doc, slots = [], [], [], [], []
        for slot, runs, items, more in zip(rows["slots"], rows["runs"], rows["items"], rows["more"]):
            s, r = packed.unpack(slot, runs)
            n = len(items) // 16
            h.append(np.frombuffer(items, dtype="<u8", count=n))
            h2.append(np.frombuffer(items, dtype="<u4", count=n, offset=8 * n))
            at.append(np.frombuffer(items, dtype="<u4", count=n, offset=12 * n))
            doc.append(np.repeat(np.frombuffer(more, dtype="<i8"), r))
            slots.append(np.repeat(s, r))
        sizes = [len(x) for x in h]
        a, b, p, d = map(np.concatenate, (h, h2, at, doc))
        order = np.lexsort((p, d, b, a))
        a, b = a[order], b[order]
        later = np.zeros(len(a), dtype=bool)
        # Not the first of its content - unless it is the same place, which only another text of that id can be.
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(a)), 0))
        d, p = d[order], p[order]
        later[1:] = same & ~((d[1:] == d[head[1:]]) & (p[1:] == p[head[1:]]))
        marked = np.zeros(len(a), dtype=bool)
        marked[order] = later
        start = 0
        for chunk, n, slot, pos in zip(rows["chunk"], sizes, slots, at):
            keep = marked[start : start + n]
            start += n
            if keep.any():
                out.append((chunk, slot[keep].astype("<u2").tobytes(), pos[keep].astype("<u4").tobytes(), None))
    return pd.DataFrame(out, columns=["chunk", "slots", "places", "more"])


def _gather_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk: for each text with marked windows, the runs of words that they cover."""
    keys = np.frombuffer(pdf["more"].dropna().iloc[0], dtype="<i8").reshape(-1, 2)
    rows = pdf[pdf["slots"].notna()]
    if not len(rows):
        return pd.DataFrame({"doc_id": [], "th": [], "runs": []}).astype({"doc_id": "int64", "th": "int64", "runs": object})
    slot = np.concatenate([np.frombuffer(x, dtype="<u2") for x in rows["slots"]]).astype(np.int64)
    at = np.concatenate([np.frombuffer(x, dtype="<u4") for x in rows["places"]]).astype(np.int64)
    order = np.lexsort((at, slot))
    slot, at = slot[order], at[order]
    new = np.r_[True, (slot[1:] != slot[:-1]) | (at[1:] > at[:-1] + WINDOW)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    owner, lo, hi = slot[first], at[first], at[last] + WINDOW
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    ends = np.r_[edges[1:], len(owner)]
    return pd.DataFrame({"doc_id": keys[owner[edges], 0], "th": keys[owner[edges], 1],
                         "runs": [np.stack([lo[a:b], hi[a:b]]).astype("<u4").T.tobytes() for a, b in zip(edges, ends)]})


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, previous = [], None
            for doc, text, th, runs in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, th) == previous:
                    continue
                previous = (doc, th)
                words = text.encode().split()
                keep, at, removed = [], 0, 0
                for lo, hi in np.frombuffer(runs, dtype="<u4").reshape(-1, 2).tolist():
                    keep += words[at:lo]
                    removed += hi - lo
                    at = hi
                kept = b" ".join(keep + words[at:])
                rows.append({"doc_id": doc, "th": th, "n_words": len(words), "n_removed": removed,
                             "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode() if with_text else None})
            yield _record(rows, _KEY)

    return run


def remove_repeated_substrings(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                               with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row; ``with_text`` adds the kept text.

    ``kept`` is null where nothing was removed, so that unchanged texts are not copied.
    """
    docs = (docs.select(known(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .withColumn("th", F.xxhash64("text")))
    scratch = Scratch(spark, "substring-dedup")
    n_buckets = packed.bucket_count(docs)
    chunked = "chunk long, bucket int, slots binary, runs binary, items binary, more binary"
    base = scratch.save(docs.select("doc_id", "text", "th").mapInArrow(_scan_anchors(n_buckets), packed.ROW)
                        .groupBy("bucket").applyInPandas(_flag_anchors, chunked)
                        .groupBy("chunk").applyInPandas(_gather_flags, _BASE), "base")
    flagged = base.where("flags IS NOT NULL").select("doc_id", "th", "flags").dropDuplicates(["doc_id", "th"])
    found = (docs.join(flagged.hint("merge"), ["doc_id", "th"]).sortWithinPartitions("doc_id", "th").select("doc_id", "text", "th", "flags"))
    runs = scratch.save(found.mapInArrow(_scan_windows(n_buckets), packed.ROW)
                        .groupBy("bucket").applyInPandas(_mark_windows, "chunk long, slots binary, places binary, more binary")
                        .groupBy("chunk").applyInPandas(_gather_runs, "doc_id long, th long, runs binary"), "runs")
    cut = (docs.join(runs.hint("merge"), ["doc_id", "th"]).sortWithinPartitions("doc_id", "th").select("doc_id", "text", "th", "runs")
           .mapInArrow(_cut(with_text), "doc_id long, th long, n_words long, n_removed long, kept_sha256 string, kept string"))
    cut = scratch.save(cut, "cut").select("doc_id", "th", "n_removed", F.col("kept_sha256").alias("sha"), "kept")
    out = (base.drop("flags").join(cut.dropDuplicates(["doc_id", "th"]), ["doc_id", "th"], "left")
           .select(shown("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                   F.coalesce("sha", "kept_sha256").alias("kept_sha256"), "kept"))
    return out if with_text else out.drop("kept")
