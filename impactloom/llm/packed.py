"""Item counting over packed shuffle rows.

Tens of millions of 8-byte items cost far less to shuffle as a few thousand binary rows than one
row each.  A *chunk* is what one task has scanned since it last flushed; its items are split over
hash buckets, and each (chunk, bucket) row holds the items in text order with run lengths per text.
The number of buckets grows with the input, so what one bucket gathers of items that are spread
stays bounded.  Known limit: an item that is in M texts is M entries (4 to 16 bytes each) of one bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Bytes of text whose items share one bucket, and at most how much one chunk holds.
BUCKET_BYTES = 16 << 20
CHUNK_BYTES = 12 << 20
CHUNK_TEXTS = 60_000

ROW = "bucket int, chunk long, slots binary, runs binary, items binary, more binary"


def bucket_count(df: DataFrame, text: str = "text") -> int:
    """How many buckets ``df`` needs: a function of its total size alone."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(16, -(-int(total) // BUCKET_BYTES))


def split_rows(chunk: int, slots: np.ndarray, items: np.ndarray, n_buckets: int, encode) -> list[dict]:
    """Rows of one chunk: ``slots`` (ascending) says which text each item belongs to.

    ``encode(positions)`` makes the (items, more) payloads of the chosen positions.
    """
    bucket = (items % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    # Only buckets that have items: their number is bounded by that of the items.
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, dtype=np.int64)
    rows = []
    for lo, hi in zip(first, np.r_[first[1:], len(sorted_)]):
        at = order[lo:hi]
        owner = slots[at]
        cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        payload, more = encode(at)
        rows.append({"bucket": int(sorted_[lo]), "chunk": chunk, "slots": owner[cut].astype("<u2").tobytes(),
                     "runs": np.diff(np.r_[cut, len(at)]).astype("<u4").tobytes(),
                     "items": payload, "more": more})
    return rows


def unpack(row_slots: bytes, row_runs: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row_slots, dtype="<u2"), np.frombuffer(row_runs, dtype="<u4").astype(np.int64)


def repeated(items: np.ndarray) -> np.ndarray:
    """Which items occur more than once."""
    s = np.sort(items)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(items), dtype=bool)
    at = np.searchsorted(twice, items)
    at[at == len(twice)] = 0
    return twice[at] == items
