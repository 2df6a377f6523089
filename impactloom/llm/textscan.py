"""Vectorised scanning of whole texts: words, word hashes and k-word hashes with numpy.

A word is a maximal run of bytes other than ``0x20`` and ``0x09-0x0D``; as those are ASCII, working
on UTF-8 bytes gives the same words as working on code points.  Hashes are polynomials modulo
2**64 over random byte values, so the hash of any span comes from two prefix sums, followed by a
bit mixer.  Texts are processed whole, about a megabyte of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASES = (0x9E3779B97F4A7C17 | 2, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779FB)
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        tables = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        if size > 1 << 22:  # kept only up to a bounded size
            return tables[0], tables[1]
        have = _powers[base] = (tables[0], tables[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply) that spreads entropy over all 64 bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _power_tables(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


class Words:
    """The words of several consecutive texts.

    ``first[i]:first[i+1]`` are the words of text i; ``start``/``end`` are byte offsets in ``data``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = _NOT_SPACE[data]
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        after[:-1] = solid[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with ``fold``, A-Z count as a-z."""
        table = _FOLDED if fold else _BYTE
        return mix(_span_sums(table[self.data], self.start, self.end, _BASES[0]))

    def text_of(self) -> np.ndarray:
        """The index of its text for each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def span_hashes(word_hashes: np.ndarray, starts: np.ndarray, lengths, stream: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of words; ``stream`` 0 and 1 are independent."""
    salted = word_hashes if stream == 0 else mix(word_hashes + U64(0xD1B54A32D192ED03))
    return mix(_span_sums(salted, starts, starts + lengths, _BASES[1 + stream]))


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text and their counts.

    Words are case-folded (A-Z).  A text with 1 to k-1 words has its whole sequence as its one
    shingle; a text without words has none.
    """
    h = words.hashes(fold=True)
    per_text = np.where(words.counts >= k, words.counts - k + 1, np.minimum(words.counts, 1))
    owner = np.repeat(np.arange(len(per_text)), per_text)
    first_out = np.concatenate(([0], np.cumsum(per_text)))
    starts = words.first[owner] + (np.arange(len(owner)) - first_out[owner])
    s = span_hashes(h, starts, np.minimum(words.counts[owner], k))
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[fresh], np.bincount(owner[fresh], minlength=len(per_text))


def chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """Split a string column into runs of rows of about ``max_bytes``; nulls count as empty.

    Yields (first row, end row, words).  A longer text makes a chunk of its own.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, raw = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi
