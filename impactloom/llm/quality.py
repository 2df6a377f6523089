"""Operator 1 - quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a fixed vector of statistics (lengths, character classes, repetition of words and
word groups, shape of words and sentences), computed with numpy over whole texts.  Trees are grown
level by level on binned statistics with logistic loss and flattened into arrays, so that scoring a
batch takes ``depth`` indexing steps a tree and no Python loop over rows.

The model learns from labelled rows only, at most ``max_rows`` of them (a documented bound: the rows
with the smallest hashes of their id), and never from the held-out fold: rows whose
crc32(doc_id as text) modulo 4 is 2.  Ids, labels, language and source are not inputs of a score.

Defined cases: null and empty texts have the statistics of no words (0, but 1 for shares of distinct word
groups and 100 for words a stop) and are scored like any other; labels that
are null or neither 0 nor 1 are not used; of rows that share an id and a label one text counts, the one
with the smallest hash; an id with both labels counts once for each; without labels every score is 0.5; repeated rows get a row each; a null doc_id is not held out; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship
from . import textscan

MAX_ROWS, TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 20_000, 60, 4, 0.2, 64, 20, 1.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

FEATURES = ("log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "other_ascii", "non_ascii", "lines",
            "exclamations", "bars", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "distinct_fives", "ends_in_mark",
            "words_a_stop", "capitalised", "without_letters", "ends_in_stop")


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the count of the most frequent one, per owner."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    who = (key[cut] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, who, np.diff(np.r_[cut, len(key)]))
    return np.bincount(who, minlength=n).astype(float), most


def features(words: textscan.Words) -> np.ndarray:
    """The statistics of several texts, one row each, in the order of ``FEATURES``."""
    data, off, n = words.data, words.offsets, len(words.counts)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return (total[off[1:]] - total[off[:-1]]) / size

    def mean(values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values, dtype=np.float64)]
        return (total[words.first[1:]] - total[words.first[:-1]]) / count

    size, count = np.maximum(np.diff(off), 1), np.maximum(words.counts, 1)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    other = ~letter & ~digit & (data > 32)
    owner, length = words.text_of(), words.end - words.start
    h = words.hashes(fold=True)
    distinct, most = _distinct(owner, h, n)
    grams = []
    for k in (2, 5):
        at = np.flatnonzero(words.first[1:][owner] - np.arange(len(owner)) >= k)
        d, _ = _distinct(owner[at], textscan.span_hashes(h, at, k), n)
        grams.append(np.where(words.counts >= k, d / np.maximum(words.counts - k + 1, 1), 1.0))
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    last = data[words.end - 1] if len(length) else np.zeros(0, np.uint8)
    stop = (last == 46) | (last == 33) | (last == 63)
    letters = np.r_[0, np.cumsum(letter)]
    stops = mean(stop)
    word_length = mean(length)
    final = np.zeros(n)
    some = words.counts > 0
    final[some] = stop[words.first[1:][some] - 1]
    return np.stack([
        np.log1p(np.diff(off)), np.log1p(words.counts), word_length, np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) - word_length**2)),
        share(upper), share(digit), share(other), share(data >= 128), share(data == 10), share(data == 33), share(data == 124),
        distinct / count, most / count, mean(same), *grams, mean(other[words.end - 1] if len(length) else last), 1 / (stops + 0.01),
        mean(upper[words.start] if len(length) else last), mean(letters[words.end] == letters[words.start]), final], axis=1)


class Trees:
    """Complete binary trees as arrays: split feature and threshold by node, value by leaf."""

    def __init__(self, base: float, depth: int) -> None:
        self.base, self.depth = base, depth
        self.feature: np.ndarray = np.zeros((0, 2**depth - 1), dtype=np.int32)
        self.threshold: np.ndarray = np.zeros((0, 2**depth - 1))
        self.value: np.ndarray = np.zeros((0, 2**depth))

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            raw += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-raw))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS,
          min_leaf: int = MIN_LEAF, l2: float = L2) -> Trees:
    """Gradient boosting on histograms of binned features; deterministic."""
    if not len(y):
        return Trees(0.0, depth)
    p = np.clip(y.mean(), 0.01, 0.99)
    model = Trees(float(np.log(p / (1 - p))), depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), model.base)
    all_feature, all_threshold, all_value = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, prob * (1 - prob)
        feature, threshold = np.zeros(2**depth - 1, dtype=np.int32), np.full(2**depth - 1, np.inf)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best, split = np.full(width, 1e-9), np.full((width, 2), -1)
            for j, c in enumerate(cuts):
                nb = len(c) + 1
                if nb < 2:
                    continue
                key = local * nb + binned[:, j]
                G, H, N = (np.bincount(key, weights=w, minlength=width * nb).reshape(width, nb).cumsum(axis=1) for w in (g, h, None))
                tg, th, tn = G[:, -1:], H[:, -1:], N[:, -1:]
                gain = G**2 / (H + l2) + (tg - G) ** 2 / (th - H + l2) - tg**2 / (th + l2)
                gain[(N < min_leaf) | (tn - N < min_leaf)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                split[better] = np.stack([np.full(better.sum(), j), k[better]], axis=1)
            for node, (j, k) in enumerate(split):
                if j >= 0:
                    feature[first + node], threshold[first + node] = j, cuts[j][k]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + l2)
        raw += value[leaf]
        all_feature.append(feature), all_threshold.append(threshold), all_value.append(value)
    model.feature, model.threshold, model.value = np.stack(all_feature), np.stack(all_threshold), np.stack(all_value)
    return model


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(words) for _, _, words in textscan.chunks(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(list(np.concatenate(rows)) if rows else [], type=pa.list_(pa.float64())), *batch.columns[2:]],
                              names=["quality", "x", "doc_id", "tie"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """The model of the labelled rows outside the held-out fold, at most ``max_rows`` of them."""
    ship(spark)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out("doc_id")).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    # Bounded by max_rows, so it can be broadcast and, with its statistics, collected.
    some = known.orderBy(F.xxhash64("doc_id"), "quality").limit(max_rows)
    rows = (docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("quality", "text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
            .mapInArrow(_statistics, "quality int, x array<double>, doc_id long, tie long")
            .groupBy("doc_id", "quality").agg(F.min_by("x", "tie").alias("x")).toPandas())
    # The order of arrival must not matter: sums of doubles depend on it.
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows["quality"].to_numpy()))
    return train(x[order], rows["quality"].to_numpy(dtype=np.float64)[order])


def score_documents(spark: SparkSession, docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.score(features(words)) for _, _, words in textscan.chunks(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(rows) if rows else [], type=pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score reaches the threshold; one scan, no join."""
    model = fit(spark, docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.score(features(words)) for _, _, words in textscan.chunks(batch.column(at))]
            if rows:
                yield batch.filter(pa.array(np.concatenate(rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)
