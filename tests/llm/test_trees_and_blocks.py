"""Operator 1's statistics, trees and scores, and operator 2's taken words, against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from impactloom.llm import mixing, quality, textscan

TEXTS = ["", " \n\t", "One", "one ONE one. two|two! 3", "Ünïcode wörds, 100% 　wide　 of them?", "a b c d e a b c d e a b c d e.", "x" * 3000, "A.b\r\nC! d?\x0b\x0c e|", "word " * 400,
         " ".join(str(i % 7) for i in range(90)), "\x00 \x1c\x1d \x85 \xa0 end."]


def _statistics(text: str) -> list[float]:
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    low, size, n = [w.lower() for w in words], max(len(data), 1), max(len(words), 1)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    other = lambda b: not letter(b) and not 48 <= b <= 57 and b > 32
    grams = lambda k: len({tuple(low[i : i + k]) for i in range(len(low) - k + 1)}) / (len(low) - k + 1) if len(low) >= k else 1.0
    mean = lambda values: sum(values) / n
    width = mean(map(len, words))
    stops = mean(w[-1:] in (b".", b"!", b"?") for w in words)
    return [math.log1p(len(data)), math.log1p(len(words)), width, math.sqrt(max(0.0, mean(len(w) ** 2 for w in words) - width**2)),
            sum(65 <= b <= 90 for b in data) / size, sum(48 <= b <= 57 for b in data) / size, sum(map(other, data)) / size, sum(b >= 128 for b in data) / size,
            data.count(b"\n") / size, data.count(b"!") / size, data.count(b"|") / size, len(set(low)) / n, max(Counter(low).values(), default=0) / n,
            mean(a == b for a, b in zip(low, low[1:])), grams(2), grams(5), mean(other(w[-1]) for w in words), 1 / (stops + 0.01),
            mean(65 <= w[0] <= 90 for w in words), mean(not any(map(letter, w)) for w in words), float(bool(words) and words[-1][-1:] in (b".", b"!", b"?"))]


def test_statistics_equal_plain_python():
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("aB9.!?| \n\té,") for _ in range(r.randrange(200))) for _ in range(60)]
    got = np.concatenate([quality.features(words) for _, _, words in textscan.chunks(pa.array([*texts, None]))])
    assert got.shape == (len(texts) + 1, len(quality.FEATURES))
    np.testing.assert_allclose(got, [_statistics(t) for t in [*texts, ""]], rtol=1e-9, atol=1e-7)


def _grow(x, g, h, cuts, depth, min_leaf, l2, rate):
    """The best split of a node by trying every cut on its rows, then both sides: nested (feature, cut, left, right) or a value."""
    if depth:
        best, found = 1e-9, None
        for j, c in enumerate(cuts):
            for cut in c:
                left = [row[j] <= cut for row in x]
                if min(sum(left), len(left) - sum(left)) < min_leaf:
                    continue
                part = lambda v, side: sum(a for a, s in zip(v, left) if s == side)  # noqa: E731, B023
                gain = sum(part(g, s) ** 2 / (part(h, s) + l2) for s in (True, False)) - sum(g) ** 2 / (sum(h) + l2)
                if gain > best + 1e-12:
                    best, found = gain, (j, cut, left)
        if found:
            j, cut, left = found
            sides = [[k for k, s in enumerate(left) if s == side] for side in (True, False)]
            return (j, cut, *(_grow([x[k] for k in rows], [g[k] for k in rows], [h[k] for k in rows], cuts, depth - 1, min_leaf, l2, rate) for rows in sides))
    return rate * sum(g) / (sum(h) + l2)


def _walk(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


@pytest.mark.parametrize("seed", [0, 1])
def test_trees_equal_exhaustive_splits_and_recursive_traversal(seed):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=160), rng.integers(0, 4, 160).astype(float), np.zeros(160), rng.exponential(size=160)], axis=1)
    y = ((x[:, 0] + x[:, 1] - x[:, 3] + rng.normal(size=160) * 0.5) > 0.5).astype(float)
    shape = {"trees": 5, "depth": 3, "rate": 0.3, "bins": 8, "min_leaf": 9, "l2": 1.0}
    model = quality.train(x, y, **shape)
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1]).tolist())) for j in range(4)]
    rows, raw = x.tolist(), [math.log(y.mean() / (1 - y.mean()))] * len(y)
    forest = []
    for _ in range(shape["trees"]):
        p = [1 / (1 + math.exp(-v)) for v in raw]
        forest.append(_grow(rows, [b - a for a, b in zip(p, y)], [a * (1 - a) for a in p], cuts, 3, 9, 1.0, 0.3))
        raw = [v + _walk(forest[-1], row) for v, row in zip(raw, rows)]
    np.testing.assert_allclose(model.score(x), [1 / (1 + math.exp(-v)) for v in raw], rtol=1e-9)
    fresh = rng.normal(size=(50, 4)).tolist()
    base = math.log(y.mean() / (1 - y.mean()))
    np.testing.assert_allclose(model.score(np.array(fresh)), [1 / (1 + math.exp(-base - sum(_walk(t, row) for t in forest))) for row in fresh], rtol=1e-9)


def _targets(sizes, weights):
    """Shares by weight; what is above twice its size stops there, one source at a time, the rest being shared anew."""
    fixed = {}
    while True:
        rest, open_ = 1.5 * sum(sizes.values()) - sum(fixed.values()), [s for s in sizes if s not in fixed and sizes[s]]
        shares = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        above = {s: 2.0 * sizes[s] for s in open_ if shares[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return {**dict.fromkeys(sizes, 0.0), **shares, **fixed}
        fixed |= above


@pytest.mark.parametrize("block", [4, 512])
def test_taken_words_equal_a_count_of_every_word_of_every_block(spark, block):
    r = random.Random(block)
    rows = [(i, r.choice(["s0", "s0", "s0", "s1", "s2", None, "", "z"]), " ".join(["w"] * r.choice([0, 1, 3, 40, 900]))) for i in range(90)] + [(90, "only", "   "), (91, "s1", None)]
    docs = spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string")
    mix = mixing.Mix(spark, docs, block=block)
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    words = {s: [i for i, s2, t in rows if s2 == s for _ in (t or "").split()] for s in names}
    targets = _targets({s: len(w) for s, w in words.items()}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    drawn, draws = Counter(), mix.slots.collect()
    for d in draws:
        drawn.update(words[names[d["idx"]]][d["block"] * block : (d["block"] + 1) * block][: d["take"]])
    for k, s in enumerate(names):
        mine = [d for d in draws if d["idx"] == k]
        for p in {d["pass"] for d in mine}:
            blocks = [d["block"] for d in mine if d["pass"] == p]
            assert len(set(blocks)) == len(blocks) and all(0 <= b < -(-len(words[s]) // block) for b in blocks)
        assert sum(v for i, v in drawn.items() if rows[i][1] == s) == min(round(targets[s]), 2 * len(words[s]))
    got = {x.doc_id: x for x in mix.taken().collect()}
    assert len(got) == len(rows)
    for i, s, t in rows:
        n = len((t or "").split())
        assert (got[i].size, got[i].source_size, got[i].taken) == (n, len(words[s]), drawn[i]) and got[i].taken <= 2 * n and abs(got[i].target - targets[s]) < 1e-6
