"""Operators 11 to 13 against brute force, on plain and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from impactloom.llm import line_dedup, resampling, spelling
from impactloom.llm.scratch import Scratch

DOCS = "doc_id long, text string, source string, id string, th string, row string, n string, batch string, pos string, `_at` string, word string, rank string"
LOW = -(1 << 63)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", *["x"] * 9) for i, t in rows], DOCS)


def fold(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def ident(i):
    return "" if i is None else str(i)


def lined_rows():
    r = random.Random(3)
    common = ["A line of more than forty code points that many documents hold", "ÀÉÎ une ligne assez longue pour être retenue par tous les textes", "exactly thirty-nine code points of text", "x" * 40, "y" * 40]
    rows = [(None, None), (None, common[0] + "\n" + common[3]), (1, ""), (2, "\n\n"), (3, common[0]), (3, common[0] + "\nsecond text of the id"), (3, common[0]), (4, "  " + common[0].upper() + "\r\n" + common[1] + "\n" + common[2]),
            (5, "\n".join(common)), (6, "\n".join(common * 3)), (7, common[1].upper() + "\n" + common[1]), (8, "\t" + common[3] + "\x0b\x0c \n" + common[2]), (90, "\n".join(f"{common[0]}\nline {k} of a long text, and as long as it has to be" for k in range(3000)))]
    for k in range(10, 60):
        rows.append((k, "\n".join(r.choice([*common, "short", "", f"a line of its own for document number {k} and no other"]) for _ in range(r.randrange(8)))))
    return rows + [(61, "\n".join([common[4], "tail"]))] * 7


def expected_lines(rows, min_docs=5):
    key = lambda x: fold(x.strip(" \t\n\x0b\x0c\r"))
    found = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                found[key(x)].add(LOW if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(found[key(x)]) >= min_docs and max(found[key(x)]) != (LOW if i is None else i))]
        out.append((LOW if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches,min_docs", [(8, 5), (1, 5), (3, 2)])
def test_common_lines_equal_brute_force(spark, batches, min_docs):
    rows = lined_rows()
    got = line_dedup.strip_common_lines(spark, documents(spark, rows), min_docs=min_docs, batches=batches)
    assert got.columns[:12] == documents(spark, rows).columns
    assert sorted((LOW if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == expected_lines(rows, min_docs)


def test_line_digest_and_empty_tables(spark):
    rows = lined_rows()[:9]
    got = line_dedup.lines_digest(spark, documents(spark, rows)).collect()
    assert sorted((LOW if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in expected_lines(rows)]
    assert line_dedup.lines_digest(spark, documents(spark, [])).count() == 0


def keyed(spark, batch):
    """Rows (h, g, n, last) of made-up documents: {key: documents}."""
    return spark.createDataFrame([(k, -k, len(d), max(d)) for k, d in batch.items()], "h long, g long, n long, last long")


def test_runs_are_levelled_settled_keys_are_left_out_and_broken_steps_lose_nothing(spark, monkeypatch):
    r = random.Random(5)
    batches = [{k: {b * 100 + x for x in range(r.randrange(1, 4))} for k in r.sample(range(40), 12)} for b in reversed(range(11))]
    store = line_dedup.LineRuns(spark, f"{Scratch(spark, 'runs').root}", 4, min_docs=5, fan_out=3)
    total: dict[int, set] = defaultdict(set)
    steps = ("_write", "_clear")
    for number, batch in enumerate(batches):
        for k, d in batch.items():
            total[k] |= d
        for step in steps:  # each step breaks off once, before and after its work
            for late in (False, True):
                real = getattr(line_dedup.LineRuns, step)

                def broken(self, *args, real=real, late=late):
                    if late:
                        real(self, *args)
                    raise OSError("lost")

                monkeypatch.setattr(line_dedup.LineRuns, step, broken)
                with pytest.raises(OSError):
                    store.add(number, keyed(spark, batch))
                monkeypatch.setattr(line_dedup.LineRuns, step, real)
        store.add(number, keyed(spark, batch))
        store.add(number, keyed(spark, batch))  # a replayed batch
        assert sum(hi - lo + 1 for lo, hi in store.live()) == number + 1 and len(store.live()) <= 6
        assert {(x.h, x.g, x.last) for x in store.common().collect()} == {(k, -k, max(d)) for k, d in total.items() if len(d) >= 5}
    hot = line_dedup.LineRuns(spark, Scratch(spark, "runs").root, 4, min_docs=1)
    hot.add(0, keyed(spark, {1: {5}, 2: {6}}))
    hot.add(1, keyed(spark, {1: {4}, 3: {4}}))
    assert [x.h for x in hot._read((1, 1)).collect()] == [3]


def test_batch_and_runs_meet_without_a_shuffle_of_the_runs(spark):
    store = line_dedup.LineRuns(spark, Scratch(spark, "runs").root, 16, min_docs=1)
    store.add(0, keyed(spark, {k: {9} for k in range(50)}))
    known = store.settled((0, 0))
    batch = keyed(spark, {k: {1} for k in range(70)}).repartition(16, "h", "g")
    plan = batch.join(known.hint("merge"), (batch["h"] == known["h"]) & (batch["g"] == known["g"]) & (batch["last"] <= known["settled"]), "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan


def test_stream_of_batches_drops_what_earlier_ones_have(spark):
    store = line_dedup.LineRuns(spark, Scratch(spark, "runs").root, 4, min_docs=1)
    a, b = "the first line, which is long enough to be told apart", "the second line, which is also long enough for that"
    outs = []
    for number, texts in enumerate([[a], [a + "\n" + b, b], [b + "\nshort", "short"]]):
        docs = documents(spark, [(10 * number + k, t) for k, t in enumerate(texts)])
        outs += [r.kept_text for r in line_dedup.strip_seen_lines(spark, docs, store, number).orderBy("doc_id").collect()]
    assert outs == [a, b, b, "short", "short"]


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORDS.findall(fold(text or ""))
    return len(w), [" ".join(w[p : p + k]) for k in (1, 2, 3) for p in range(len(w) - k + 1)]


def expected_draw(rows, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for _, x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, fs = features(text)
        weight = sum(math.floor(1000 * math.log(((t[b] + 1) * (S + 10000)) / ((s[b] + 1) * (T + 10000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{ident(i)}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], LOW if x[0] is None else x[0], x[2], x[3]))
    drawn = len(enough) * percent // 100
    ranks = [(x[0], x[2], x[3], x[4], k + 1 if k < drawn else None) for k, x in enumerate(enough)]
    return ranks + [(x[0], x[2], x[3], x[4], None) for x in out if x[1] < 20]


def drawn_rows():
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["É", "straße", "日本", "don't", "A", "B-c"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    same = text(25)
    rows = [(None, None), (None, text(30)), (1, ""), (2, " .,;\n"), (3, "..one two.."), (4, "ONE\x00two"), (5, text(5000)), (6, same), (6, same), (6, same), (7, text(19)), (8, text(20)), (8, text(30))]
    return rows + [(k, text(r.randrange(60))) for k in range(9, 90)], [(1, text(40)), (2, None), (3, "w1 w2 w3 straße"), (3, "w1 w2 w3 straße")]


@pytest.mark.parametrize("percent", [5, 100])
def test_draw_equals_brute_force(spark, percent):
    rows, target = drawn_rows()
    wanted = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.draw(spark, documents(spark, rows), wanted, percent=percent).select(resampling.shown("id").alias("doc_id"), "n_features", "weight", "score", "rank").collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(expected_draw(rows, target, percent), key=key)


def test_resample_returns_the_drawn_rows_and_empty_tables_stay_empty(spark):
    rows, target = drawn_rows()
    wanted = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resample(spark, documents(spark, rows), wanted, percent=40)
    ids = Counter(x[0] for x in expected_draw(rows, target, 40) if x[4])
    assert got.columns == documents(spark, rows).columns and Counter(r.doc_id for r in got.collect()) == ids
    none = documents(spark, [])
    assert resampling.resampling_digest(spark, none, wanted).count() == 0
    assert {r.weight for r in resampling.resampling_digest(spark, documents(spark, rows[:5]), spark.createDataFrame([], "item_id long, text string")).collect()} != {None}


def test_position_table_shuffles_texts_once(spark):
    rows, _ = drawn_rows()
    plan = resampling.position_table(documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" in plan


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected_forms(rows, noise=199, min_letters=6, min_count=5):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = fold(run)
            h = zlib.crc32(f"{ident(i)}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_letters and c >= min_count}
    links = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in links.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def spelled_rows():
    r = random.Random(13)
    base = ["letters", "spelling", "çedilla", "grouping", "banana", "aaaaaa"]

    def edit(w):
        k, c = r.randrange(len(w) + 1), r.choice("abeéÿ")
        return r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])

    words = set(base)
    for w in base:
        for _ in range(25):
            x = edit(w)
            words |= {x, edit(x)}
    words = sorted(words)
    times = {w: r.choice([1, 4, 5, 6, 9, 30, 200]) for w in words} | {"letters": 4000, "letterss": 700, "lettersss": 100, "lettersssé": 18, "lettersssée": 5}
    stream = [w if r.random() < 0.7 else w.upper().replace("ß", "ss") for w in times for _ in range(times[w])]
    r.shuffle(stream)
    rows = [(None if k % 17 == 0 else k // 2, r.choice([" ", ", ", "1", "×\n", "_"]).join(stream[k * 40 : k * 40 + 40])) for k in range(len(stream) // 40 + 1)]
    return rows + [(1, None), (2, ""), (3, " 12 _"), (4, "letters " * 20_000), (5, "short a bc")] + [rows[3]] * 5


@pytest.mark.parametrize("noise,min_count", [(199, 5), (3, 2), (None, 1)])
def test_forms_equal_brute_force(spark, noise, min_count):
    rows = spelled_rows()
    got = spelling.spelling_forms(spark, documents(spark, rows), noise, 6, min_count).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=lambda x: x[0]) == expected_forms(rows, noise, 6, min_count)


def test_forms_chain_to_the_last_and_empty_tables_stay_empty(spark):
    rows = spelled_rows()
    roots = {r.word: (r.form, r.root) for r in spelling.spelling_forms(spark, documents(spark, rows)).collect()}
    assert roots["lettersssé"] == ("lettersss", "letters") and roots["letters"] == (None, "letters")
    assert spelling.spelling_forms(spark, documents(spark, [])).count() == 0
    assert spelling.spelling_forms(spark, documents(spark, [(1, None), (2, "")])).count() == 0


def test_every_word_pair_meets_once(spark):
    rows = spelled_rows()
    words = spark.createDataFrame([(w, n) for w, _, _, n, _, _ in expected_forms(rows, None, 6, 1)], "word string, n long")
    pairs = [(r.a, r.b) for r in spelling.near_pairs(spelling.parity_masks(words)).collect()]
    names = [r.word for r in words.collect()]
    assert len(pairs) == len(set(pairs)) and {frozenset(p) for p in pairs} == {frozenset((a, b)) for k, a in enumerate(names) for b in names[k:] if near(a, b)}
    assert words.agg(F.max(F.length("word"))).first()[0] < 31
