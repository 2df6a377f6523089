"""The training-data operators against brute force, on plain and on awkward rows."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactloom.llm import cases, mixing, near_vectors, ngram_join, packing, pii, quality, queries, quotes, substring_dedup, textscan, topk, url_filter

from impactloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, size string, _id string, tie string, n string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x", "x") for i, t, s in rows], DOCS)


def awkward():
    """Nulls, blanks, ties, repeated rows, one id with two texts, a very long text, other white space."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["É", "ß\u00a0x", "日本", "don't"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, long_ = text(120), text(30_000)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "One", "b"), (6, "two words", "a"), (7, base, "a"), (8, base, "b"), (9, base.upper(), "b"),
            (10, base.replace(" ", "\n", 40) + " tail", "a"), (11, text(50) + " " + base[: len(base) // 2], None), (12, long_, "c"), (13, text(200) + " " + " ".join(long_.split()[500:900]), "c"),
            (14, "a b " * 60, "d"), (15, "a b " * 60 + "c", "d"), (16, "dup row text here", "e"), (16, "dup row text here", "e"), (17, "first of an id", "e"), (17, "second of an id", "e"), (None, "no id at all", "f"), (None, text(30), None)]
    for k in range(18, 40):
        t = base.split()
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((k, " ".join(t), "abc"[k % 3]))
    return rows


def fold(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall(fold(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def components(ids, links):
    parent = {i: i for i in ids}

    def root(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (3, 60)])
def test_ngram_join_equals_brute_force(spark, k, percent):
    rows = awkward()
    low = -(10**9)
    sets = [(low if i is None else i, shingles(t, k)) for i, t, _ in rows]
    links = [(a, b) for x, (a, A) in enumerate(sets) for b, B in sets[x + 1 :] if A and B and 100 * len(A & B) >= percent * len(A | B)]
    want = components({i for i, _ in sets}, links)
    got = ngram_join.ngram_jaccard_components(spark, documents(spark, rows), k, percent).collect()
    assert sorted((low if r.doc_id is None else r.doc_id, r.n_shingles, low if r.component_id is None else r.component_id) for r in got) == sorted((i, len(s), want[i]) for i, s in sets)


def test_ngram_join_tiles_large_families(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    r = random.Random(3)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(r.randrange(5)):
            t[r.randrange(60)] = f"x{r.randrange(8)}"
        rows.append((i, " ".join(t), "a"))
    sets = [(i, shingles(t, 3)) for i, t, _ in rows]
    links = [(a, b) for x, (a, A) in enumerate(sets) for b, B in sets[x + 1 :] if 100 * len(A & B) >= 80 * len(A | B)]
    want = components(range(60), links)
    assert {x.doc_id: x.component_id for x in ngram_join.ngram_jaccard_components(spark, documents(spark, rows), 3, 80).collect()} == want


def test_substring_dedup_equals_brute_force(spark):
    rows = sorted({(i, t) for i, t, _ in awkward() if i is not None and i != 17}, key=lambda x: x[0])
    seen, want = set(), {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - 19):
            g = tuple(w[p : p + 20])
            if g in seen:
                gone |= set(range(p, p + 20))
            seen.add(g)
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = substring_dedup.remove_repeated_substrings(spark, documents(spark, awkward()), with_text=True).collect()
    assert len(got) == len(awkward())
    for r in got:
        if r.doc_id in want:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3]
            assert r.kept is None or r.kept == want[r.doc_id][3]
    assert sum(r.n_removed for r in got) > 500


def test_difference_cover_aligns_any_two_positions():
    v, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert all(any((i + d) % v in cover and (j + d) % v in cover for d in range(v)) for i in range(v) for j in range(v))
    assert substring_dedup.ANCHOR + v - 1 == substring_dedup.WINDOW


def test_words_and_hashes():
    texts = ["", " a\x0bbb\n", "x", "é\u00a0é  Z\x1cz "]
    data = "".join(texts).encode()
    w = textscan.Words(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
    assert [data[a:b].decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in WORD.findall(t)]
    assert w.counts.tolist() == [len(WORD.findall(t)) for t in texts]
    assert len(set(w.hashes().tolist())) == 5


def test_mixing_reaches_targets_and_reruns_agree(spark):
    rows = awkward()
    first, again = (sorted(map(tuple, mixing.mix_digest(spark, documents(spark, rows)).collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    by = {}
    for _, size, source_size, target, taken in first:
        assert 0 <= taken <= 2 * size
        by.setdefault((source_size, round(target, 6)), [0])[0] += taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.share_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert sum(x[0] for x in by.values()) == pytest.approx(sum(targets), abs=len(order)) and sum(targets) == pytest.approx(1.5 * sum(sizes.values()))
    for s, t in zip(order, targets):
        assert t <= 2 * sizes[s] + 1e-9 and by[(sizes[s], round(t, 6))][0] == pytest.approx(t, abs=1)


def test_mixing_does_not_rest_on_broadcast_sources(spark, monkeypatch):
    few = sorted(map(tuple, mixing.mix_digest(spark, documents(spark, awkward())).collect()), key=repr)
    monkeypatch.setattr(mixing, "if_small", lambda df, rows: cases.if_small(df, rows, most=0))
    assert sorted(map(tuple, mixing.mix_digest(spark, documents(spark, awkward())).collect()), key=repr) == few


@pytest.mark.parametrize("window_rows", [65_536, 2])
def test_running_totals(spark, window_rows):
    from impactloom.llm.ranks import running_totals

    rows = [(k % 3 if k % 2 else 0, k, k % 7) for k in range(500)] + [(1, 7000, 3)] * 90
    got = running_totals(spark.createDataFrame(rows, "g int, k int, v int"), Scratch(spark, "t"), "g", ["k"], "v", "before", 16, window_rows).collect()
    for g in range(3):
        at = 0
        own = sorted((r.before, r.before + r.v) for r in got if r.g == g)
        for lo, hi in own:
            assert lo == at
            at = hi
        assert at == sum(v for h, _, v in rows if h == g)


def test_permutation_is_one_and_inverts():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        x = np.arange(n)
        y = mixing.permute(x, np.full(n, n), np.full(n, 12345))
        assert sorted(y.tolist()) == list(range(n))
        assert mixing.permute(y, np.full(n, n), np.full(n, 12345), inverse=True).tolist() == x.tolist()


@pytest.mark.parametrize("split", [False, True])
def test_mixed_documents_hold_what_the_digest_says(spark, split):
    """Repeated ids, null ids and repeated rows included; also where joins are split at once."""
    rows = awkward() + [(16, "dup row text here", "e")] * 40 + [(None, "no id at all", "f")] * 9
    docs = documents(spark, rows)
    forced = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
              "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.01", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"} if split else {}
    before = {k: spark.conf.get(k) for k in forced}
    for k, v in forced.items():
        spark.conf.set(k, v)
    want, got = defaultdict(int), defaultdict(int)
    try:
        for r in mixing.mix_digest(spark, docs).collect():
            want[r.doc_id] += r.taken
        out = mixing.mix_documents(spark, docs)
        made = out.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out.columns == docs.columns
    for r in made:
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and r._id == "x"
    assert {i: got[i] for i in want} == want


def base_spans(text):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in pats.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_equal_the_patterns(spark):
    r = random.Random(5)
    parts = ["a@b.c", "x.y@@b.com", "@b.c", "a@b", "a@b.c@d.e", "é@x.de", "1.2.3.4", "300.1.1.1.7.8", "0001.02.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1 2", "+12345678901234567", "DE89370400440532013000",
             "GB82 WEST 1234 5698 7654 32", "account 123456789", "phone", "--", " ", "\n", "日本", "%+-", "9" * 30]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "."]) for _ in range(12)) for _ in range(400)] + [None, ""]
    got = pii.detect_pii(spark, documents(spark, [(i, t, "a") for i, t in enumerate(texts)]), masked=True).collect()
    for row in got:
        want = base_spans(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(row.spans.split(",")) | {""}
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.BASE_KINDS]
    kinds = {s.kind for row in got for s in row.found}
    assert "iban" in kinds and pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    assert pii.mask("call +1 555 010 9999 now", pii.find_spans("call +1 555 010 9999 now")) == "call [PHONE] now"


def test_pii_stays_linear_on_long_texts():
    """Long runs of digits and thousands of spans; a quadratic scan would take minutes."""
    began = time.perf_counter()
    assert pii.find_spans("9" * 300_000) == []
    many = pii.find_spans("mail a@b.cd, account 123456789; " * 20_000)
    assert [sum(s[0] == k for s in many) for k in ("email", "number")] == [20_000, 20_000]
    assert time.perf_counter() - began < 30


def test_pii_numbers_do_not_overlap_other_spans():
    text = "account phone +1 555 010 9999, account 123456789"
    found = pii.find_spans(text)
    assert [(k, text[lo:hi]) for k, lo, hi, _ in found] == [("phone", "+1 555 010 9999"), ("number", "123456789")]


def test_packing_round_trip(spark):
    rows = [(i, t, s) for i, t, s in awkward()]
    got = packing.pack_documents(spark, documents(spark, rows)).collect()
    encode = packing.Encoder()
    docs = defaultdict(list)
    for i, t, _ in rows:
        docs[i].append([*encode.exact.encode(t or "", add_special_tokens=False).ids, 2])
        assert encode(t or "") == docs[i][-1][:-1]
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        ids = [d for d in docs[r.doc_id] if zlib.crc32(np.array(d[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32]
        assert ids and 1 <= r.length <= 1024
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(len(d) for ds in docs.values() for d in ds)
    assert sum(r.length for r in got) == total and len(places) <= -(-total // 1024) + 2


def test_packing_takes_blanks_on_end(spark):
    encode = packing.Encoder()
    texts = [" " * 3_000_000 + "a", "a" + "\n" * 1_000_000, "b" + " \n" * 6_000 + "c", " " * 9_999]
    got = packing.pack_documents(spark, documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    for i, t in enumerate(texts):
        ids = [*encode.exact.encode(t, add_special_tokens=False).ids, 2]
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert encode(t) == ids[:-1] and [zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in pieces] == [r.ids_crc32 for r in pieces]
        assert sum(r.length for r in pieces) == len(ids)


def test_best_fit_plan_places_every_piece_once():
    r = random.Random(2)
    for _ in range(30):
        histogram = {length: r.randrange(1, 200) for length in r.sample(range(1, 101), 12)}
        runs, used = packing.plan_best_fit(histogram, 100)
        room, seen = defaultdict(int), defaultdict(set)
        for length, rank, count, first, offset in runs:
            for k in range(count):
                assert room[first + k] == offset
                room[first + k] += length
                seen[length].add(rank + k)
        assert all(v <= 100 for v in room.values()) and used == len(room)
        assert {k: len(v) for k, v in seen.items()} == histogram
        # Piece by piece, the tightest sequence first, uses as many.
        free: list[int] = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                at = bisect.bisect_left(free, length)
                left = free.pop(at) - length if at < len(free) else 100 - length
                bisect.insort(free, left)
        assert used == len(free)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, label int, dim string, node string")


def awkward_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(150)]
    hub = rng.normal(size=16)
    rows += [(150 + i, (hub + rng.normal(size=16) * 0.25).astype(np.float32).tolist()) for i in range(60)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, [2 * x for x in rows[5][1]]), (303, None), (304, []), (305, [0.0] * 16), (306, [float("nan")] + [1.0] * 15), (307, [None] + [1.0] * 15), (308, [1.0, 2.0]), (309, [1.0, 2.0]), (310, [float("inf")] * 16),
             (311, rows[0][1]), (311, rows[0][1]), (350, rows[7][1])]
    return rows


@pytest.mark.parametrize("block", [4096, 8])
def test_top_k_equals_brute_force(spark, block):
    rows = awkward_vectors()
    good = {(i, tuple(np.floor(256 * np.array(v, dtype=np.float64)))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-int(np.dot(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, topk.exact_top_k(spark, vectors(spark, rows), block=block).collect())) == sorted(want)


def test_near_vectors_equal_brute_force(spark):
    rows = awkward_vectors()
    ok = [bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, links = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=np.float64), np.array(rows[b][1], dtype=np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9 or rows[a][1] == rows[b][1]:
                    n[a] += 1
                    n[b] += 1
                    links.append((rows[a][0], rows[b][0]))
    want = components({i for i, _ in rows}, links)
    got = sorted(map(tuple, near_vectors.near_vector_components(spark, vectors(spark, rows)).collect()))
    assert len(got) == len(rows)
    assert sum(r[1] for r in got) >= 0.95 * sum(n) and all(r[1] <= m for r, m in zip(got, [m for _, m in sorted(zip([i for i, _ in rows], n))]))
    assert sum(want[r[0]] == r[2] for r in got) >= 0.98 * len(got)
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_near_vectors_recall_on_many_vectors(spark):
    """12,000 vectors: near pairs of all cosines, and one group whose vectors all link; very long and very short ones too."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 64))
    for a in range(0, 6000, 3):
        x[a + 1] = x[a] + rng.uniform(0.1, 0.6) * rng.normal(size=64)
        x[a + 2] = x[a + 1] + rng.uniform(0.1, 0.6) * rng.normal(size=64)
    x[8000:9500] = x[8000] + 0.2 * rng.normal(size=(1500, 64))
    x[0:3] *= 1e200
    x[3:6] *= 1e-250
    got = sorted(map(tuple, near_vectors.near_vector_components(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()))
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    links = np.array([(unit[lo : lo + 1000] @ unit.T >= 0.9).sum(axis=1) - 1 for lo in range(0, len(x), 1000)]).ravel()
    found = np.array([r[1] for r in got])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() and found[:6000].sum() >= 0.99 * links[:6000].sum() and links[:6000].sum() > 3000


def test_url_rules_and_link_propagation(spark):
    html = lambda *hosts: " ".join(f'<a href="https://{h}/x">l</a>' for h in hosts)
    rows = [(1, "https://good.org/a", html("fine.net", "FINE.net")), (2, "http://example.org/es/1", html("x.net")), (3, "https://WWW.example.ORG/en/12?q#f", ""), (4, "https://shop.com/de/1", None),
            (5, "https://fine.net/p", ""), (6, "https://spam.net/p", html("shop.com", "shop.com")), (7, "https://far.net/", html("spam.net")), (8, None, None), (9, "no scheme", ""), (10, "https://org", ""), (11, "ftp://a.com/fr/", ""),
            (12, "https://alone.net", "<p>"), (12, "https://alone.net", "<p>"), (None, "x://y.com/fr/?/de/", "")]
    pages = spark.createDataFrame([(a, b, c, "h", "p") for a, b, c in rows], "page_id long, url string, html string, host string, path string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark, pages).collect()}
    assert got == {(1, "good.org", "/a", "org/", "allow"), (2, "example.org", "/es/1", "example.org/es/", "block"), (3, "www.example.org", "/en/12", "example.org/en/1", "block"), (4, "shop.com", "/de/1", "com/de/", "block"),
                   (5, "fine.net", "/p", None, "allow"), (6, "spam.net", "/p", None, "block"), (7, "far.net", "/", None, "block"), (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "org", "", None, "allow"),
                   (11, "a.com", "/fr/", "com/fr/", "allow"), (12, "alone.net", "", None, "allow"), (None, "y.com", "/fr/", "com/fr/", "allow")}
    assert url_filter.judge_urls(spark, pages).count() == len(rows)


def test_propagation_equals_dense_power_iteration(spark):
    from impactloom.llm.scratch import Scratch

    r = random.Random(6)
    edges = {(f"h{r.randrange(9)}", f"h{r.randrange(9)}"): r.randrange(1, 4) for _ in range(20)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    links = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 3, 0), ("h1", 1, 2)], "host string, trust long, distrust long")
    got = {x.host: (x.trust, x.distrust) for x in url_filter.propagate(Scratch(spark, "t"), links, seeds).collect()}
    for way, start in ((0, {"h0": 3, "h1": 1}), (1, {"h1": 2})):
        e = {(a, b) if not way else (b, a): n for (a, b), n in edges.items()}
        rank = {f"h{i}": 0.15 * start.get(f"h{i}", 0) for i in range(9)}
        for _ in range(200):
            new = {h: 0.15 * start.get(h, 0) for h in rank}
            for (a, b), n in e.items():
                new[b] += 0.85 * rank[a] * n / sum(m for (x, _), m in e.items() if x == a)
            rank = new
        assert all(abs(v - got.get(h, (0, 0))[way]) < 1e-3 for h, v in rank.items())


def test_quotes(spark):
    rows = [(1, 0, "a", "Hello there.\nSecond line"), (1, 1, "b", "> Hello there.\n> Second line\nI agree"), (1, 2, "a", "New topic"), (1, 3, "c", ">> hello  THERE.\n>> second line\n> I agree\nMe too"), (1, 4, "b", "> not said\nok"),
            (1, 5, "a", "> New topic\nyes"), (2, 0, "a", None), (2, 1, "b", ""), (2, 1, "b", ""), (None, None, None, "> I agree\nother conversation")]
    d = spark.createDataFrame([(a, b, c, t, "z", "z") for a, b, c, t in rows], "conv_id long, turn long, role string, text string, hash string, node string")
    got = quotes.link_quotes(spark, d).collect()
    assert [(r.conv_id, r.thread_turn, r.turn, r.parent_turn, r.n_quotes, r.n_links, r.own_text) for r in got if r.conv_id == 1] == [
        (1, 0, 0, None, 0, 0, "Hello there.\nSecond line"), (1, 0, 1, 0, 1, 1, "I agree"), (1, 0, 3, 1, 2, 2, "Me too"), (1, 2, 2, None, 0, 0, "New topic"), (1, 2, 5, 2, 1, 1, "yes"), (1, 4, 4, None, 1, 0, "ok")]
    assert len(got) == len(rows)


def test_quotes_equal_a_plain_search(spark):
    """Whole and partial quotes of random messages against a search that looks through all earlier ones."""
    r = random.Random(9)
    messages, rows = {}, []
    for conv in range(6):
        for turn in range(14):
            own = [f"c{conv if r.random() < 0.9 else 0} word{r.randrange(10**6)} line {k}" for k in range(r.randrange(1, 6))]
            quoted, parents = [], []
            if turn and r.random() < 0.8:
                origin = r.randrange(turn)
                lines = messages[conv, origin]
                lo = r.randrange(len(lines))
                part = lines[lo : r.randrange(lo + 1, len(lines) + 1)]
                quoted = [*([f"On Monday at 10:{turn:02d}, P{origin} wrote:"] if r.random() < 0.5 else []), *(r.choice(["> ", ">", " > "]) + x.upper() for x in part)]
                parents = [t for t in range(turn) if all(p in messages[conv, t] for p in part)]
            messages[conv, turn] = own
            rows.append((conv, turn, "\n".join([*quoted, *own]), min(parents, default=None), "\n".join(own)))
    d = spark.createDataFrame([(c, t, "x", text) for c, t, text, _, _ in rows], "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): (x.parent_turn, x.own_text) for x in quotes.link_quotes(spark, d).collect()}
    assert got == {(c, t): (parent, own) for c, t, _, parent, own in rows}
    long_ = "a " * 400_000 + "\n" + "> " * 50_000
    assert quotes.split_quotes(long_)[1][0][0] == 50_000 and quotes.split_quotes("I wrote: x\n> q\nok")[0] == "I wrote: x\nok"


def test_quality_learns_and_ignores_ids(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(spark, docs, labels)
    got = quality.score_documents(spark, docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93
    moved = docs.withColumn("doc_id", -F.col("doc_id") - 1)
    a = {r.doc_id: r.score for r in quality.score_documents(spark, docs.limit(50), model).collect()}
    b = {-r.doc_id - 1: r.score for r in quality.score_documents(spark, moved.limit(50), model).collect()}
    assert a == b
    odd = quality.score_documents(spark, documents(spark, awkward()), model).collect()
    assert len(odd) == len(awkward()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in odd)
    # What the driver fits on is bounded whatever repeats: equal rows and equal labels add nothing.
    twice = quality.fit(spark, docs.unionByName(docs), labels.unionByName(labels))
    assert np.array_equal(twice.value, model.value) and np.array_equal(twice.threshold, model.threshold)
    none = quality.fit(spark, docs, labels.limit(0))
    assert {r.score for r in quality.score_documents(spark, docs.limit(5), none).collect()} == {0.5}


def test_empty_tables(spark):
    docs = documents(spark, []).limit(0)
    assert ngram_join.ngram_jaccard_components(spark, docs).count() == 0
    assert substring_dedup.remove_repeated_substrings(spark, docs).count() == 0
    assert mixing.mix_digest(spark, docs).count() == 0 and mixing.mix_documents(spark, docs).count() == 0
    assert pii.detect_pii(spark, docs).count() == 0 and packing.pack_documents(spark, docs).count() == 0
    assert topk.exact_top_k(spark, vectors(spark, [])).count() == 0 and near_vectors.near_vector_components(spark, vectors(spark, [])).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(spark, pages).count() == 0
    assert quotes.link_quotes(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert quality.score_documents(spark, docs, quality.Trees(0.0, 4)).count() == 0


def test_only_null_texts(spark):
    docs = documents(spark, [(i, None, None) for i in range(3)])
    assert {r.component_id for r in ngram_join.ngram_jaccard_components(spark, docs).collect()} == {0, 1, 2}
    assert substring_dedup.remove_repeated_substrings(spark, docs).count() == 3
    assert {r.taken for r in mixing.mix_digest(spark, docs).collect()} == {0}
    assert packing.pack_documents(spark, docs).select("sequence_id").distinct().count() == 1


def test_every_operator_has_a_query(spark):
    assert [f"op{i}" for i in range(1, 11)] == [name.split("_")[0] for name in queries.queries()]


def test_pipeline_stages(spark):
    import corpus_pipeline

    labels_dir = SF
    docs = documents(spark, awkward())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, labels_dir)
        assert out.columns == docs.columns, name
        out.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    comps = components({i for i, _, _ in awkward() if i}, [(a, b) for x, (a, t, _) in enumerate(awkward()) for b, u, _ in awkward()[x + 1 :]
                                                          if a and b and (A := shingles(t, 5)) and (B := shingles(u, 5)) and 100 * len(A & B) >= 80 * len(A | B)])
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert set(ids) == {i for i, c in comps.items() if i == c} and ids.count(16) == 1
    masked = corpus_pipeline.mask_personal_data(spark, documents(spark, [(1, "write a@b.co now", "a"), (2, None, "a")]), SF).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in masked] == [("write [EMAIL] now", 17), (None, None)]
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() >= docs.count()
    repeats = documents(spark, [(None, None, None)] * 5 + [(None, base := "one two three four five six seven", "a")] * 5 + [(3, base, "b")])
    assert corpus_pipeline.drop_near_duplicates(spark, repeats, SF).count() == 6
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.run(spark, SF).count() > 0
