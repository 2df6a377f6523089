"""Rows that once were left out: texts that share an id, partial quotes, far hosts, identifiers before other words."""

from __future__ import annotations

import random

import pytest
from test_llm import components, documents, shingles

from impactloom.llm import ngram_join, pii, quotes, url_filter
from impactloom.llm.scratch import Scratch


def near_copies(seed=5):
    """Ids with several texts (the null id most), each with near copies under other ids."""
    r = random.Random(seed)
    texts = [[f"v{i}w{r.randrange(10**6)}" for _ in range(60)] for i in range(12)]
    rows = [(None, " ".join(t), "a") for t in texts[:6]] + [(9 if i < 9 else 8, " ".join(texts[i]), "a") for i in range(6, 12)]
    for i, t in enumerate(texts):
        for copy in range(2):
            rows.append((100 + 2 * i + copy, " ".join([*t[: 59 - copy], "tail"]), "b"))
    rows += [(9, "  ", "a"), (50, None, "a"), (50, rows[-1][1], "a"), (None, rows[0][1], "a")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("turned", [False, True])
def test_texts_of_one_id_are_all_compared(spark, turned):
    rows = near_copies()[:: -1 if turned else 1]
    low = -(10**9)
    sets = [(low if i is None else i, shingles(t, 5)) for i, t, _ in rows]
    links = [(a, b) for x, (a, A) in enumerate(sets) for b, B in sets[x + 1 :] if A and B and 100 * len(A & B) >= 80 * len(A | B)]
    want = components({i for i, _ in sets}, links)
    got = ngram_join.ngram_jaccard_components(spark, documents(spark, rows).coalesce(1), 5, 80).collect()
    assert sorted((low if x.doc_id is None else x.doc_id, x.n_shingles, low if x.component_id is None else x.component_id) for x in got) == sorted((i, len(s), want[i]) for i, s in sets)


def test_trimmed_quotes_link_to_their_original(spark):
    rows = [(1, 0, "Common"), (1, 1, "One\nCommon\nThree\nFour\nFive"), (1, 2, "> Common\n> Three\nTrimmed"), (1, 3, "P one\n\nP two\nmore\n\nP three"), (1, 4, "> P one\n> \n> P two\n> more\nYes"),
            (1, 5, "Alpha"), (1, 6, "Beta"), (1, 7, "Alpha\nBeta\nGamma"), (1, 8, "> Alpha\n> Beta\nBoth"), (2, 0, "> Three\n> Four\nelsewhere")]
    d = spark.createDataFrame([(a, b, "x", t) for a, b, t in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.n_links) for r in quotes.link_quotes(spark, d).collect()}
    assert [got[1, t] for t in (2, 4, 8)] == [(1, 1, 1), (3, 3, 1), (7, 7, 1)] and got[2, 0] == (None, 0, 0)


def test_propagation_does_not_depend_on_unrelated_seeds(spark):
    links = spark.createDataFrame([(f"h{i + 1}", f"h{i}", 1) for i in range(4)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 0, 20), ("apart.org", 3_000_000, 0)], "host string, trust long, distrust long")
    got = {r.host: r.distrust for r in url_filter.propagate(Scratch(spark, "t"), links, seeds).collect()}
    assert all(abs(got[f"h{i}"] - 20 * 0.15 * 0.85**i) < 1e-9 for i in range(5))


def test_ibans_before_other_words():
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    for before, iban, after in (("", de, " BIC COBADEFF"), ("to ", de, " 2024"), ("", de.replace(" ", ""), " REF 7"), ("", gb, " " + de), ("ID12 ", de, ""), ("", de, "")):
        text = before + iban + after
        assert ("iban", len(before), len(before) + len(iban)) in [s[:3] for s in pii.find_spans(text)], text
    assert [s[1] for s in pii.find_spans(f"{gb} {de}") if s[0] == "iban"] == [0, len(gb) + 1]
    assert not [s for s in pii.find_spans("DE88 3704 0044 0532 0130 00 BIC") if s[0] == "iban"]


def test_near_duplicates_go_by_text_within_one_id(spark):
    import corpus_pipeline

    r = random.Random(9)
    text = lambda: [f"w{r.randrange(10**6)}" for _ in range(60)]
    a, b, c, d = text(), text(), text(), text()
    near = lambda t: " ".join([*t[:59], "tail"])
    full = " ".join
    rows = [(None, full(a), "s"), (None, near(a), "s"), (None, full(b), "s"), (None, full(b), "s"), (1, full(c), "s"), (5, near(c), "s"), (5, full(d), "s"), (7, near(d), "s"), (None, None, "s"), (None, " ", "s")]
    kept = sorted(((x.doc_id or 0, x.text or "") for x in corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "").collect()))
    assert len([k for k in kept if k[0] == 0 and k[1] in (full(a), near(a))]) == 1
    assert [k for k in kept if k[1] not in (full(a), near(a))] == sorted([(0, full(b)), (1, full(c)), (5, full(d)), (0, ""), (0, " ")])
