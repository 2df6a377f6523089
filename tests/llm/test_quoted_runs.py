"""Quotes that are sentences, parts of lines or lines wrapped anew, against a search through all earlier messages."""

from __future__ import annotations

import random

from impactloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def parents(spark, rows):
    got = quotes.link_quotes(spark, spark.createDataFrame([(c, t, "x", text) for c, t, text in rows], SCHEMA)).collect()
    return {(r.conv_id, r.turn): r.parent_turn for r in got}


def test_sentences_and_parts_of_lines(spark):
    rows = [(1, 0, "One two three. Four five six."), (1, 1, "> four five\n> six.\nyes"), (1, 2, "a\nlong first line of a\nlonger second line here"), (1, 3, "> long first line of a longer\nno"),
            (1, 4, "> first line of\nthat"), (1, 5, "> first line\ntwo words only"), (1, 6, "> five six. seven\nnot said"), (2, 0, "long first line of a longer"), (2, 1, None), (1, 7, ">> two   THREE.\n> \nok")]
    assert parents(spark, rows) == {(1, 0): None, (1, 1): 0, (1, 2): None, (1, 3): 2, (1, 4): 2, (1, 5): None, (1, 6): None, (1, 7): None, (2, 0): None, (2, 1): None}


def test_runs_of_words_equal_a_plain_search(spark):
    r = random.Random(21)
    words = [f"w{k}" for k in range(12)]
    own, rows, want = {}, [], {}
    for conv in range(5):
        for turn in range(25):
            text = [r.choice(words) for _ in range(r.randrange(1, 60))]
            quoted = []
            if turn and r.random() < 0.8:
                source = own[conv, r.randrange(turn)]
                lo = r.randrange(len(source))
                quoted = source[lo : lo + r.choice([1, 2, 3, 4, 7, 8, 9, 20])]
            own[conv, turn] = text
            lines = []
            k = 0
            while k < len(quoted):  # wrapped anew
                n = r.randrange(1, 6)
                lines.append("> " + " ".join(quoted[k : k + n]).upper())
                k += n
            rows.append((conv, turn, "\n".join([*lines, " ".join(text)])))
            holds = lambda t: any(own[conv, t][i : i + len(quoted)] == quoted for i in range(len(own[conv, t])))  # noqa: E731, B023
            if len(quoted) >= quotes.RUN_LEAST:
                want[conv, turn] = next((t for t in range(turn) if holds(t)), None)
    got = parents(spark, rows)
    assert {k: got[k] for k in want} == want and sum(v is not None for v in want.values()) > 40
