"""The backtest from diffs against plain Python on made-up commits, its limits, and its command."""

from __future__ import annotations

import difflib
import json
import random
import re

from impactloom.__main__ import main
from impactloom.functions import textdiff
from impactloom.operators import history
from impactloom.operators.impact import Impact
from impactloom.plans.replay import Replay

NAMES = [f"f{i}" for i in range(9)]


def _file(r, names):
    return "".join(f"fn {n}(a: {r.choice(['i32', 'i64'])}) {{{r.choice(['', ' // note'])}\n  a + {r.randrange(3)}\n}}\n{r.choice(['', chr(10)])}" for n in names)


def _diff(path, old, new):
    body = "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}" if new else "/dev/null", n=0))
    return f"diff --git a/{path} b/{path}\n{body}" if body else ""


def _functions(text):
    """{name: (first line, last line, signature)} of texts in which each function begins and ends with a line of its own."""
    out, lines = {}, text.split("\n")
    for i, line in enumerate(lines):
        if m := re.match(r"fn (\w+)(\(.*\)) \{", line):
            out[m[1]] = (i + 1, next(j for j in range(i, len(lines)) if lines[j] == "}") + 1, re.sub(r"\s", "", m[2]))
    return out


def _expected(files):
    names, broken = set(), set()
    for old, new in files:
        a, b = old.splitlines(), new.splitlines()
        lines = {j for tag, _, _, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes() if tag != "equal" for j in (range(j1 + 1, j2 + 1) if j2 > j1 else [j1])}
        names |= {n for n, (lo, hi, _) in _functions(new).items() if any(lo <= j <= hi for j in lines)}
    for old, new in files:
        before, after = _functions(old), _functions(new)
        broken |= {n for n in names & set(before) if n not in after or after[n][2] != before[n][2]}
    plain = lambda t: re.sub(r"\s", "", re.sub(r"//.*", "", t))
    kind = "contract-break" if broken else "cosmetic" if all(plain(o) == plain(n) for o, n in files) else "body-edit"
    return names, broken, kind


def _commits(seed, n):
    r = random.Random(seed)
    for c in range(n):
        files = {}
        for k in range(r.randrange(1, 4)):
            old = "" if r.random() < 0.15 else _file(r, r.sample(NAMES, r.randrange(1, 4)))
            new = old.replace("{\n", "{ // said\n") if r.random() < 0.3 else "" if r.random() < 0.2 else _file(r, r.sample(NAMES, r.randrange(1, 4)))
            if old != new:
                files[f"{r.choice(['src', 'src', 'tool'])}/m{k}.rs"] = (old, new)
        yield c, files


def _tables(spark, commits):
    diffs = [(c, "".join(_diff(p, o, n) for p, (o, n) in files.items())) for c, files in commits] + [(900, None), (901, "")]
    texts = [(c, p, o or None, n or None) for c, files in commits for p, (o, n) in files.items()] + [(902, None, "x", "y"), (903, "src/a.rs", None, None)]
    return spark.createDataFrame(diffs + diffs[:5], "event_id long, diff string"), spark.createDataFrame(texts, "event_id long, path string, old_text string, new_text string")


def _graph(spark):
    d = spark.createDataFrame([(i, n, f"src/{'auth' if i % 3 else 'x'}/m{i % 4}.rs", i % 3, 1, 2) for i, n in enumerate(NAMES[:7] + ["g", "h"])], "id long, name string, file_path string, project_id long, start_line long, end_line long")
    return d, spark.createDataFrame([(7, 0), (8, 7), (1, 0), (2, 1), (8, 3)], "source_id long, target_id long")


def test_replayed_commits_equal_plain_python(spark):
    commits = list(_commits(5, 120))
    diffs, texts = _tables(spark, commits)
    d, calls = _graph(spark)
    replay = Replay(diffs, texts, d, calls, own_prefixes=("tool/",))
    want = {c: _expected([v for p, v in files.items() if p.startswith("src/")]) for c, files in commits}
    want = {c: w for c, w in want.items() if w[0]}
    assert {k for _, _, k in want.values()} == {"contract-break", "cosmetic", "body-edit"}
    assert {(r.event_id, r.name) for r in replay.names.collect()} == {(c, n) for c, (names, _, _) in want.items() for n in names}
    assert {(r.event_id, r.name) for r in replay.broken.collect()} == {(c, n) for c, (_, broken, _) in want.items() for n in broken}
    assert {r.event_id: r.edit_class for r in replay.edits.collect()} == {c: k for c, (_, _, k) in want.items()}
    events = spark.createDataFrame([(c, n, k) for c, (names, _, k) in want.items() for n in names], "event_id long, changed_symbol string, edit_class string")
    by_hand = {r.event_id: r for r in Impact(events, d, calls).verdicts().collect()}
    verdicts = replay.verdicts()
    assert {r.event_id: r for r in verdicts.collect()} == by_hand and set(by_hand) == set(want)
    assert sum(r.n for r in replay.classes().collect()) == len(want)
    caught = replay.catches(verdicts).collect()
    worst = sorted((r for r in by_hand.values() if r.action in ("BLOCK", "SENIOR_REVIEW") or r.edit_class == "contract-break"), key=lambda r: (-r.total_dependents, r.event_id))[:6]
    assert [(r.event_id, r.contract_changed or "") for r in caught] == [(r.event_id, ", ".join(sorted(want[r.event_id][1]))) for r in worst]


def test_the_newest_commits_with_changed_functions_are_replayed(spark):
    commits = list(_commits(6, 60))
    diffs, texts = _tables(spark, commits)
    log = spark.createDataFrame([(c, -c, f"s{c}") for c, _ in commits], "event_id long, seq long, subject string")
    replay = Replay(diffs, texts, *_graph(spark), commits=log, newest=7)
    known = [c for c, files in commits if _expected(files.values())[0]]
    assert {r.event_id for r in replay.edits.collect()} == set(sorted(known)[-7:])
    assert all(r.subject == f"s{r.event_id}" for r in replay.catches(replay.verdicts()).collect())


def test_empty_replay(spark):
    diffs, texts = _tables(spark, [])
    replay = Replay(diffs, texts, *_graph(spark))
    assert replay.edits.count() == replay.verdicts().count() == replay.classes().count() == 0


def test_contracts_equal_single_signatures():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["fn ", "def ", "function ", "a", "b", "(", ")", "{", "}", ":", ";", "<", ">", " ", "\n", "x: i32"]) for _ in range(r.randrange(60)))
        got = {c["name"]: c["digest"] for c in textdiff._contracts(text)}
        for name in set(re.findall(r"\w+", text)):
            sig = textdiff._signature(text, name) if re.match(r"[A-Za-z_]", name) else None
            assert got.get(name) == (sig and textdiff.md5(re.sub(r"(?a)\s+", "", sig).encode()).hexdigest()), (text, name)
    assert textdiff._contracts(None) == [] == textdiff._contracts("")


def test_ranked_scars_leave_out_tests_and_break_ties_by_path(spark):
    rows = [(f"src/f{i:02}.rs", 5, 1, 0, 0, 0.0, 0.4) for i in range(20)] + [("src/tests/a.rs", 5, 2, 0, 0, 0.0, 0.8), ("src/z.rs", 5, 0, 2, 0, 0.0, 0.44), ("src/y.rs", 1, 0, 0, 0, 0.0, 0.0)]
    s = spark.createDataFrame(rows, "file_path string, total long, reverts long, hotfixes long, fixes long, fix_density double, intensity double")
    got = history.ranked_scars(s).collect()
    assert [r.place for r in got] == list(range(1, 16)) and [r.file_path for r in got] == ["src/z.rs"] + [f"src/f{i:02}.rs" for i in range(14)]


def test_backtest_command_takes_diffs(spark, tmp_path, capsys):
    import pytest

    folder = str(tmp_path / "t")
    d, calls = _graph(spark)
    d.selectExpr("*", "name AS fqn", "'Function' AS definition_type").write.parquet(f"{folder}/gl_definition")
    calls.selectExpr("*", "'CALLS' AS relationship_kind").write.parquet(f"{folder}/gl_edge")
    old, new = "fn f0(a: i32) {\n  a\n}\n", "fn f0(a: i64) {\n  a\n}\n"
    (tmp_path / "d").write_text(json.dumps({"commit_id": "c1", "diff": _diff("src/m.rs", old, new)}))
    (tmp_path / "x").write_text(json.dumps({"commit_id": "c1", "path": "src/m.rs", "old_text": old, "new_text": new}))
    (tmp_path / "log").write_bytes(b"\x00c1\x1f2024-01-01\x1ffeat: wider\n")
    argv = ["backtest", "--tables", folder, "--diffs", str(tmp_path / "d"), "--texts", str(tmp_path / "x")]
    assert main([*argv, "--log", str(tmp_path / "log"), "--newest", "3"], spark) == 0
    out = capsys.readouterr().out
    assert "contract-break" in out and "c1" in out and "feat: wider" in out and "f0" in out
    with pytest.raises(SystemExit):
        main(["backtest", "--tables", folder], spark)
