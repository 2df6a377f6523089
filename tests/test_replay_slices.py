"""A replay of slices of commits gives what one of all commits gives."""

from __future__ import annotations

from impactloom.plans.replay import Replay


def test_slices_of_commits_equal_all_at_once(spark):
    text = lambda k, kind: f"fn f{k}(a: {kind}) {{\n  a\n}}\nfn g(b: i32) {{\n  b\n}}\n"
    texts = spark.createDataFrame([(e, f"p{f}.rs", text(f, "i32"), text(f, "i64" if e % 2 else "i32")) for e in range(20) for f in range(e % 3 + 1)], "event_id long, path string, old_text string, new_text string")
    diffs = spark.createDataFrame([(e, f"diff --git a/p{f}.rs b/p{f}.rs\n--- a/p{f}.rs\n+++ b/p{f}.rs\n@@ -1 +{1 + 3 * (f % 2)} @@\n+x\n") for e in range(20) for f in range(e % 3 + 1)], "event_id int, diff string")
    commits = spark.createDataFrame([(e, e * 7 % 20, f"s{e}") for e in range(20)], "event_id long, seq long, subject string")
    d = spark.createDataFrame([(1, "f0", "p", 1)], "id long, name string, file_path string, project_id long")
    calls = spark.createDataFrame([(2, 1)], "source_id long, target_id long")
    for newest in (None, 6):
        whole, sliced = (Replay(diffs, texts, d, calls, commits, newest, slice_files=n) for n in (10**6, 13))
        for get in (lambda r: r.names, lambda r: r.broken, lambda r: r.edits, lambda r: r.events):
            want = sorted(map(tuple, get(whole).collect()))
            assert sorted(map(tuple, get(sliced).collect())) == want and want
        path = spark._jvm.org.apache.hadoop.fs.Path(sliced.scratch.root)
        written = {f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
        assert {"broken-0", "broken-2", "events-2"} <= written and "names-0" not in written
    assert len({r.event_id for r in sliced.edits.collect()}) == 6
