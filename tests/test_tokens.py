"""The stateful throttle across micro-batches and restarts."""

from __future__ import annotations

import datetime as dt

from impactloom.streaming import intake, tokens


def test_counters_survive_a_restart_and_windows_end(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 12, 0, 0)
    schema = "user_id long, ts timestamp"
    told = lambda rows: spark.createDataFrame([(u, start + dt.timedelta(seconds=s)) for u, s in rows], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run():
        arriving = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        tokens.throttle_stream(arriving, f"file://{tmp_path}/out", str(tmp_path / "state")).awaitTermination()
        at = int(start.replace(tzinfo=dt.timezone.utc).timestamp())
        return sorted((r.user_id, r.window_start - at, r.n, r.allowed) for r in intake.current(spark, f"file://{tmp_path}/out", ["user_id", "window_start"]).collect())

    told([(1, s) for s in range(6)] + [(2, 59), (2, 60)])
    assert run() == [(1, 0, 6, 6), (2, 0, 1, 1), (2, 60, 1, 1)]
    assert run() == [(1, 0, 6, 6), (2, 0, 1, 1), (2, 60, 1, 1)]  # nothing new
    told([(1, s) for s in range(50, 58)] + [(3, 1000)])
    assert run() == [(1, 0, 14, 10), (2, 0, 1, 1), (2, 60, 1, 1), (3, 960, 1, 1)]
    told([(1, 1001)])
    assert run() == [(1, 0, 14, 10), (1, 960, 1, 1), (2, 0, 1, 1), (2, 60, 1, 1), (3, 960, 1, 1)]
