import datetime as dt

import pytest

from lodestone.sources.manifest import ConflictError
from lodestone.streaming import changes, incremental
from lodestone.streaming.incremental import Commit, CommitLog, process

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


SCANS = "run_id int, root string, path string, modified_ms bigint, size bigint, seen_at timestamp, extra string"
RUNS = "run_id int, status string, started_at timestamp, finished_at timestamp"


def tables(spark, scans, runs, state):
    a = spark.createDataFrame([(r, "/", p, m, s, at(t), "x") for r, p, m, s, t in scans], SCANS)
    b = spark.createDataFrame([(r, s, at(r * 10), at(f)) for r, s, f in runs], RUNS)
    return a, b, spark.createDataFrame(state, "path string, modified_ms bigint, size bigint")


def test_runs_in_order_with_failures_and_late_rows(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    scans = [(1, "a", 1, 1, 11), (1, "b", 2, 2, 11), (1, "b", 9, 9, 10), (1, "c", None, 1, 11), (1, "d", 5, 5, 99), (2, "a", 7, 7, 21), (3, "a", 7, 7, 31), (3, "b", 2, 2, 31), (3, "n", 1, 1, 31), (3, "n", 1, 1, 31)]
    runs = [(0, "ok", 5), (1, "ok", 15), (2, "failed", None), (3, "ok", 35)]
    a, b, c = tables(spark, scans, runs, [("a", 1, 1), ("n", None, 1)])
    # only the first run is there
    process(log, a.where("run_id <= 1"), b.where("run_id <= 1"), c)
    assert {tuple(r) for r in log.changes().select("run_id", "path").collect()} == {(1, "b")}
    # a crash after writing and before the commit leaves nothing; the next call does the work once
    publish = log.publish
    log.publish = lambda _: (_ for _ in ()).throw(RuntimeError("died"))
    with pytest.raises(RuntimeError):
        process(log, a, b, c)
    log.publish = publish
    assert log.last().watermark == 1
    process(log, a, b, c)
    assert {tuple(r) for r in log.changes().select("run_id", "path").collect()} == {(1, "b"), (3, "a"), (3, "n")}
    assert process(log, a, b, c) is None and log.last() == log.read(2) and log.last().watermark == 3
    with pytest.raises(ConflictError):
        log.publish(Commit(2, 3, "x", "y", 1, 0))
    assert log.clean(0) == 1 and log.changes().count() == 3  # what the crash has left


def found(log):
    rows = [tuple(r) for r in log.changes().select("run_id", "path").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_an_open_run_holds_back_later_ones(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    scans = [(1, "a", 2, 2, 11), (2, "a", 3, 3, 21), (2, "b", 1, 1, 21), (3, "b", 2, 2, 31)]
    for status in ("running", None):
        a, b, c = tables(spark, scans, [(1, status, None), (2, "ok", 25), (3, "ok", 35)], [("a", 1, 1)])
        assert process(log, a, b, c) is None and log.changes().count() == 0
    a, b, c = tables(spark, scans, [(1, "ok", 15), (2, "ok", 25), (3, "open", None)], [("a", 1, 1)])
    assert process(log, a, b, c).watermark == 2 and found(log) == {(1, "a"), (2, "a"), (2, "b")}
    a, b, c = tables(spark, scans, [(1, "ok", 15), (2, "ok", 25), (3, "failed", None)], [("a", 1, 1)])
    assert process(log, a, b, c) is None


def test_late_rows_of_a_committed_run_come_out_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    runs = [(1, "ok", 15), (2, "ok", 25), (3, "ok", 35)]
    early = [(1, "a", 2, 2, 11), (2, "a", 2, 2, 21), (2, "c", 1, 1, 21)]
    a, b, c = tables(spark, early, runs[:2], [("a", 1, 1), ("b", 1, 1)])
    process(log, a, b, c)
    late = [*early, (1, "b", 5, 5, 12), (2, "a", 9, 9, 22), (3, "b", 5, 5, 31), (3, "c", 2, 2, 31)]
    a, b, _ = tables(spark, late, runs, [])
    process(log, a, b, c)
    assert found(log) == {(1, "a"), (2, "c"), (1, "b"), (2, "a"), (3, "c")}
    assert process(log, a, b, c) is None
    assert {tuple(r) for r in log.state().collect()} == {("a", 9, 9), ("b", 5, 5), ("c", 2, 2)}


def test_state_is_written_anew_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 2)
    log = CommitLog(spark, f"file://{tmp_path}/log")
    scans = [(r, p, r // n, 1, r * 10 + 1) for r in range(1, 6) for n, p in ((1, "a"), (2, "b"))]
    for r in range(1, 6):
        a, b, c = tables(spark, scans, [(x, "ok", x * 10 + 5) for x in range(1, r + 1)], [("a", 0, 1), ("b", 0, 1), ("z", None, 1)])
        process(log, a, b, c)
    assert found(log) == {*((r, "a") for r in range(1, 6)), (2, "b"), (4, "b")}
    assert len({log.read(s).base for s in log.sequences()}) == 3
    assert {tuple(r) for r in log.state().collect()} == {("a", 5, 1), ("b", 2, 1), ("z", None, 1)}


def test_empty_tables(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    a, b, c = tables(spark, [], [], [])
    assert process(log, a, b, c) is None and log.changes().count() == 0
    _, b, _ = tables(spark, [], [(1, "ok", None)], [])
    assert process(log, a, b, c).watermark == 1 and log.changes().count() == 0


def test_change_stream_is_handed_on_in_bursts(spark, tmp_path):
    rows = [(T0 + dt.timedelta(milliseconds=m), p) for m, p in ((0, "a"), (300, "b"), (600, "a"), (5000, "c"), (60_000, "z"))]
    spark.createDataFrame(rows, "ts timestamp, path string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, path string").parquet(f"{tmp_path}/in")
    seen = []
    q = changes.apply_stream(changes.debounce_stream(stream), lambda df: seen.extend(r.path for r in df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted(seen) == ["a", "b", "c"]


def test_the_stream_goes_on_after_a_restart(spark, tmp_path):
    folder, seen = tmp_path / "events", []
    folder.mkdir()

    def run():
        q = changes.apply_stream(changes.debounce_stream(changes.event_stream(spark, str(folder))), lambda df: seen.extend(r.path for r in df.collect()), f"{tmp_path}/cp")
        q.awaitTermination(120)

    (folder / "1.json").write_text('{"ts": "2024-01-01T00:00:00Z", "path": "a"}\n{"ts": "2024-01-01T00:10:00Z", "path": "b"}\n')
    run()
    assert seen == ["a"]
    (folder / "2.json").write_text('{"ts": "2024-01-01T00:20:00Z", "path": "c"}\n')
    run()
    assert seen == ["a", "b"]
