import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscan.operators.incremental import RunState, epoch_seconds, replay_runs, successful_runs
from folioscan.session import scratch_path
from tests.conftest import rows

D = dt.datetime
ROWS = "tag string, f bigint, loaded_at timestamp_ntz, a string, b string, run_id string"
RUNS = "run_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def replay(spark, data, runs):
    return rows(replay_runs(spark.createDataFrame(data, ROWS), spark.createDataFrame(runs, RUNS), F.col("tag"), epoch_seconds(F.col("f")), "loaded_at", ["a", "b"], ["a", "b"]))


def day(n, h=0):
    return D(2024, 1, n, h)


def test_replay(spark):
    data = [
        ("A", 100, day(1), "x", None, "extra"),
        ("A", 100, day(1), "x", None, "extra"),  # the same row twice
        ("A", 200, day(4), "x", "", "extra"),  # fetched again, nothing new (null is empty)
        ("B", 100, day(4), "y", "", None),
        ("B", 300_000_000_000, day(4), "", None, None),  # a failed fetch
        ("A", 150, day(6), "old", None, None),  # arrives late, is older
        ("B", 1_700_000_000_000, day(6), "z", None, None),  # milliseconds
        ("B", 1_600_000_000, day(6), "w", None, None),
        ("C", None, day(6), "c", None, None),
        ("C", 0, day(6, 1), "d", None, None),  # same version, later arrival
        (None, 5, day(6), "n", None, None),
        ("D", 5, None, "n", None, None),
        ("E", 5, day(20), "n", None, None),  # after the last run
        ("A", 400, day(8), "x", None, None),
    ]
    runs = [(1, day(2), None, "started"), (1, day(2), day(2), "success"), (2, day(3), None, "failed"), (3, day(5), day(5), "success"), (4, day(6, 12), None, "killed"), (5, day(7), day(7), "success"), (5, day(7), day(7), "success"), (6, day(9), None, None), (7, day(10), day(10), " Success "), (8, day(11), None, None)]
    assert replay(spark, data, runs) == [(1, "A"), (3, "B"), (5, "B"), (5, "C")]


def test_return_to_older_content(spark):
    data = [("A", n, day(n), v, None, None) for n, v in ((1, "x"), (3, "y"), (5, "x"))]
    runs = [(n, day(n + 1), None, "success") for n in (1, 3, 5)]
    assert replay(spark, data, runs) == [(1, "A"), (3, "A"), (5, "A")]
    # changed and back between two runs: no case
    assert replay(spark, data, [(1, day(2), None, "success"), (2, day(6), None, "success")]) == [(1, "A")]


def test_empty_tables(spark):
    assert replay(spark, [], [(1, day(2), None, "success")]) == []
    assert replay(spark, [("A", 1, day(1), "x", None, None)], []) == []
    assert successful_runs(spark.createDataFrame([], RUNS)) == []


def newest(spark, *data):
    return spark.createDataFrame([(k, v, day(1), h) for k, v, h in data], "key string, version bigint, arrived timestamp_ntz, hash string")


def test_crash_before_swap_loses_and_repeats_nothing(spark):
    state = RunState(spark, scratch_path(spark, "state"))
    state.run(1, newest(spark, ("A", 1, "x"), ("B", 1, "y")))
    with pytest.raises(RuntimeError):
        state.run(2, newest(spark, ("A", 2, "z")), fail_before_swap=True)
    assert state.committed()["run"] == 1
    assert rows(state.changes()) == [(1, "A"), (1, "B")]
    again = RunState(spark, state.path)  # a new process
    again.run(2, newest(spark, ("A", 2, "z"), ("C", 1, "c")))
    again.run(2, newest(spark, ("A", 3, "never")))  # committed already
    assert rows(again.changes()) == [(1, "A"), (1, "B"), (2, "A"), (2, "C")]
    assert {(r.key, r.hash) for r in again.read().collect()} == {("A", "z"), ("C", "c")} | {("B", "y")}


def test_two_writers_of_one_version(spark, monkeypatch):
    """Both read version 1; the second to commit fails and leaves nothing behind."""
    state, other = RunState(spark, scratch_path(spark, "state")), None
    state.run(1, newest(spark, ("A", 1, "x")))
    seen, other = state.committed(), RunState(spark, state.path)
    state.run(2, newest(spark, ("A", 2, "y")))
    monkeypatch.setattr(other, "committed", lambda: seen)
    with pytest.raises(Exception, match="(?i)exist"):
        other.run(3, newest(spark, ("B", 1, "z")))
    assert rows(state.changes()) == [(1, "A"), (2, "A")]
    assert {(r.key, r.hash) for r in state.read().collect()} == {("A", "y")}


def test_a_run_writes_what_it_brings(spark, monkeypatch):
    """Parts hold the keys of their run; merging them changes neither state nor output."""
    monkeypatch.setattr("folioscan.operators.incremental.COMPACT", 2)
    state = RunState(spark, scratch_path(spark, "state"))
    state.run(0, newest(spark, *[(f"K{i}", 1, "x") for i in range(50)]))
    for n in range(1, 6):
        state.run(n, newest(spark, (f"K{n}", 1 + n, "y"), ("K9", 1 + n, "x")))
    committed = state.committed()
    assert [state._parts([p]).count() for p in committed["outputs"]] == [50, 2, 2, 2, 2, 2]
    assert len(committed["parts"]) <= 4
    assert rows(state.changes().filter("run_id > 0")) == [(n, f"K{n}") for n in range(1, 6)]
    assert state.read().count() == 50 and state.read().filter("hash = 'y'").count() == 5
