"""Reading log by day: retried batches, retention and readers in between."""

import datetime as dt

import pytest

from thermoscope.sources.sinks import DayLog


def rows(spark, days, ids):
    t0 = dt.datetime(2024, 3, 1, 12)
    return spark.createDataFrame([(i, t0 + dt.timedelta(days=d)) for i in ids for d in days], "event_id long, ts timestamp")


def seen(log):
    return sorted((r["day"], r["event_id"]) for r in log.read().select("day", "event_id").collect())


def test_retried_batch_and_retention(spark, scratch):
    log = DayLog(spark, f"{scratch}/log")
    log.write(rows(spark, range(3), [1]), 0)
    log.write(rows(spark, range(2, 5), [2]), 1)
    log.write(rows(spark, range(2, 5), [3]), 1)   # the batch again, with other rows: it replaces the first try
    days = [f"2024-03-0{d}" for d in range(1, 6)]
    assert seen(log) == sorted([(d, 1) for d in days[:3]] + [(d, 3) for d in days[2:]])
    before = log.read()                          # a reader that has begun
    assert log.retain(2) == days[:3]
    assert seen(log) == [(d, 3) for d in days[3:]]
    assert before.count() == 6                   # it still finds whole days
    assert log.retain(2) == []
    log.write(rows(spark, [4], [9]), 2)
    kept = {e["folder"].split("/")[1] for e in log.entries()}
    assert len(kept) == 2 and len(log._versions()) == 2


def test_nothing_is_seen_before_the_commit(spark, scratch, monkeypatch):
    log = DayLog(spark, f"{scratch}/log")
    log.write(rows(spark, [0], [1]), 0)
    other = DayLog(spark, f"{scratch}/log")
    monkeypatch.setattr(other, "_commit", lambda change: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        other.write(rows(spark, [0, 1], [2]), 1)
    assert seen(log) == [("2024-03-01", 1)]


def test_two_writers_take_turns(spark, scratch):
    a, b = DayLog(spark, f"{scratch}/log"), DayLog(spark, f"{scratch}/log")
    a.write(rows(spark, [0], [1]), 0)
    stale = b._versions()
    b._versions = lambda first=[stale[:0]]: first.pop() if first else DayLog._versions(b)   # it looks too early once
    b.write(rows(spark, [0], [2]), 1)
    assert seen(a) == [("2024-03-01", 1), ("2024-03-01", 2)]


def test_empty_log(spark, scratch):
    log = DayLog(spark, f"{scratch}/log")
    with pytest.raises(ValueError):
        log.read()
    assert log.read("event_id long, ts timestamp").count() == 0
    log.write(rows(spark, [], []), 0)
    assert log.entries() == [] and log.retain(3) == []
