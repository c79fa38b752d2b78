"""Structured Streaming jobs against their batch twins (availableNow triggers)."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from thermoscope.operators import service as sv
from thermoscope.streaming import service as ss
from thermoscope.streaming import sweeps as sw


def _write_sweep(path, n=16, seed=0, drop=None, text=False):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"Frequency(Hz)": 45e6 + np.arange(n) * 1e6, "Return Loss(dB)": rng.normal(size=n),
                       "Phase(deg)": rng.normal(size=n), "Xs": rng.normal(size=n)})
    if drop:
        df = df.drop(columns=[drop])
    if text:
        df["Xs"] = df["Xs"].astype(object)
        df.loc[3, "Xs"] = "abc"
    df.to_csv(path, index=False)
    return df


def test_sweep_stream_scores_each_file_once(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    good = [_write_sweep(os.path.join(src, f"live-vna240101_00000{i}.csv"), seed=i) for i in range(3)]
    _write_sweep(os.path.join(src, "live-vna240101_000010.csv"), drop="Xs")
    _write_sweep(os.path.join(src, "live-vna240101_000011.csv"), text=True)
    _write_sweep(os.path.join(src, "notes.txt"))
    sink, quarantine, ckpt = (os.path.join(scratch, d) for d in ("out", "bad", "ckpt"))
    scorer = sw.linear_scorer([1.0] * 64, 0.5)

    q = sw.score_stream(sw.sweep_stream(spark, src), scorer, sink, quarantine, ckpt,
                        expected_points=16, available_now=True)
    q.awaitTermination(120)
    out = spark.read.parquet(sink).orderBy("file").toPandas()
    assert len(out) == 3
    for i, row in enumerate(out.itertuples()):
        want = good[i].to_numpy().T.ravel().sum() + 0.5   # freq ‖ RL ‖ phase ‖ Xs, summed
        assert row.prediction == pytest.approx(want)
        assert row.ts == pd.Timestamp(f"2024-01-01 00:00:0{i}")
    bad = spark.read.parquet(quarantine).orderBy("file").toPandas()
    assert list(bad["reason"]) == ["missing column", "non-numeric value"]

    # a restart on the same checkpoint sees nothing new (once per file)
    q2 = sw.score_stream(sw.sweep_stream(spark, src), scorer, sink, quarantine, ckpt,
                         expected_points=16, available_now=True)
    q2.awaitTermination(120)
    assert spark.read.parquet(sink).count() == 3


def test_window_stats_equal_batch_twin(spark):
    readings = ss.event_stream(spark, SF_SMALL)
    q = (ss.windowed_stats(readings).writeStream.outputMode("update").format("memory")
         .queryName("win_twin").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM win_twin").toPandas()
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    twin = sv.service_stats(sv.readings(e).withColumn("ts", F.col("ts").cast("timestamp"))).toPandas()
    key = ["window_start"]
    got = got.sort_values(key).reset_index(drop=True)
    twin = twin.sort_values(key).reset_index(drop=True)
    assert len(got) == len(twin)
    assert (got["n"].to_numpy() == twin["n"].to_numpy()).all()
    assert np.allclose(got["avg_ms"], twin["avg_ms"])


def _events_file(path, rows):
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).to_parquet(
        path, coerce_timestamps="us", allow_truncated_timestamps=True)


def test_streak_alerts_and_late_rows(spark, scratch):
    src = os.path.join(scratch, "events")
    os.makedirs(src)
    t0 = dt.datetime(2024, 1, 1)
    pattern = ["view"] + ["error"] * 5 + ["view"] + ["error"] * 10
    rows = [(i, t0 + dt.timedelta(seconds=i), 7, p, 1.0, "{}") for i, p in enumerate(pattern)]
    _events_file(os.path.join(src, "a.parquet"), rows)
    stream = ss.event_stream(spark, src, name="*.parquet", max_files_per_trigger=1)
    q = (ss.streak_alerts(stream).writeStream.outputMode("append").format("memory")
         .queryName("streaks").trigger(availableNow=True).start())
    q.awaitTermination(120)
    alerts = spark.sql("SELECT * FROM streaks ORDER BY alert_ts").toPandas()
    # each threshold crossing alerts once: first run hits 5; second run hits 5, then 10
    assert list(alerts["streak"]) == [5, 5, 10]
    assert list(alerts["level"]) == ["reset_sensor", "reset_sensor", "reload_model"]


def _files(src, files):
    os.makedirs(src)
    for i, rows in enumerate(files):
        path = os.path.join(src, f"{i}.parquet")
        _events_file(path, rows)
        os.utime(path, (1_700_000_000 + 100 * i,) * 2)   # the file source orders by modification time
    return src


def _alerts(spark, stream, name, **options):
    q = (ss.streak_alerts(stream, **options).writeStream.outputMode("append").format("memory")
         .queryName(name).trigger(availableNow=True).start())
    q.awaitTermination(180)
    return spark.sql(f"SELECT * FROM {name} ORDER BY alert_ts, streak").toPandas()


def test_alerts_of_one_time_in_two_batches(spark, scratch):
    """Readings of one timestamp: the fifth and the tenth failure each alert, though they come in different batches."""
    t0 = dt.datetime(2024, 1, 1)
    fail = lambda i: (i, t0, 7, "error", 1.0, "{}")
    src = _files(os.path.join(scratch, "same"), [[fail(i) for i in range(5)], [fail(i) for i in range(5, 10)]])
    got = _alerts(spark, ss.event_stream(spark, src, name="*.parquet", max_files_per_trigger=1), "same_time")
    assert list(got["level"]) == ["reset_sensor", "reload_model"]


def test_silent_sensor_is_forgotten(spark, scratch):
    """Four failures, two days without a word, one more failure: a streak only where the state is still held."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda i, days, sensor, kind: (i, t0 + dt.timedelta(days=days, seconds=i), sensor, kind, 1.0, "{}")
    files = [[at(i, 0, 7, "error") for i in range(4)] + [at(9, 0, 8, "view")],
             [at(10, 2, 8, "view")], [at(11, 2.1, 8, "view")], [at(12, 2.2, 8, "view")], [at(13, 2.3, 7, "error"), at(14, 2.3, 8, "view")]]
    src = _files(os.path.join(scratch, "silent"), files)
    stream = lambda: ss.event_stream(spark, src, name="*.parquet", max_files_per_trigger=1)
    assert list(_alerts(spark, stream(), "held")["streak"]) == [5]
    assert len(_alerts(spark, stream(), "forgotten", idle="1 day")) == 0
    q = (ss.bounded_history(stream(), idle="1 day").writeStream.outputMode("update").format("memory")
         .queryName("short").trigger(availableNow=True).start())
    q.awaitTermination(180)
    last = spark.sql("SELECT sensor, n_kept FROM short").toPandas()
    assert last[last.sensor == 7]["n_kept"].max() == 4 and last[last.sensor == 7]["n_kept"].iloc[-1] == 1


def test_late_rows_dropped_and_counted(spark, scratch):
    src = os.path.join(scratch, "late")
    os.makedirs(src)
    t0 = dt.datetime(2024, 1, 1, 12)
    files = {"1.parquet": [(1, t0, 1, "view", 1.0, "{}"), (2, t0 + dt.timedelta(minutes=10), 1, "view", 2.0, "{}")],
             "2.parquet": [(3, t0 + dt.timedelta(minutes=20), 1, "view", 3.0, "{}")],
             "3.parquet": [(4, t0 - dt.timedelta(minutes=30), 1, "view", 4.0, "{}")]}
    for i, (name, rows) in enumerate(files.items()):
        _events_file(os.path.join(src, name), rows)
        # the file source orders by modification time: make the late file arrive last
        os.utime(os.path.join(src, name), (1_700_000_000 + 100 * i,) * 2)
    stream = ss.event_stream(spark, src, name="*.parquet", max_files_per_trigger=1)
    q = (ss.windowed_stats(stream).writeStream.outputMode("append").format("memory")
         .queryName("late").trigger(availableNow=True).start())
    q.awaitTermination(120)
    # late rows are judged against the previous batch's watermark: the third batch drops it
    late = ss.late_batches(q)
    assert sum(b["dropped_by_state"] for b in late) == 1
    starts = [r["window_start"] for r in spark.sql("SELECT window_start FROM late").collect()]
    assert dt.datetime(2024, 1, 1, 11, 30) not in starts


def test_bounded_history_equals_batch_twin(spark):
    readings = ss.event_stream(spark, SF_SMALL)
    q = (ss.bounded_history(readings).writeStream.outputMode("update").format("memory")
         .queryName("hist").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT sensor, max(n_kept) AS n FROM hist GROUP BY sensor").toPandas().set_index("sensor")
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    twin = sv.bounded_history(sv.readings(e)).groupBy("sensor").count().toPandas().set_index("sensor")
    assert (got["n"].sort_index() == twin["count"].sort_index()).all()


def test_running_totals(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    for i in range(2):
        _write_sweep(os.path.join(src, f"live-vna240101_00000{i}.csv"), seed=i)
    sink = os.path.join(scratch, "out")
    q = sw.score_stream(sw.sweep_stream(spark, src), sw.linear_scorer([1.0] * 64, 0.0), sink,
                        os.path.join(scratch, "bad"), os.path.join(scratch, "ck"), available_now=True)
    q.awaitTermination(120)
    scored = spark.readStream.schema(sw.PREDICTION_SCHEMA).parquet(sink)
    t = (sw.running_totals(scored).writeStream.outputMode("complete").format("memory")
         .queryName("totals").trigger(availableNow=True).start())
    t.awaitTermination(120)
    row = spark.sql("SELECT * FROM totals").first()
    assert row["n_scored"] == 2


def test_stream_tree_scorer(spark, scratch):
    src = os.path.join(scratch, "in")
    os.makedirs(src)
    frames = [_write_sweep(os.path.join(src, f"live-vna240101_00000{i}.csv"), seed=i) for i in range(3)]
    # one split on position 16 (first return-loss point): ≤ 0 → 1.0, else 2.0
    nodes = spark.createDataFrame(pd.DataFrame({
        "tree_id": [0, 0, 0], "node_id": [0, 1, 2], "feature": [16, -1, -1], "threshold": [0.0, 0.0, 0.0],
        "left": [1, -1, -1], "right": [2, -1, -1], "value": [0.0, 1.0, 2.0], "is_leaf": [False, True, True],
        "weight": [1.0, 1.0, 1.0]}))
    sink = os.path.join(scratch, "out")
    q = sw.score_stream(sw.sweep_stream(spark, src), sw.tree_scorer(nodes), sink, os.path.join(scratch, "bad"),
                        os.path.join(scratch, "ck"), expected_points=16, available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(sink).orderBy("file").toPandas()
    want = [1.0 if f["Return Loss(dB)"].iloc[0] <= 0 else 2.0 for f in frames]
    assert list(got["prediction"]) == want


def test_progress_listener_records_batches(spark):
    import time
    rec = ss.ProgressRecorder()
    spark.streams.addListener(rec)
    try:
        q = (ss.windowed_stats(ss.event_stream(spark, SF_SMALL)).writeStream.outputMode("update")
             .format("memory").queryName("listened").trigger(availableNow=True).start())
        q.awaitTermination(120)
        for _ in range(50):           # listener events arrive asynchronously
            if any(b["name"] == "listened" for b in rec.batches):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(rec)
    mine = [b for b in rec.batches if b["name"] == "listened"]
    assert mine and sum(b["input_rows"] for b in mine) == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
