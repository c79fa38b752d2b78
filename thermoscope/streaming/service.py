"""Reading-stream jobs (ST6–ST10, ST12) with event-time watermarks.

Readings arrive as ``(event_id, sensor, ts, success, value)``.  Parquet
timestamps come in as TIMESTAMP_NTZ, which watermarks reject, so the stream
casts them to TIMESTAMP under the UTC session.  Rows older than the watermark
are dropped by the stateful operator and counted in the query progress
(``stateOperators[].numRowsDroppedByWatermark``).  Spark judges lateness
against the watermark of the previous micro-batch, so a row is dropped once
the watermark that makes it late has been committed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.service import HISTORY_SIZE, RELOAD_STREAK, UNHEALTHY_STREAK, window_seconds

WATERMARK = "1 minute"
IDLE = "30 days"   # a sensor silent for so long is forgotten


def event_stream(spark: SparkSession, directory: str, name: str = "events.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Readings from parquet files in ``directory`` (file source, schema declared)."""
    schema = spark.read.parquet(f"{directory.rstrip('/')}/{name}").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    e = r.parquet(directory)
    return e.select(F.col("event_id"), F.col("user_id").alias("sensor"),
                    F.col("ts").cast("timestamp").alias("ts"),
                    (F.col("event_type") != "error").alias("success"), F.col("value"))


def late_batches(query) -> list[dict]:
    """Micro-batches whose input held rows older than the watermark (they were dropped).

    Uses the query progress only: event-time min vs watermark per batch, plus
    the state operators' own drop counters.
    """
    out = []
    for p in query.recentProgress:
        et = p.get("eventTime") or {}
        dropped = sum(op.get("numRowsDroppedByWatermark", 0) for op in p.get("stateOperators", []))
        if ("min" in et and "watermark" in et and et["min"] < et["watermark"]) or dropped:
            out.append({"batch_id": p["batchId"], "min": et.get("min"), "watermark": et.get("watermark"),
                        "dropped_by_state": dropped})
    return out


def windowed_stats(readings: DataFrame, every: str = "60 seconds", watermark: str = WATERMARK) -> DataFrame:
    """ST6: A15 per tumbling event-time window, late rows beyond the watermark dropped."""
    seconds = window_seconds(every)
    return readings.withWatermark("ts", watermark).groupBy(F.window("ts", every).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_ok"), F.avg("value").alias("avg_ms")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "n", "n_ok", F.round("avg_ms", 6).alias("avg_ms"),
             F.round(F.col("n") / seconds, 6).alias("per_second"))


def rate_alert_stream(stats: DataFrame) -> DataFrame:
    """ST9: windows breaking the success / error / throughput floors."""
    from ..operators.service import rate_alerts
    a = rate_alerts(stats)
    return a.where(F.col("low_success") | F.col("high_error") | F.col("low_rate"))


_STREAK_OUT = "sensor long, alert_ts timestamp, streak long, level string"
# failures in a row up to the watermark, the readings after it, and the alerts given for those
_STREAK_STATE = ("streak long, ts array<timestamp>, ids array<long>, ok array<boolean>, "
                 "sent array<struct<ts:timestamp,id:long,level:string>>")


def _run_lengths(ok: np.ndarray, before: int) -> np.ndarray:
    """Consecutive failures up to each reading, ``before`` of them ahead of the first."""
    n = np.arange(1, len(ok) + 1)
    last_ok = np.maximum.accumulate(np.where(ok, n, 0))
    return np.where(ok, 0, n - last_ok + np.where(last_ok == 0, before, 0))


def _expire(state: GroupState, newest: pd.Timestamp, idle_ms: int) -> None:
    """Let the state go when the watermark is ``idle_ms`` past the sensor's newest reading."""
    state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)


def _streaks(key, pdfs: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    streak, ts, ids, ok, sent = state.get if state.exists else (0, [], [], [], [])
    mark = pd.Timestamp(max(0, state.getCurrentWatermarkMs()), unit="ms")
    fresh = [p.loc[p["ts"] >= mark, ["ts", "event_id", "success"]] for p in pdfs]
    held = pd.DataFrame({"ts": pd.to_datetime(pd.Series(list(ts), dtype="datetime64[ns]")), "event_id": list(ids),
                         "success": list(ok)})
    rows = pd.concat([p for p in [held, *fresh] if len(p)] or [held]).sort_values(["ts", "event_id"])
    good = rows["success"].to_numpy(dtype=bool)
    runs = _run_lengths(good, int(streak))
    # an alert is known by its reading and level: two readings of one time can each give one
    given = {(pd.Timestamp(g["ts"]), int(g["id"]), g["level"]) for g in sent}
    hit = np.flatnonzero((runs == UNHEALTHY_STREAK) | (runs == RELOAD_STREAK))
    times, events = rows["ts"].to_list(), rows["event_id"].to_list()
    found = [(times[i], int(events[i]), "reset_sensor" if runs[i] == UNHEALTHY_STREAK else "reload_model", int(runs[i]))
             for i in hit.tolist()]
    out = [(key[0], t, n, level) for t, e, level, n in found if (t, e, level) not in given]
    # readings before the watermark can no longer change: they become the starting streak
    cut = int((rows["ts"] < mark).sum())
    settled = int(runs[cut - 1]) if cut else int(streak)
    keep = rows.iloc[cut:]
    state.update((settled, [t.to_pydatetime() for t in keep["ts"]], [int(i) for i in keep["event_id"]],
                  [bool(x) for x in keep["success"]],
                  [{"ts": t.to_pydatetime(), "id": e, "level": level}
                   for t, e, level in sorted(given | {f[:3] for f in found}) if t >= mark]))
    if len(rows):
        _expire(state, rows["ts"].iloc[-1], idle_ms)
    if out:
        yield pd.DataFrame(out, columns=["sensor", "alert_ts", "streak", "level"])


def streak_alerts(readings: DataFrame, watermark: str = WATERMARK, idle: str = IDLE) -> DataFrame:
    """ST8: one alert when a sensor's consecutive failures reach 5 and 10, in event-time order.

    Readings newer than the watermark stay in the state, so one that arrives out
    of order still counts at its place; alerts already given are not repeated.  A sensor that
    stays silent for ``idle`` is forgotten; its streak then starts anew.
    """
    idle_ms = int(window_seconds(idle) * 1000)

    def run(key, pdfs, state):
        yield from _streaks(key, pdfs, state, idle_ms)
    return readings.withWatermark("ts", watermark).groupBy("sensor").applyInPandasWithState(
        run, _STREAK_OUT, _STREAK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


_HIST_OUT = "sensor long, n_kept long, oldest_kept timestamp, newest timestamp"
_HIST_STATE = "ts array<timestamp>, ids array<long>"


def _history(key, pdfs: Iterator[pd.DataFrame], state: GroupState, idle_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    ts, ids = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
    rows = pd.concat(list(pdfs))
    merged = pd.DataFrame({"ts": list(ts) + list(rows["ts"]), "id": list(ids) + list(rows["event_id"])})
    merged = merged.sort_values(["ts", "id"]).tail(HISTORY_SIZE)   # ring buffer of the newest 1000
    state.update((list(merged["ts"]), [int(i) for i in merged["id"]]))
    _expire(state, pd.Timestamp(merged["ts"].iloc[-1]), idle_ms)
    yield pd.DataFrame({"sensor": [key[0]], "n_kept": [len(merged)], "oldest_kept": [merged["ts"].iloc[0]],
                        "newest": [merged["ts"].iloc[-1]]})


def bounded_history(readings: DataFrame, watermark: str = WATERMARK, idle: str = IDLE) -> DataFrame:
    """ST7: per-sensor state holding the newest 1000 readings; a sensor silent for ``idle`` is forgotten."""
    idle_ms = int(window_seconds(idle) * 1000)

    def run(key, pdfs, state):
        yield from _history(key, pdfs, state, idle_ms)
    return readings.withWatermark("ts", watermark).groupBy("sensor").applyInPandasWithState(
        run, _HIST_OUT, _HIST_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def health_stream(readings: DataFrame) -> DataFrame:
    """ST12: per-sensor last seen and failure counts (complete mode aggregate)."""
    return readings.groupBy("sensor").agg(
        F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("success")).alias("n_failed"))


class ProgressRecorder(StreamingQueryListener):
    """X5 for streams: a listener keeping one record per micro-batch.

    Records (query name, batch id, input rows, rows/s, watermark, rows dropped
    by the watermark).  Register with ``spark.streams.addListener``.
    """

    def __init__(self):
        super().__init__()
        self.batches: list[dict] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        dropped = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self.batches.append({"name": p.name, "batch_id": p.batchId, "input_rows": p.numInputRows,
                             "rows_per_second": p.processedRowsPerSecond,
                             "watermark": (p.eventTime or {}).get("watermark"), "dropped_late": dropped})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
