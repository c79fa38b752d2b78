"""Reading-service queries (P6, P10, A15, A21, A27, T5, T6, W4, W5, F14, ST12 batch twins).

A reading is one ``events`` row: ``user_id`` is the sensor, ``event_type =
'error'`` a failed reading, ``value`` the reading / latency in ms.  Per-sensor
orderings use :func:`ranked` or a salted two-stage top-N, so a sensor that
produces a third of all readings is spread over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import status_flag
from .ranking import ranked

# Service thresholds.
MAX_INFERENCE_MS = 50.0            # slow reading
MIN_SUCCESS_PCT = 95.0             # success rate floor
MAX_ERROR_PCT = 5.0                # error rate ceiling
MIN_READINGS_PER_MIN = 300         # throughput floor
UNHEALTHY_STREAK, RELOAD_STREAK = 5, 10
HISTORY_SIZE = 1000
HEALTH_INTERVAL_S = 30


def readings(events: DataFrame) -> DataFrame:
    """Normalise events into readings: sensor, ts, success, value."""
    return events.select(
        F.col("event_id"), F.col("user_id").alias("sensor"), F.col("ts"),
        (F.col("event_type") != "error").alias("success"), F.col("value"))


def _max_ts(df: DataFrame, ts: str = "ts"):
    return df.agg(F.max(ts)).first()[0]


def recent(df: DataFrame, minutes: int, ts: str = "ts", now=None) -> DataFrame:
    """Rows in the last ``minutes`` before ``now`` (default: newest reading)."""
    now = now if now is not None else _max_ts(df, ts)
    lo = F.lit(now) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return df.where(F.col(ts) >= lo)


def slow_readings(df: DataFrame, ms: float = MAX_INFERENCE_MS) -> DataFrame:
    """P10: successful readings slower than the latency budget, plus invalid ones."""
    return df.where((F.col("success") & (F.col("value") > ms)) | F.col("value").isNull())


def service_stats(df: DataFrame, every: str = "60 seconds", ts: str = "ts") -> DataFrame:
    """Per tumbling window — readings, mean inference time, readings per second."""
    seconds = window_seconds(every)
    return df.groupBy(F.window(ts, every).alias("w")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if("success").cast("bigint").alias("n_ok"),
        F.round(F.avg("value"), 6).alias("avg_ms"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "n", "n_ok", "avg_ms", F.round(F.col("n") / seconds, 6).alias("per_second"))


def window_seconds(every: str) -> int:
    """Length of a window text such as '1 hour'."""
    num, unit = every.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
            "day": 86400, "days": 86400}[unit]
    return int(num) * mult


def rate_alerts(stats: DataFrame) -> DataFrame:
    """A21/ST9: success %, error % and throughput floor per window."""
    succ = F.round(F.col("n_ok") * 100.0 / F.col("n"), 6)
    err = F.round((F.col("n") - F.col("n_ok")) * 100.0 / F.col("n"), 6)
    per_min = F.col("n") * 60.0 / (F.unix_timestamp("window_end") - F.unix_timestamp("window_start"))
    return stats.select(
        "window_start", "n", succ.alias("success_pct"), err.alias("error_pct"),
        (succ < MIN_SUCCESS_PCT).alias("low_success"), (err > MAX_ERROR_PCT).alias("high_error"),
        (per_min < MIN_READINGS_PER_MIN).alias("low_rate"))


def trend(df: DataFrame, bucket: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Per sensor and time bucket — mean reading, mean latency, count."""
    return df.groupBy("sensor", F.window(ts, bucket).alias("w")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.avg(F.when(F.col("success"), F.col("value"))), 6).alias("avg_value"),
        F.round(F.avg("value"), 6).alias("avg_ms"),
    ).select("sensor", F.col("w.start").alias("bucket_start"), "n", "avg_value", "avg_ms")


def latest(df: DataFrame, by: str = "sensor", ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """T5: newest reading per sensor (max_by over (ts, id); partial aggregation)."""
    key = F.struct(F.col(ts), F.col(tiebreak))
    row = F.struct(*[F.col(c) for c in df.columns if c != by])
    return df.groupBy(by).agg(F.max_by(row, key).alias("r")).select(by, "r.*")


def history(df: DataFrame, n: int, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """The newest ``n`` readings overall (top-k, the limit is the feature)."""
    return df.orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(n)


def bounded_history(df: DataFrame, n: int = HISTORY_SIZE, by: str = "sensor",
                    ts: str = "ts", tiebreak: str = "event_id", salts: int | None = None) -> DataFrame:
    """W4/ST7 twin: the newest ``n`` readings per sensor, exact and skew-safe.

    Two-stage top-n: first within (sensor, hash salt) groups — a hot sensor is
    split ``salts`` ways — keeping n rows each, then over the ≤ salts·n
    candidates per sensor.  No global ranking or checkpoint is needed.
    """
    from pyspark.sql import Window
    from ..session import shuffle_partitions
    salts = salts or shuffle_partitions(df.sparkSession)
    order = [F.col(ts).desc(), F.col(tiebreak).desc()]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(tiebreak)), F.lit(salts)))
    first = salted.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__salt").orderBy(*order)))
    cand = first.where(F.col("__r") <= n).drop("__r", "__salt")
    final = cand.withColumn("recency", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return final.where(F.col("recency") <= n)


def failure_streaks(df: DataFrame, by: str = "sensor", ts: str = "ts",
                    tiebreak: str = "event_id", min_len: int = UNHEALTHY_STREAK) -> DataFrame:
    """W5/ST8 twin: runs of consecutive failed readings (gaps and islands).

    island = row number among all readings − number of failures so far; both
    come from one skew-safe :func:`ranked` pass (the failure count is a
    running sum in the same order), so the data is shuffled once.
    """
    r = ranked(df, [ts, tiebreak], [by], name="__rn_all",
               running={"__rn_fail": (~F.col("success")).cast("long")})
    isl = r.where(~F.col("success")).withColumn("island", F.col("__rn_all") - F.col("__rn_fail"))
    s = isl.groupBy(by, "island").agg(
        F.count(F.lit(1)).cast("bigint").alias("length"),
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    return s.where(F.col("length") >= min_len).select(
        by, "start_ts", "end_ts", "length", streak_level(F.col("length")).alias("level"))


def streak_level(length: Column) -> Column:
    return F.when(length >= RELOAD_STREAK, "reload_model") \
        .when(length >= UNHEALTHY_STREAK, "reset_sensor").otherwise("ok")


def health(df: DataFrame, by: str = "sensor", ts: str = "ts", tiebreak: str = "event_id",
           now=None) -> DataFrame:
    """ST12/F14 twin: per sensor last-seen age, failure share, trailing failures, status."""
    now = now if now is not None else _max_ts(df, ts)
    key = F.struct(F.col(ts), F.col(tiebreak))
    per = df.groupBy(by).agg(
        F.max(ts).alias("last_ts"), F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if(~F.col("success")).cast("bigint").alias("n_failed"),
        F.max(F.when(F.col("success"), key)).alias("__last_ok"))
    trail = df.join(per.select(by, "__last_ok"), by) \
        .where(~F.col("success") & (F.col("__last_ok").isNull() | (key > F.col("__last_ok")))) \
        .groupBy(by).agg(F.count(F.lit(1)).cast("bigint").alias("trailing_failures"))
    out = per.join(trail, by, "left").withColumn(
        "trailing_failures", F.coalesce("trailing_failures", F.lit(0).cast("bigint")))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6
    return out.select(
        by, "last_ts", "n", "n_failed", "trailing_failures",
        F.round(age, 6).alias("age_s"), status_flag(age).alias("status"),
        F.when(F.col("trailing_failures") >= UNHEALTHY_STREAK, "failed")
         .when(age > 2 * HEALTH_INTERVAL_S, "not running").otherwise("healthy").alias("health"))


def batch_numbers(df: DataFrame, size: int = 100, ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """Ingestion batch number = ceil(row_number / size) in (ts, id) order."""
    r = ranked(df, [ts, tiebreak], name="__rn")
    return r.withColumn("batch_no", F.ceil(F.col("__rn") / size).cast("bigint")).drop("__rn")
