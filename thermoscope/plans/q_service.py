"""Reading-service queries over ``events`` (readings stream, batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import service as sv
from ..sources.tables import load
from .catalog import query

_READINGS_SQL = """
r AS (SELECT event_id, user_id AS sensor, ts, event_type <> 'error' AS success, value FROM events)"""


def _readings(spark, sf_dir):
    return sv.readings(load(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value"))


@query("a15_service_stats_60s", f"""
WITH {_READINGS_SQL.strip()}
SELECT time_bucket(INTERVAL '60 seconds', ts) AS window_start,
       time_bucket(INTERVAL '60 seconds', ts) + INTERVAL '60 seconds' AS window_end,
       CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE success) AS BIGINT) AS n_ok,
       round(avg(value), 6) AS avg_ms, round(count(*) / 60, 6) AS per_second
FROM r GROUP BY 1, 2
""")
def a15_service_stats_60s(spark, sf_dir):
    return sv.service_stats(_readings(spark, sf_dir), "60 seconds")


@query("a21_rate_alerts", f"""
WITH {_READINGS_SQL.strip()},
s AS (SELECT time_bucket(INTERVAL '60 seconds', ts) AS window_start, count(*) AS n,
             count(*) FILTER (WHERE success) AS n_ok FROM r GROUP BY 1)
SELECT window_start, CAST(n AS BIGINT) AS n, round(n_ok * 100.0 / n, 6) AS success_pct,
       round((n - n_ok) * 100.0 / n, 6) AS error_pct,
       round(n_ok * 100.0 / n, 6) < 95 AS low_success, round((n - n_ok) * 100.0 / n, 6) > 5 AS high_error,
       n * 60.0 / 60 < 300 AS low_rate
FROM s
""")
def a21_rate_alerts(spark, sf_dir):
    return sv.rate_alerts(sv.service_stats(_readings(spark, sf_dir), "60 seconds"))


@query("a27_trend_hourly", f"""
WITH {_READINGS_SQL.strip()}
SELECT sensor, time_bucket(INTERVAL '1 hour', ts) AS bucket_start, CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN success THEN value END), 6) AS avg_value, round(avg(value), 6) AS avg_ms
FROM r GROUP BY 1, 2
""")
def a27_trend_hourly(spark, sf_dir):
    return sv.trend(_readings(spark, sf_dir), "1 hour")


@query("p6_recent_60min", f"""
WITH {_READINGS_SQL.strip()}
SELECT event_id, sensor, ts, value FROM r
WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL 60 MINUTE
""")
def p6_recent_60min(spark, sf_dir):
    return sv.recent(_readings(spark, sf_dir), 60).select("event_id", "sensor", "ts", "value")


@query("p10_slow_readings", f"""
WITH {_READINGS_SQL.strip()}
SELECT event_id, sensor, ts, value FROM r WHERE (success AND value > 50.0) OR value IS NULL
""")
def p10_slow_readings(spark, sf_dir):
    return sv.slow_readings(_readings(spark, sf_dir)).select("event_id", "sensor", "ts", "value")


@query("t5_latest_per_sensor", f"""
WITH {_READINGS_SQL.strip()}
SELECT sensor, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts,
       arg_max(success, (ts, event_id)) AS success, arg_max(value, (ts, event_id)) AS value
FROM r GROUP BY sensor
""")
def t5_latest_per_sensor(spark, sf_dir):
    return sv.latest(_readings(spark, sf_dir))


@query("t6_last_n_readings", f"""
WITH {_READINGS_SQL.strip()}
SELECT event_id, sensor, ts, success, value FROM r ORDER BY ts DESC, event_id DESC LIMIT 100
""")
def t6_last_n_readings(spark, sf_dir):
    return sv.history(_readings(spark, sf_dir), 100)


@query("w4_bounded_history", f"""
WITH {_READINGS_SQL.strip()},
h AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts DESC, event_id DESC) AS recency FROM r)
SELECT sensor, CAST(count(*) AS BIGINT) AS n_kept, min(ts) AS oldest_kept, max(ts) AS newest
FROM h WHERE recency <= 1000 GROUP BY sensor
""")
def w4_bounded_history(spark, sf_dir):
    h = sv.bounded_history(_readings(spark, sf_dir), 1000)
    return h.groupBy("sensor").agg(F.count(F.lit(1)).cast("bigint").alias("n_kept"),
                                   F.min("ts").alias("oldest_kept"), F.max("ts").alias("newest"))


@query("w5_failure_streaks", f"""
WITH {_READINGS_SQL.strip()},
a AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts, event_id) AS rn_all FROM r),
f AS (SELECT *, rn_all - row_number() OVER (PARTITION BY sensor ORDER BY ts, event_id) AS island
      FROM a WHERE NOT success),
s AS (SELECT sensor, island, CAST(count(*) AS BIGINT) AS length, min(ts) AS start_ts, max(ts) AS end_ts
      FROM f GROUP BY sensor, island)
SELECT sensor, start_ts, end_ts, length,
       CASE WHEN length >= 10 THEN 'reload_model' WHEN length >= 5 THEN 'reset_sensor' ELSE 'ok' END AS level
FROM s WHERE length >= 2
""")
def w5_failure_streaks(spark, sf_dir):
    # min_len 2 so the sparse driver table yields streaks; levels use 5 / 10
    return sv.failure_streaks(_readings(spark, sf_dir), min_len=2)


@query("st12_health", f"""
WITH {_READINGS_SQL.strip()},
p AS (SELECT sensor, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n,
             CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS n_failed,
             max((ts, event_id)) FILTER (WHERE success) AS last_ok FROM r GROUP BY sensor),
t AS (SELECT r.sensor, CAST(count(*) AS BIGINT) AS trailing_failures FROM r JOIN p USING (sensor)
      WHERE NOT r.success AND (p.last_ok IS NULL OR (r.ts, r.event_id) > p.last_ok) GROUP BY r.sensor),
j AS (SELECT p.*, coalesce(t.trailing_failures, 0) AS trailing_failures,
             (epoch_us((SELECT max(ts) FROM r)) - epoch_us(p.last_ts)) / 1e6 AS age
      FROM p LEFT JOIN t USING (sensor))
SELECT sensor, last_ts, n, n_failed, CAST(trailing_failures AS BIGINT) AS trailing_failures, round(age, 6) AS age_s,
       CASE WHEN age <= 300 THEN 'online' WHEN age <= 1800 THEN 'warning' ELSE 'offline' END AS status,
       CASE WHEN trailing_failures >= 5 THEN 'failed' WHEN age > 60 THEN 'not running' ELSE 'healthy' END AS health
FROM j
""")
def st12_health(spark, sf_dir):
    return sv.health(_readings(spark, sf_dir))


@query("s12_ingest_batches", """
WITH b AS (SELECT event_id, ts, CAST(ceil(row_number() OVER (ORDER BY ts, event_id) / 100) AS BIGINT) AS batch_no FROM events)
SELECT batch_no, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY batch_no
""")
def s12_ingest_batches(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "ts")
    b = sv.batch_numbers(e, 100)
    return b.groupBy("batch_no").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                     F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("s10_prediction_log", """
SELECT event_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | live-vna' || strftime(ts, '%y%m%d_%H%M%S') || '.csv | '
         || printf('%.2f', value) || '°C' AS line
FROM events WHERE event_type <> 'error'
""")
def s10_prediction_log(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    ok = e.where(F.col("event_type") != "error")
    return ok.select("event_id", fc.prediction_log_line("ts", fc.sweep_file_name("ts"), "value").alias("line"))


@query("f8_file_name_timestamp", """
WITH f AS (SELECT event_id, 'live-vna' || strftime(ts, '%y%m%d_%H%M%S') || '.csv' AS file FROM events)
SELECT event_id, file, strptime(regexp_extract(file, '(\\d{6}_\\d{6})', 1), '%y%m%d_%H%M%S') AS file_ts FROM f
""")
def f8_file_name_timestamp(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "ts")
    f = e.select("event_id", fc.sweep_file_name("ts").alias("file"))
    return f.select("event_id", "file", fc.sweep_time("file").cast("timestamp_ntz").alias("file_ts"))


@query("f7_props_json", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k,
       round(avg(CAST(json_extract_string(props, '$.k') AS INTEGER)), 6) AS avg_k
FROM events GROUP BY event_type
""")
def f7_props_json(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_type", "props")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                       F.sum(k).cast("bigint").alias("sum_k"),
                                       F.round(F.avg(k), 6).alias("avg_k"))


@query("f7_reading_json_roundtrip", """
SELECT event_id, round(value, 3) AS temp_c, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
       CAST(42 AS BIGINT) AS features_processed
FROM events
""")
def f7_reading_json_roundtrip(spark, sf_dir):
    """Each reading serialised to the reading JSON (temp 3 dp) and parsed back."""
    e = load(spark, sf_dir, "events", "event_id", "ts", "value")
    js = e.select("event_id", fc.reading_json("ts", F.col("value"), F.lit("GOOD"), F.col("value"),
                                              F.lit(42).cast("bigint")).alias("js"))
    back = js.select("event_id", fc.from_reading_json("js").alias("r"))
    return back.select("event_id", F.col("r.temp_c").alias("temp_c"), F.col("r.timestamp").alias("timestamp"),
                       F.col("r.features_processed").alias("features_processed"))


@query("f12_artifact_paths", """
SELECT user_id AS sensor, 'readings/sensor' || CAST(user_id AS VARCHAR) || '/reading_' || strftime(max(ts), '%Y%m%d_%H%M%S') || '.json' AS path
FROM events GROUP BY user_id
""")
def f12_artifact_paths(spark, sf_dir):
    e = load(spark, sf_dir, "events", "user_id", "ts")
    last = e.groupBy(F.col("user_id").alias("sensor")).agg(F.max("ts").alias("ts"))
    return last.select("sensor", fc.artifact_path("readings/sensor%s/reading_%s.json", "sensor", "ts").alias("path"))


@query("s11_log_retention", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n FROM d WHERE day > (SELECT max(day) FROM d) - INTERVAL 28 DAY
""")
def s11_log_retention(spark, sf_dir):
    from ..sources.sinks import retained_days
    e = load(spark, sf_dir, "events", "ts")
    daily = e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    kept = retained_days(daily, "day", 28)
    return kept.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("s11_day_log", """
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY 1)
SELECT day, CAST(n AS BIGINT) AS n, CAST(ids AS BIGINT) AS ids FROM d
WHERE CAST(day AS DATE) > (SELECT max(CAST(day AS DATE)) FROM d) - INTERVAL 7 DAY
""")
def s11_day_log(spark, sf_dir):
    """All events logged in three batches, one of them written twice, then cut to the newest seven days."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import DayLog
    e = load(spark, sf_dir, "events", "event_id", "ts")
    log = DayLog(spark, f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}")
    for b in (0, 1, 1, 2):
        log.write(e.where(F.pmod("event_id", F.lit(3)) == b), b)
    log.retain(7)
    return log.read().groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").cast("long").alias("ids"))
