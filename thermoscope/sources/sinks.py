"""Sinks: trial records, metrics, prediction log, rolling reading log, exports.

Every sink writes from the executors through the DataFrame writer; nothing is
collected to the driver.  Append sinks carry a run timestamp so repeated runs
never overwrite each other, and re-running a batch id overwrites only its own
partition (idempotent on retry).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metrics_long(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Unpivot a metrics record into (key, value) rows."""
    vals = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.inline(F.array(
        *[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in vals])))


def write_metrics(df: DataFrame, path: str) -> None:
    """Append ``key: value`` text lines."""
    metrics_long(df).select(F.format_string("%s: %s", "key", F.col("value").cast("string"))) \
        .write.mode("append").text(path)


def save_trials(trials: DataFrame, path: str, run_ts=None) -> None:
    """Append the trial table as JSON with a run timestamp column."""
    ts = F.lit(run_ts).cast("timestamp") if run_ts is not None else F.current_timestamp()
    trials.withColumn("run_ts", ts).write.mode("append").json(path)


def prediction_log(df: DataFrame, path: str, ts: str = "ts", file: str = "file",
                   value: str = "prediction") -> None:
    """Append ``yyyy-MM-dd HH:mm:ss | file | 12.34°C`` lines."""
    from ..functions.columns import prediction_log_line
    df.select(prediction_log_line(ts, file, value).alias("value")).write.mode("append").text(path)


def write_readings(df: DataFrame, path: str, ts: str = "ts", max_records: int = 100_000) -> None:
    """Reading log partitioned by day, bounded file size."""
    (df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day")
       .option("maxRecordsPerFile", max_records).parquet(path))


def retained_days(daily: DataFrame, day: str = "day", keep_days: int = 28) -> DataFrame:
    """S11 retention: the partitions still inside the retention window."""
    newest = daily.agg(F.max(day)).first()[0]
    return daily.where(F.col(day) > F.date_sub(F.lit(newest), keep_days))


class DayLog:
    """A reading log by day whose readers see whole batches and whole days only.

    A batch is written to a folder of its own per attempt, below it one folder per day.  A commit is a
    small numbered file that lists the live (day, batch, folder) entries; it is written
    aside and renamed, which fails if another writer took the number, so a reader sees the list before or after a
    change and nothing between.  A batch id that is committed again replaces its former entries.  ``retain``
    commits a list without the old days first and deletes their folders after that, once ``grace`` further
    commits have passed, so readers of the last lists can finish.
    """

    def __init__(self, spark: SparkSession, path: str, grace: int = 1):
        self.spark, self.path, self.grace = spark, path.rstrip("/"), grace
        jvm = spark._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._p(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, version: int) -> list[dict]:
        body = self.spark.read.text(f"{self.path}/_commits/{version:010d}.json", wholetext=True).first()[0]
        return json.loads(body)

    def entries(self) -> list[dict]:
        """Live (day, batch, folder) entries: days x batches, not rows."""
        found = self._versions()
        return self._read(found[-1]) if found else []

    def _commit(self, change, tries: int = 20) -> tuple[int, list[dict], list[dict]]:
        for _ in range(tries):
            found = self._versions()
            version = found[-1] + 1 if found else 0
            before = self._read(found[-1]) if found else []
            after = change(before)
            aside = self._p(f"{self.path}/_commits/.{uuid.uuid4().hex}")
            out = self._fs.create(aside, False)
            out.write(bytearray(json.dumps(after).encode()))
            out.close()
            final = self._p(f"{self.path}/_commits/{version:010d}.json")
            if not self._fs.exists(final) and self._fs.rename(aside, final):
                return version, before, after
            self._fs.delete(aside, False)   # another writer was first: look again
        raise RuntimeError(f"{self.path}: no commit after {tries} tries")

    def write(self, df: DataFrame, batch_id: int, ts: str = "ts", max_records: int = 100_000) -> None:
        """Write a batch and make it visible at once; the same batch again replaces the first."""
        folder = f"data/{batch_id}-{uuid.uuid4().hex}"
        (df.withColumn("day", F.date_format(F.to_date(ts), "yyyy-MM-dd")).write.option("maxRecordsPerFile", max_records)
           .partitionBy("day").parquet(f"{self.path}/{folder}"))
        days = [f.getPath().getName()[4:] for f in self._fs.listStatus(self._p(f"{self.path}/{folder}"))
                if f.getPath().getName().startswith("day=")]
        fresh = [{"day": d, "batch": batch_id, "folder": f"{folder}/day={d}"} for d in sorted(days)]
        self._commit(lambda old: [e for e in old if e["batch"] != batch_id] + fresh)
        self._sweep()

    def retain(self, keep_days: int, newest: str | None = None) -> list[str]:
        """Take days before the newest ``keep_days`` (up to ``newest``, or the newest in the log) out; returns them."""
        def recent(old: list[dict]) -> list[dict]:
            last = newest or max((e["day"] for e in old), default=None)
            if last is None:
                return old
            first = (date.fromisoformat(last) - timedelta(days=keep_days - 1)).isoformat()
            return [e for e in old if e["day"] >= first]
        _, before, after = self._commit(recent)
        self._sweep()
        return sorted({e["day"] for e in before} - {e["day"] for e in after})

    def _sweep(self) -> None:
        """Delete the folders that only lists older than the last ``grace`` + 1 name, and those lists."""
        found = self._versions()
        live, old = found[-(self.grace + 1):], found[:-(self.grace + 1)]
        named = {e["folder"] for v in live for e in self._read(v)}
        for v in old:
            for e in self._read(v):
                if e["folder"] not in named:
                    self._fs.delete(self._p(f"{self.path}/{e['folder']}"), True)
            self._fs.delete(self._p(f"{self.path}/_commits/{v:010d}.json"), False)

    def read(self, schema=None) -> DataFrame:
        """All live readings, with their day."""
        found = self.entries()
        if not found:
            if schema is None:
                raise ValueError(f"{self.path} holds no reading: give a schema")
            return self.spark.createDataFrame([], schema).withColumn("day", F.lit(None).cast("string"))
        read = self.spark.read.schema(schema) if schema is not None else self.spark.read
        day = F.regexp_extract(F.col("_metadata.file_path"), "/day=([0-9-]+)/", 1)
        return read.parquet(*[f"{self.path}/{e['folder']}" for e in found]).withColumn("day", day)


def batch_sink(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
               interval: str = "60 seconds", available_now: bool = False):
    """S12/ST10: hand each micro-batch to ``fn(batch_df, batch_id)``.

    The checkpoint makes the batch ids durable, so ``fn`` can key its output
    on the id and a retried batch overwrites instead of duplicating.
    """
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def export_range(df: DataFrame, minutes: int, path: str, ts: str = "ts") -> None:
    """The selected time range as CSV with a header."""
    from ..operators.service import recent
    recent(df, minutes, ts).write.mode("overwrite").option("header", "true").csv(path)
