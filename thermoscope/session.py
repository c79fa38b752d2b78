"""Spark session helper and cluster-safe settings.

The engine never hard-codes cluster topology.  On a real cluster the
session comes from the launcher (spark-submit / notebook); this helper only
fills in settings that are unset, so tests and local runs get sane values
without overriding what an operator configured.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  UTC keeps timestamp arithmetic identical on
# every executor; ANSI makes bad casts fail loudly (we use try_cast where a
# failure is data, not a bug); AQE re-plans joins and partition counts at
# runtime from real sizes.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "thermoscope", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("SPARK_MASTER")
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    # checkpointed intermediates are deleted once their DataFrame is garbage-collected
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``thermoscope`` importable in executor Python workers.

    Pandas UDFs, ``mapInPandas`` and ``applyInPandas`` functions are pickled by
    reference to this package, so workers must be able to import it.  On a
    cluster the launcher usually passes it with ``--py-files``; otherwise the
    package is zipped once on the driver and added with ``addPyFile`` (Spark
    serves the file to every executor).
    """
    import importlib.util
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_thermoscope_shipped", False):
        return
    if spark.conf.get("spark.submit.pyFiles", "") and "thermoscope" in spark.conf.get("spark.submit.pyFiles", ""):
        sc._thermoscope_shipped = True
        return
    pkg = os.path.dirname(os.path.abspath(importlib.util.find_spec("thermoscope").origin))
    out = tempfile.mkdtemp(prefix="thermoscope-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "thermoscope"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir="thermoscope")
    sc.addPyFile(archive)
    sc._thermoscope_shipped = True


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Fill in runtime settings that the launcher left unset; what it set stays.

    The time zone alone is always UTC: results must not depend on the host.
    """
    launched = spark.sparkContext.getConf()
    for k, v in _DEFAULTS.items():
        if k in ("spark.ui.enabled", "spark.ui.showConsoleProgress"):
            continue
        if k != "spark.sql.session.timeZone" and launched.contains(k):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave it
            pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; we read it
    and never replace it.  Only a local master without one (tests) gets a
    scratch folder of its own; elsewhere a machine-local folder would be lost
    to the other executors, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="thermoscope-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_table(df):
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    The folder of a session's tables goes when the application ends.
    """
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables"
    if base not in _TABLE_FOLDERS:
        _TABLE_FOLDERS.add(base)
        atexit.register(_remove_folder, spark, base)
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_TABLE_FOLDERS: set[str] = set()


class TableStore:
    """Named tables of one job in the shared folder, dropped when no later step reads them.

    What is left goes with ``close`` or when the application ends.
    """

    def __init__(self, spark):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self._at_exit = lambda: _remove_folder(spark, self.base)
        atexit.register(self._at_exit)

    def write(self, df, name: str):
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _remove_folder(self.spark, f"{self.base}/{name}")

    def close(self) -> None:
        _remove_folder(self.spark, self.base)
        atexit.unregister(self._at_exit)


def _remove_folder(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be closed
        pass


def materialize(df):
    """One stored copy of ``df`` in the shared folder.

    Used where one derived table (e.g. features parsed from whole texts)
    feeds several jobs: the expensive pass runs once, and a lost executor
    re-reads the copy instead of recomputing the lineage.
    """
    return write_table(df)
