"""Tables of a job: what a write leaves on the executors' disks."""

import glob
import time

from thermoscope.llm.common import FREE_SHUFFLES, Scratch, shuffles_freed


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/**/shuffle_*.data", recursive=True)}


def test_a_write_leaves_no_shuffle_files(spark):
    """Before, they stayed until the driver happened to collect its garbage."""
    held = _shuffle_files(spark)
    rows = spark.range(20000).selectExpr("id % 100 AS k", "id AS v")
    twice = rows.groupBy("k").count().where("count > 1")
    table = Scratch(spark).write(rows.repartition("k").join(twice, "k"), "t")
    end = time.time() + 10
    while _shuffle_files(spark) - held and time.time() < end:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - held
    assert table.count() == 20000


def test_the_setting_is_put_back(spark):
    before = spark.conf.get(FREE_SHUFFLES, None)
    try:
        with shuffles_freed(spark):
            assert spark.conf.get(FREE_SHUFFLES) == "true"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(FREE_SHUFFLES, None) == before
