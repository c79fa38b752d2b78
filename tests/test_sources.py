"""File sources, sinks and the estimator/pipeline surface."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermoscope.operators import split as sp
from thermoscope.sources import files as fl
from thermoscope.sources import sinks as sk


def test_read_pairs_aligns_by_position(spark, scratch):
    x = pd.DataFrame({"a": [1.0, 2.0, 3.0], "b": [4, 5, 6], "name": ["p", "q", "r"]})
    y = pd.DataFrame({"t": ["10.5", "oops", "12"]})
    x.to_csv(os.path.join(scratch, "x.csv"), index=False)
    y.to_csv(os.path.join(scratch, "y.csv"), index=False)
    df = fl.read_pairs(spark, os.path.join(scratch, "x.csv"), os.path.join(scratch, "y.csv")).orderBy("row_id")
    got = df.toPandas()
    assert list(got.columns) == ["row_id", "a", "b", "target"]     # text column dropped (S4)
    assert list(got["a"]) == [1.0, 2.0, 3.0]
    assert got["target"].isna().tolist() == [False, True, False]    # F13 coercion


def test_read_sweeps_and_pair_parts(spark, scratch):
    for part in range(2):
        d = os.path.join(scratch, f"dir{part}")
        os.makedirs(d)
        for i in range(2):
            pd.DataFrame({"Frequency(Hz)": [1.0, 2.0], "Return Loss(dB)": [0.1 * i, 0.2],
                          "Phase(deg)": [3.0, 4.0], "Xs": [5.0, 6.0]}).to_csv(
                os.path.join(d, f"VNA_{i}.csv"), index=False)
        pd.DataFrame({"x": [1]}).to_csv(os.path.join(d, "other.txt"), index=False)
    s = fl.read_sweeps(spark, [os.path.join(scratch, "dir0"), os.path.join(scratch, "dir1")], "VNA_*.csv")
    assert s.count() == 8
    assert sorted(r["point_idx"] for r in s.where("part_id = 0 AND file = 'VNA_1.csv'").collect()) == [0, 1]
    assert s.where("part_id = 0 AND file = 'VNA_1.csv' AND point_idx = 0").first()["return_loss_db"] == 0.1
    assert sorted(r["file"] for r in s.select("file").distinct().collect()) == ["VNA_0.csv", "VNA_1.csv"]
    sweeps = s.groupBy("part_id", "file").count().withColumn(
        "seq", F.regexp_extract("file", r"VNA_(\d+)", 1).cast("int"))
    readings = spark.createDataFrame([(0, 0, 20.5), (0, 1, 21.0), (1, 0, 9.0), (1, 1, 9.5)],
                                     "part_id int, seq int, target double")
    assert fl.pair_parts(sweeps, readings).count() == 4


def test_dataset_status(spark, scratch):
    os.makedirs(os.path.join(scratch, "d1"))
    open(os.path.join(scratch, "d1", "VNA_1.csv"), "w").write("a\n1\n")
    open(os.path.join(scratch, "t1.csv"), "w").write("0\n1\n")
    os.makedirs(os.path.join(scratch, "empty"))
    open(os.path.join(scratch, "empty", ".keep"), "w").write("")
    cat = spark.createDataFrame([
        (1, "predictors", os.path.join(scratch, "d1")), (1, "target", os.path.join(scratch, "t1.csv")),
        (2, "predictors", os.path.join(scratch, "nowhere")), (2, "target", os.path.join(scratch, "t1.csv")),
        (3, "predictors", os.path.join(scratch, "d1")), (3, "target", os.path.join(scratch, "missing.csv"))],
        "dataset int, role string, path string")
    st = {r["dataset"]: r["valid"] for r in fl.dataset_status(spark, cat, scratch).collect()}
    assert st == {1: True, 2: False, 3: False}


def test_split_sink_and_export(spark, scratch):
    df = sp.split(spark.range(200).withColumnRenamed("id", "row_id"))
    out = os.path.join(scratch, "splits")
    sp.write_splits(df, out)
    back = spark.read.parquet(out)
    assert back.where("split = 'holdout'").count() == df.where("split = 'holdout'").count()
    dirs = sorted(d for d in os.listdir(out) if d.startswith("split="))
    assert dirs == ["split=holdout", "split=test", "split=train"]


def test_metrics_and_log_sinks(spark, scratch):
    import datetime as dt
    m = spark.createDataFrame([(0.9, 0.25)], "r2 double, mae double")
    sk.write_metrics(m, os.path.join(scratch, "metrics"))
    lines = sorted(r[0] for r in spark.read.text(os.path.join(scratch, "metrics")).collect())
    assert lines == ["mae: 0.25", "r2: 0.9"]
    p = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), "live-vna240102_030405.csv", 12.345)],
                              "ts timestamp, file string, prediction double")
    sk.prediction_log(p, os.path.join(scratch, "log"))
    line = spark.read.text(os.path.join(scratch, "log")).first()[0]
    assert line == "2024-01-02 03:04:05 | live-vna240102_030405.csv | 12.35°C"


def test_trials_saved_per_run_and_resumed(spark, scratch):
    from thermoscope.operators import search as se
    path = os.path.join(scratch, "trials")
    a = spark.createDataFrame([(0, 0.5, "COMPLETE"), (1, 0.7, "COMPLETE")], "trial int, value double, state string")
    b = spark.createDataFrame([(0, 0.9, "FAIL"), (1, 0.8, "COMPLETE")], "trial int, value double, state string")
    se.save_trials(a, path)
    se.save_trials(b, path)
    assert spark.read.json(path).count() == 4
    best = se.resume_best(spark, path).first()
    assert best["value"] == 0.8


def test_pipeline_fit_save_load(spark, scratch):
    from thermoscope.operators.estimators import (ArrayScaler, ArraySelector, RidgeRegressor,
                                                  load_model, named_pipeline, save_model)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = 3 * x[:, 0] - 2 * x[:, 2] + 0.01 * rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(200), "features": list(x), "y": y}))
    pipe = named_pipeline([
        ("select", ArraySelector(inputCol="features", outputCol="sel", labelCol="y", k=2)),
        ("scale", ArrayScaler(inputCol="sel", outputCol="scaled")),
        ("ridge", RidgeRegressor(inputCol="scaled", outputCol="prediction", labelCol="y", alpha=1e-6))])
    model = pipe.fit(df)
    assert model.stages[0].getOrDefault("indices") == [0, 2]
    path = os.path.join(scratch, "model")
    save_model(model, path)
    again = load_model(path)
    p1 = model.transform(df).select("prediction").toPandas()["prediction"]
    p2 = again.transform(df).select("prediction").toPandas()["prediction"]
    assert np.allclose(p1, p2) and np.corrcoef(p1, y)[0, 1] > 0.999


def test_log_grid_and_synth(spark):
    from thermoscope.functions.columns import log_grid
    g = spark.range(1).select(log_grid().alias("g")).first()["g"]
    assert len(g) == 50 and g[0] == pytest.approx(1e-3) and g[-1] == pytest.approx(100.0)
    from thermoscope.sources.synth import synth_features
    s = synth_features(spark.range(2000).withColumnRenamed("id", "k"), "k")
    st = s.groupBy("feature_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    r = {x["feature_id"]: (x["m"], x["s"]) for x in st.collect()}
    assert r[0][0] == pytest.approx(-15, abs=0.5) and r[0][1] == pytest.approx(5, rel=0.1)
    assert 1.0 <= min(v[0] for k, v in r.items() if 18 <= k < 24) <= 3.0


def test_unseen_files(spark):
    from thermoscope.streaming.sweeps import unseen
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "file string")
    seen = spark.createDataFrame([("a",)], "file string")
    assert sorted(r[0] for r in unseen(files, seen).collect()) == ["b", "c"]


def test_export_range_and_reading_log(spark, scratch):
    import datetime as dt
    from thermoscope.operators.service import readings
    t0 = dt.datetime(2024, 1, 1, 12)
    ev = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=10 * i), 1, "view", float(i), "{}") for i in range(10)],
                               "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    out = os.path.join(scratch, "export")
    sk.export_range(readings(ev), 30, out)
    back = spark.read.option("header", "true").csv(out)
    assert back.count() == 4            # newest reading and the three within 30 minutes before it
    log = os.path.join(scratch, "readings")
    sk.write_readings(readings(ev), log, max_records=3)
    assert spark.read.parquet(log).count() == 10
    assert any(d.startswith("day=") for d in os.listdir(log))


def test_search_loop_stops_at_ceiling_with_callback(spark):
    from thermoscope.operators import search as se
    trials = spark.createDataFrame([(i,) for i in range(10)], "trial int")
    values = {0: 0.2, 1: 0.5, 2: 0.985, 3: 0.99}

    def evaluate(chunk):
        return chunk.select("trial", F.element_at(F.create_map(*[x for k, v in values.items()
                                                                 for x in (F.lit(k), F.lit(v))]),
                                                  F.col("trial")).alias("value"))
    seen = []
    done = se.run_search(spark, evaluate, trials, ceiling=0.99, batch=2,
                         callback=lambda study, info: seen.append(info["trials_done"]))
    assert seen == [2, 4] and done.count() == 4


def test_batch_sink_idempotent_per_batch(spark, scratch):
    from thermoscope.streaming import service as ss
    from conftest import SF_SMALL
    out = os.path.join(scratch, "batches")

    def write(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = sk.batch_sink(ss.event_stream(spark, SF_SMALL), write, os.path.join(scratch, "ck"), available_now=True)
    q.awaitTermination(120)
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert spark.read.parquet(out).count() == n


def test_rate_alerts_and_health_streams(spark):
    from thermoscope.streaming import service as ss
    from conftest import SF_SMALL
    r = ss.event_stream(spark, SF_SMALL)
    q = (ss.rate_alert_stream(ss.windowed_stats(r)).writeStream.outputMode("update").format("memory")
         .queryName("alerts").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.sql("SELECT * FROM alerts WHERE NOT low_rate").count() == 0   # sparse stream: rate floor hit
    h = (ss.health_stream(r).writeStream.outputMode("complete").format("memory")
         .queryName("health").trigger(availableNow=True).start())
    h.awaitTermination(120)
    n_sensors = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("user_id").distinct().count()
    assert spark.sql("SELECT * FROM health").count() == n_sensors
