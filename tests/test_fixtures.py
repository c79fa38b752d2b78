"""Hand fixtures (small, exact answers) for metrics, masks, ratios, trials, trees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thermoscope.operators import metrics as me
from thermoscope.operators import outliers as ol
from thermoscope.operators import scale as sc
from thermoscope.operators import search as se
from thermoscope.operators import select as sl
from thermoscope.operators import service as sv
from thermoscope.operators import trees as tr


def _pairs(spark, y, p):
    return spark.createDataFrame(pd.DataFrame({"row_id": range(len(y)), "y": y, "prediction": p}))


def test_two_points_metrics(spark):
    r = me.metrics(_pairs(spark, [1.0, 2, 3, 4], [1.5, 2, 2.5, 4])).first()
    assert r["r2"] == pytest.approx(0.9)
    assert r["mae"] == pytest.approx(0.25)
    assert r["mse"] == pytest.approx(0.125)


def test_shifted_prediction_r2_is_not_squared_correlation(spark):
    y = np.arange(1.0, 11.0)
    df = _pairs(spark, y, 0.5 * y + 10)
    r2 = me.metrics(df).first()["r2"]
    corr2 = df.agg(F.corr("y", "prediction")).first()[0] ** 2
    assert r2 < -1.0
    assert corr2 == pytest.approx(1.0)


def test_constant_target_r2_rule(spark):
    assert me.metrics(_pairs(spark, [2.0, 2, 2], [2.0, 2, 2])).first()["r2"] == 1.0
    assert me.metrics(_pairs(spark, [2.0, 2, 2], [2.0, 2, 3])).first()["r2"] == 0.0


def test_constant_feature_scalers(spark):
    long = spark.createDataFrame(pd.DataFrame({"row_id": [0, 1, 2], "feature_id": [0, 0, 0],
                                               "value": [5.0, 5.0, 5.0]}))
    for kind in ("standard", "robust", "minmax"):
        c = sc.scaler_constants(long, kind).first()
        assert c["scale"] == 1.0
        out = sc.scale(long, sc.scaler_constants(long, kind)).select("scaled").toPandas()["scaled"]
        assert (out == 0.0).all()


def test_nan_column_median_impute(spark):
    long = spark.createDataFrame(pd.DataFrame({
        "row_id": [0, 1, 2, 3, 0, 1, 2, 3], "feature_id": [0, 0, 0, 0, 1, 1, 1, 1],
        "value": [1.0, float("nan"), 3.0, 10.0, 1.0, 2.0, 3.0, 4.0]}))
    from thermoscope.operators.stats import has_missing
    miss = {r["feature_id"]: r["has_missing"] for r in has_missing(long).collect()}
    assert miss == {0: True, 1: False}
    imp = sc.impute_median(long).where("feature_id = 0 AND row_id = 1").first()["value"]
    assert imp == pytest.approx(3.0)


@pytest.mark.parametrize("literal", [True, False])
def test_tiny_tree_routing_tie_goes_left(spark, monkeypatch, literal):
    if not literal:
        monkeypatch.setattr(tr, "LITERAL_NODES", 0)
    nodes = spark.createDataFrame(pd.DataFrame({
        "tree_id": [0, 0, 0], "node_id": [0, 1, 2], "feature": [0, -1, -1], "threshold": [0.5, 0.0, 0.0],
        "left": [1, -1, -1], "right": [2, -1, -1], "value": [0.0, 1.0, 2.0], "is_leaf": [False, True, True],
        "weight": [1.0, 1.0, 1.0]}))
    rows = spark.createDataFrame(pd.DataFrame({"row_id": [0, 1, 2], "features": [[0.2], [0.5], [0.9]]}))
    routed = tr.ensemble_mean(tr.route(rows, nodes, max_depth=3)).orderBy("row_id").toPandas()
    assert list(routed["prediction"]) == [1.0, 1.0, 2.0]
    vec = tr.ensemble_predict(rows, nodes).orderBy("row_id").toPandas()
    assert list(vec["prediction"]) == [1.0, 1.0, 2.0]


def test_four_points_silhouette_is_squared_euclidean(spark):
    df = spark.createDataFrame(pd.DataFrame({"features": [[0.0, 0.0], [0.0, 1.0], [5.0, 5.0], [5.0, 6.0]],
                                             "cluster": [0, 0, 1, 1]}))
    s = ol.silhouette(ol.to_vector(df, "features"))
    assert s == pytest.approx(0.9800, abs=1e-3)


def test_small_cluster_mask(spark):
    labels = [0] * 97 + [1] * 3
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(100), "cluster": labels}))
    m = ol.cluster_size_mask(df, "cluster", 0.1)
    assert m.where(~F.col("is_inlier")).count() == 3
    # threshold is floor(n·ratio) and equality is kept
    df2 = spark.createDataFrame(pd.DataFrame({"row_id": range(100), "cluster": [0] * 90 + [1] * 10}))
    assert ol.cluster_size_mask(df2, "cluster", 0.1).where("is_inlier").count() == 100


@pytest.mark.parametrize("ratio,k", [("90:100", 90), ("1:0", None), ("abc", None), ("200:100", 100),
                                     ("0:1", 1)])
def test_ratios(ratio, k):
    assert sl.parse_ratio(ratio, 100) == k


def test_ratio_expression_matches_python(spark):
    df = spark.createDataFrame([("90:100",), ("1:0",), ("abc",), ("200:100",), ("0:1",)], "r string")
    got = [r[0] for r in df.select(sl.ratio_k(F.col("r"), F.lit(100))).collect()]
    assert got == [90, None, None, 100, 1]


def test_trials_stop_rule(spark):
    study = spark.createDataFrame(pd.DataFrame({"trial": range(5), "value": [0.2, 0.9, -999, 0.985, 0.99]}))
    h = se.trial_history(study)
    kept = se.stop_at(h, 0.99, 0.01).orderBy("trial").toPandas()
    assert list(kept["trial"]) == [0, 1, 2, 3]
    assert list(kept["best_so_far"]) == [0.2, 0.9, 0.9, 0.985]
    assert se.best_trial(study).first()["trial"] == 4


def test_trial_score_reducer(spark):
    folds = spark.createDataFrame(pd.DataFrame({
        "trial": [0, 0, 0, 1, 1, 1, 2, 2, 2], "r2": [0.5, 0.7, 0.6, 0.9, -6.0, 0.9, 0.1, float("nan"), 0.2]}))
    got = {r["trial"]: r["value"] for r in se.trial_score(folds).collect()}
    assert got[0] == pytest.approx(0.6)
    assert got[1] == -999.0 and got[2] == -999.0


def test_streaks_batch_twin(spark):
    import datetime as dt
    ok = [True] + [False] * 5 + [True] + [False] * 10
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(pd.DataFrame({
        "event_id": range(len(ok)), "sensor": [1] * len(ok),
        "ts": [t0 + dt.timedelta(seconds=i) for i in range(len(ok))], "success": ok, "value": [1.0] * len(ok)}))
    s = sv.failure_streaks(df).orderBy("start_ts").toPandas()
    assert list(s["length"]) == [5, 10]
    assert list(s["level"]) == ["reset_sensor", "reload_model"]


def test_confidence_and_verdict_bands(spark):
    from thermoscope.functions.columns import confidence_band, parity_verdict
    df = spark.createDataFrame([(0.01, 95.0), (0.015, 94.9), (0.05, 90.0), (0.2, 89.0)], "e double, p double")
    r = df.select(confidence_band("e").alias("b"), parity_verdict("p").alias("v"),
                  parity_verdict("p", strict=True).alias("s")).collect()
    assert [x["b"] for x in r] == ["EXCELLENT", "GOOD", "FAIR", "POOR"]
    assert [x["v"] for x in r] == ["PASS", "WARNING", "WARNING", "FAIL"]
    assert [x["s"] for x in r] == ["PASS", "FAIL", "FAIL", "FAIL"]


def test_sweep_time_from_file_name(spark):
    from thermoscope.functions.columns import sweep_time
    df = spark.createDataFrame([("live-vna240131_235959.csv",), ("notes.txt",)], "f string")
    r = df.select(sweep_time("f").cast("string").alias("t")).collect()
    assert r[0]["t"] == "2024-01-31 23:59:59" and r[1]["t"] is None


def test_api_surface(spark):
    from thermoscope import api
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(60), "x": np.arange(60.0),
                                             "y": 2 * np.arange(60.0) + 1}))
    nc = api.noise_ceiling(df, ["x"], "y", k=3, repeats=1).first()
    assert nc["baseline_r2"] == pytest.approx(1.0)
    (a, w, b), = api.ridge(df, ["x"], "y", [1e-9])
    assert w[0] == pytest.approx(2.0) and b == pytest.approx(1.0, abs=1e-6)
    f = api.folds(df, k=3, contiguous=True).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in f) == [20, 20, 20]
    ev = api.evaluate(df, lambda d: d.withColumn("prediction", F.col("y")), ceiling=0.99)
    assert ev.first()["test_r2"] == 1.0


def test_width_reduction_rules_fire_on_wide_data(spark):
    rng = np.random.default_rng(14)
    n, width = 12, 6000
    x = rng.normal(size=(n, width))
    x[:, :1500] *= 0.01                    # 1,500 near-constant features fall under var 0.1
    y = x[:, 1600] * 3 + rng.normal(size=n) * 0.01
    long = spark.createDataFrame(pd.DataFrame({
        "row_id": np.repeat(np.arange(n), width), "feature_id": np.tile(np.arange(width), n),
        "value": x.ravel(), "y": np.repeat(y, width)}))
    stats = long.groupBy("feature_id").agg(F.var_pop("value").alias("var_pop"))
    out = sl.reduce_width(stats, sl.f_scores(long)).toPandas().set_index("feature_id")
    assert out["stage"].iloc[0] == "variance+top_k"
    kept = out[out["keep"]]
    assert len(kept) == min(2000, (width - 1500) // 2)   # half of the remaining features, at most 2,000
    assert (kept.index >= 1500).all() and 1600 in kept.index
