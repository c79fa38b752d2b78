"""Closed-form checks against NumPy brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thermoscope.operators import decompose as dc
from thermoscope.operators import linear as lin
from thermoscope.operators import outliers as ol
from thermoscope.operators import split as sp
from thermoscope.operators.kernel import hsic_exact_numpy, hsic_scores
from thermoscope.operators.ranking import exact_quantiles, ranked


def _frame(spark, x, y):
    cols = {f"x{j}": x[:, j] for j in range(x.shape[1])}
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(y)), **cols, "y": y}))


def _ridge_np(x, y, alpha, standardize=False):
    mu, nu = x.mean(0), y.mean()
    xc = x - mu
    if standardize:
        sd = xc.std(0)
        sd[sd == 0] = 1
        z = xc / sd
        w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - nu)) / sd
    else:
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - nu))
    return w, nu - w @ mu


@pytest.mark.parametrize("standardize", [False, True])
def test_cv_ridge_equals_fold_by_fold(spark, standardize):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3)) * [1, 10, 0.1] + [5, -3, 100]
    y = x @ [1.5, -0.2, 3.0] + rng.normal(size=120)
    df = _frame(spark, x, y)
    folded = sp.folds(df, "row_id", k=4, repeats=2)
    got = lin.cv_ridge_scores(spark, folded, ["x0", "x1", "x2"], "y", [0.5, 50.0], standardize).toPandas()
    pf = folded.select("row_id", "repeat", "fold").toPandas()
    for _, r in got.iterrows():
        ids = pf[(pf["repeat"] == r["repeat"]) & (pf["fold"] == r["fold"])]["row_id"].to_numpy()
        mask = np.isin(np.arange(120), ids)
        w, b = _ridge_np(x[~mask], y[~mask], r["alpha"], standardize)
        p = x[mask] @ w + b
        r2 = 1 - ((y[mask] - p) ** 2).sum() / ((y[mask] - y[mask].mean()) ** 2).sum()
        assert r["r2"] == pytest.approx(r2, abs=1e-9)


def test_ridge_loo_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=40)
    got = lin.ridge_loo(_frame(spark, x, y), ["x0", "x1"], "y", [0.1, 10.0]).toPandas().set_index("alpha")
    for a in (0.1, 10.0):
        errs = []
        for i in range(40):
            m = np.arange(40) != i
            w, b = _ridge_np(x[m], y[m], a)
            errs.append((y[i] - x[i] @ w - b) ** 2)
        assert got.loc[a, "loo_mse"] == pytest.approx(np.mean(errs), rel=1e-5)


def test_fit_ridge_original_units(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2)) + 100
    y = x @ [1.0, 2.0] + 3
    w, b = lin.fit_ridge(_frame(spark, x, y), ["x0", "x1"], "y", 1e-9)
    assert np.allclose(w, [1.0, 2.0], atol=1e-6) and b == pytest.approx(3.0, abs=1e-3)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=3), min_size=5, max_size=60))
def test_ranked_equals_row_number_under_skew(spark, groups):
    # group 0 may hold most rows: the numbering must still be exact
    pdf = pd.DataFrame({"id": np.arange(len(groups)), "g": groups,
                        "v": np.random.default_rng(len(groups)).normal(size=len(groups))})
    r = ranked(spark.createDataFrame(pdf), ["v", "id"], ["g"], name="rn", num_partitions=4).toPandas()
    want = pdf.sort_values(["g", "v", "id"]).groupby("g").cumcount() + 1
    assert dict(zip(r["id"], r["rn"])) == dict(zip(pdf.sort_values(["g", "v", "id"])["id"], want))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(101), "g": [0] * 70 + [1] * 31, "v": rng.normal(size=101)})
    q = exact_quantiles(spark.createDataFrame(pdf), "v", [0.1, 0.5, 0.75], by=["g"], tiebreak=["id"]).toPandas()
    for _, r in q.iterrows():
        vals = pdf[pdf["g"] == r["g"]]["v"].to_numpy()
        assert r["q10"] == pytest.approx(np.quantile(vals, 0.1))
        assert r["q50"] == pytest.approx(np.quantile(vals, 0.5))
        assert r["q75"] == pytest.approx(np.quantile(vals, 0.75))


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=10, max_value=200))
def test_splits_partition_rows(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    s = sp.split_named(df)
    chk = sp.check_splits(s).first()
    assert chk["n_rows"] == n and chk["n_multi"] == 0 and chk["n_unassigned"] == 0
    f = sp.folds(df, k=3, repeats=2).groupBy("row_id", "repeat").count()
    assert f.where("count <> 1").count() == 0


def test_lof_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(5, 3)) * 6])
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(x)), "features": list(x)}))
    got = ol.lof(df, k=5).orderBy("row_id").toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1)[:, :5]
    kd = d[np.arange(len(x)), nn[:, -1]]
    reach = np.maximum(d[np.arange(len(x))[:, None], nn], kd[nn])
    lrd = 1 / (reach.mean(1) + 1e-10)
    lof = lrd[nn].mean(1) / lrd
    assert np.allclose(got["lof"].to_numpy(), lof, rtol=1e-9)
    cut = np.quantile(-lof, 0.1)
    assert list(got["is_inlier"]) == list(-lof >= cut)


def test_knn_with_small_blocks_is_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 4))
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(150), "features": list(x)}))
    got = ol.knn(df, 3, leaf=16).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    for i, g in got.groupby("row_id"):
        assert np.allclose(np.sort(g["dist"].to_numpy()), want[i])


def test_isolation_forest_flags_far_points(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(300, 2)), rng.normal(size=(10, 2)) * 0.3 + 12])
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(len(x)), "features": list(x)}))
    m = ol.isolation_forest_mask(df, trees=50).toPandas().set_index("row_id")
    assert (~m.loc[300:, "is_inlier"]).all()
    assert m["is_inlier"].mean() == pytest.approx(0.9, abs=0.01)


def test_hsic_rff_close_to_exact(spark):
    rng = np.random.default_rng(7)
    n = 200
    x1 = rng.normal(size=n)
    y = np.sin(2 * x1) + 0.1 * rng.normal(size=n)
    x2 = rng.normal(size=n)
    long = spark.createDataFrame(pd.DataFrame({
        "row_id": np.tile(np.arange(n), 2), "feature_id": np.repeat([0, 1], n),
        "value": np.concatenate([x1, x2]), "y": np.concatenate([y, y])}))
    got = hsic_scores(long, n_features=1024).orderBy("feature_id").toPandas()["score"].to_numpy()
    exact = np.array([hsic_exact_numpy(x1, y), hsic_exact_numpy(x2, y)])
    assert got[0] == pytest.approx(exact[0], rel=0.25)
    assert got[0] > 3 * got[1]


def test_pca_and_svd_match_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame(pd.DataFrame({"features": list(x)}))
    fit = dc.pca_fit(df, "features", 3)
    ev = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:3]
    assert np.allclose(fit["explained_variance"], ev)
    sv = dc.svd_fit(df, "features", 2)["singular_values"]
    assert np.allclose(sv, np.linalg.svd(x, compute_uv=False)[:2])


def test_kmeans_mask_keeps_big_clusters(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(97, 2)), rng.normal(size=(3, 2)) * 0.1 + 40])
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(100), "features": list(x)}))
    m = ol.kmeans_mask(df, k=2, n_init=2).toPandas().set_index("row_id")
    assert (~m.loc[97:, "is_inlier"]).all() and m.loc[:96, "is_inlier"].all()
    assert ol.outlier_rows(spark.createDataFrame(m.reset_index()[["row_id", "is_inlier"]])).count() == 3


def test_scaling_identity(spark):
    from thermoscope.operators import scale as sc
    rng = np.random.default_rng(10)
    v = rng.normal(size=50) * 3 + 1
    long = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(50), "feature_id": 0, "value": v}))
    got = sc.scale(long, sc.scaler_constants(long, "standard")).orderBy("row_id").toPandas()["scaled"]
    assert np.allclose(got, (v - v.mean()) / v.std())
    rob = sc.scale(long, sc.scaler_constants(long, "robust")).orderBy("row_id").toPandas()["scaled"]
    q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    assert np.allclose(rob, (v - q2) / (q3 - q1))


def test_ridge_trials_fit_scaler_inside_each_fold(spark):
    from thermoscope.operators import search as se
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 2)) * [3.0, 0.5] + [1.0, -2.0]
    y = x @ [1.0, 4.0] + rng.normal(size=90)
    df = _frame(spark, x, y)
    folded = sp.folds(df, "row_id", k=3, repeats=1)
    trials = spark.createDataFrame(
        [(0, "ridge", {"ridge_alpha": "5.0", "scaler_type": "robust"}),
         (1, "ridge", {"ridge_alpha": "5.0", "scaler_type": "standard"})],
        "trial int, model_type string, params map<string,string>")
    got = se.ridge_trial_scores(spark, folded, ["x0", "x1"], "y", trials).toPandas()
    pf = folded.select("row_id", "fold").toPandas()
    for _, r in got.iterrows():
        val = np.isin(np.arange(90), pf[pf["fold"] == r["fold"]]["row_id"])
        xt, yt = x[~val], y[~val]
        if r["trial"] == 0:
            c = np.median(xt, 0)
            s = np.quantile(xt, 0.75, axis=0) - np.quantile(xt, 0.25, axis=0)
        else:
            c, s = xt.mean(0), xt.std(0)
        z = (xt - c) / s
        zc = z - z.mean(0)
        w = np.linalg.solve(zc.T @ zc + 5.0 * np.eye(2), zc.T @ (yt - yt.mean()))
        p = ((x[val] - c) / s) @ w + (yt.mean() - z.mean(0) @ w)
        r2 = 1 - ((y[val] - p) ** 2).sum() / ((y[val] - y[val].mean()) ** 2).sum()
        assert r["r2"] == pytest.approx(r2, abs=1e-9)


def test_hot_sensor_streaks_and_history_exact(spark):
    """One sensor holds a third of all readings: results must equal a brute force."""
    import datetime as dt
    from thermoscope.operators import service as sv
    rng = np.random.default_rng(12)
    n = 3000
    sensor = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, size=n))
    ok = rng.random(n) > 0.45
    t0 = dt.datetime(2024, 1, 1)
    pdf = pd.DataFrame({"event_id": np.arange(n), "sensor": sensor,
                        "ts": [t0 + dt.timedelta(seconds=int(s)) for s in rng.permutation(n)],
                        "success": ok, "value": rng.normal(size=n)})
    df = spark.createDataFrame(pdf).repartition(6)
    got = sv.failure_streaks(df, min_len=3).toPandas()
    want = []
    for s, g in pdf.sort_values(["ts", "event_id"]).groupby("sensor"):
        run, start = 0, None
        for ts, okv in zip(g["ts"], g["success"]):
            if okv:
                if run >= 3:
                    want.append((s, run))
                run = 0
            else:
                run += 1
        if run >= 3:
            want.append((s, run))
    assert sorted(zip(got["sensor"], got["length"])) == sorted(want)
    hist = sv.bounded_history(df, n=100).groupBy("sensor").count().toPandas().set_index("sensor")["count"]
    assert hist.loc[0] == 100 and (hist.drop(0) == pdf[pdf["sensor"] != 0].groupby("sensor").size().clip(upper=100)).all()


def test_ranked_running_sums_equal_cumsum(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(13)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 6, n)),
                        "v": rng.normal(size=n), "w": rng.integers(0, 3, n)})
    r = ranked(spark.createDataFrame(pdf), ["v", "id"], ["g"], name="rn", num_partitions=6,
               running={"cw": F.col("w").cast("long")}).toPandas().set_index("id")
    s = pdf.sort_values(["g", "v", "id"])
    want = s.groupby("g")["w"].cumsum()
    assert (r.loc[s["id"], "cw"].to_numpy() == want.to_numpy()).all()
    assert (r.loc[s["id"], "rn"].to_numpy() == (s.groupby("g").cumcount() + 1).to_numpy()).all()
