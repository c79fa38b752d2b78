"""Selection inside folds, penalties by leave-one-out errors, refit of saved trials."""

import numpy as np
import pandas as pd
import pytest

from thermoscope.operators import search as se
from thermoscope.operators import trials as tl


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 12)) * np.linspace(1, 4, 12) + 20
    return x, x[:, 2] * 2 - x[:, 7] + rng.normal(size=90)


def table_of(spark, x, y):
    return spark.createDataFrame(pd.DataFrame({"row_id": range(len(y)), "features": [list(r) for r in x], "y": y,
                                               "repeat": 0, "fold": np.arange(len(y)) % 3})).repartition(3)


def trials_of(spark, *params):
    return spark.createDataFrame([(i, p["model_type"], p) for i, p in enumerate(params)],
                                 "trial int, model_type string, params map<string,string>")


def plain_ridge(x, y, alpha, scaler):
    m, sd = x.mean(0), x.std(0)
    if scaler == "robust":
        sd = np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)
    z = (x - m) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return w, y.mean() - m @ w


def plain_fold(x, y, fold, f, k, alpha, scaler):
    tr, va = fold != f, fold == f
    r = np.array([np.corrcoef(x[tr, j], y[tr])[0, 1] ** 2 for j in range(x.shape[1])])
    idx = np.sort(np.argsort(-r, kind="stable")[:k])
    xt = x[tr][:, idx]
    if alpha is None:
        scores = []
        for a in tl.RIDGE_CV_ALPHAS:
            e = 0.0
            m = xt.mean(0)
            sd = xt.std(0) if scaler == "standard" else np.quantile(xt, 0.75, axis=0) - np.quantile(xt, 0.25, axis=0)
            z = (xt - m) / sd
            for i in range(len(z)):   # the centre stays that of all rows, as in the closed form
                o = np.arange(len(z)) != i
                za = np.column_stack([np.ones(o.sum()), z[o]])
                p = np.diag([0.0] + [a] * z.shape[1])
                c = np.linalg.solve(za.T @ za + p, za.T @ y[tr][o])
                e += (y[tr][i] - c[0] - z[i] @ c[1:]) ** 2
            scores.append(e)
        alpha = tl.RIDGE_CV_ALPHAS[int(np.argmin(scores))]
    w, b = plain_ridge(xt, y[tr], alpha, scaler)
    p = x[va][:, idx] @ w + b
    return 1 - ((y[va] - p) ** 2).sum() / ((y[va] - y[va].mean()) ** 2).sum(), alpha


@pytest.mark.parametrize("scaler", ["standard", "robust"])
def test_selection_and_ridge_cv_equal_plain_versions(spark, data, scaler):
    x, y = data
    base = {"scaler_type": scaler, "use_feature_selection": "True", "k_features": "3"}
    off = {"scaler_type": scaler, "use_feature_selection": "False"}
    t = trials_of(spark, {"model_type": "ridge", "ridge_alpha": "2.0", **base}, {"model_type": "ridge", "ridge_alpha": "2.0", **off},
                  {"model_type": "ridge_cv", **base}, {"model_type": "ridge_cv", **off})
    rows = tl.array_trial_scores(spark, table_of(spark, x, y), "features", "y", t, wide=10).collect()
    got = {(r["trial"], r["fold"]): (r["n_features"], r["r2"], r["alpha"]) for r in rows}
    fold = np.arange(90) % 3
    for trial, (k, alpha) in enumerate([(3, 2.0), (12, 2.0), (3, None), (12, None)]):
        for f in range(3):
            want, a = plain_fold(x, y, fold, f, k, alpha, scaler)
            assert got[trial, f] == (k, pytest.approx(want, abs=1e-9), pytest.approx(a))
    assert got[0, 0][1] != got[1, 0][1]   # what is drawn changes the scores
    # narrow tables keep all columns, whatever is drawn
    narrow = tl.array_trial_scores(spark, table_of(spark, x, y), "features", "y", t).collect()
    assert {r["n_features"] for r in narrow} == {12}


def test_selection_of_column_trials(spark, data):
    x, y = data
    cols = [f"c{i}" for i in range(12)]
    df = table_of(spark, x, y).selectExpr("row_id", "y", "repeat", "fold", *[f"features[{i}] AS c{i}" for i in range(12)])
    base = {"scaler_type": "standard", "use_feature_selection": "True", "k_features": "3"}
    t = trials_of(spark, {"model_type": "ridge", "ridge_alpha": "2.0", **base}, {"model_type": "lasso", "lasso_alpha": "0.1", **base})
    got = {r["trial"]: r["value"] for r in se.evaluate_trials(spark, df, cols, "y", t).collect()}
    fold = np.arange(90) % 3
    assert got[0] == pytest.approx(np.mean([plain_fold(x, y, fold, f, 3, 2.0, "standard")[0] for f in range(3)]))
    train = df.where("fold <> 0")
    r = np.array([np.corrcoef(x[fold != 0, j], y[fold != 0])[0, 1] ** 2 for j in range(12)])
    assert se._fold_features(train, cols, "y", base) == [f"c{i}" for i in sorted(np.argsort(-r)[:3])]
    assert se._fold_features(train, cols, "y", {"use_feature_selection": "False", "k_features": "3"}) == cols


FAMILIES = [{"model_type": "ridge", "ridge_alpha": "0.5"}, {"model_type": "ridge_cv"}, {"model_type": "lasso", "lasso_alpha": "0.05"},
            {"model_type": "dt", "dt_max_depth": "4", "dt_min_samples_split": "2"},
            {"model_type": "gbr", "gbr_n_estimators": "5", "gbr_max_depth": "3", "gbr_learning_rate": "0.3"},
            {"model_type": "lgbm", "lgbm_n_estimators": "5", "lgbm_num_leaves": "6", "lgbm_learning_rate": "0.3"},
            {"model_type": "extra", "extra_n_estimators": "5", "extra_max_depth": "4"},
            {"model_type": "ada", "ada_n_estimators": "3"}, {"model_type": "svr", "svr_C": "1.0", "svr_gamma": "0.01"}]


@pytest.mark.parametrize("params", FAMILIES, ids=lambda p: p["model_type"])
def test_refit_saves_and_loads(spark, data, scratch, params):
    x, y = data
    df = table_of(spark, x, y)
    p = {**params, "scaler_type": "robust" if params["model_type"] in ("ridge_cv", "dt") else "standard",
         "use_feature_selection": "True", "k_features": "5"}
    study = spark.createDataFrame([(0, {"model_type": "ridge", "ridge_alpha": "9"}, 0.1, "COMPLETE"), (1, p, 0.7, "COMPLETE"),
                                   (2, p, 0.9, "FAIL")], "trial int, params map<string,string>, value double, state string")
    se.save_trials(study, f"{scratch}/trials")
    best, model = tl.refit_best(spark, f"{scratch}/trials", df, "features", "y", wide=10)
    assert best["trial"] == 1 and len(model.kept) == 5
    model.save(spark, f"{scratch}/model")
    back = tl.TrialModel.load(spark, f"{scratch}/model")
    a = {r["row_id"]: r["prediction"] for r in model.transform(df).collect()}
    b = {r["row_id"]: r["prediction"] for r in back.transform(df).collect()}
    assert a == pytest.approx(b)
    pred = np.array([a[i] for i in range(90)])
    assert 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum() > (0 if params["model_type"] == "svr" else 0.3)
    if params["model_type"] == "ridge":
        w, c = plain_ridge(x[:, model.kept], y, 0.5, "standard")
        assert np.allclose(pred, x[:, model.kept] @ w + c, atol=1e-8)


def test_refit_without_trials_raises(spark, data, scratch):
    study = spark.createDataFrame([(0, {"model_type": "ridge"}, 0.1, "FAIL")],
                                  "trial int, params map<string,string>, value double, state string")
    se.save_trials(study, f"{scratch}/none")
    with pytest.raises(ValueError):
        tl.refit_best(spark, f"{scratch}/none", table_of(spark, *data), "features", "y")


def test_elimination_equals_plain_refits(spark):
    """One pivot a step, with the inverse renewed on the way, against refitting every subset."""
    from thermoscope.operators import decompose as dc
    rng = np.random.default_rng(6)
    n, d = 150, 70
    x = rng.normal(size=(n, d)) * np.linspace(0.5, 3, d) + 5
    y = x[:, :6] @ np.arange(1, 7) + rng.normal(size=n)
    got = dc.rfe_cv(table_of(spark, x, y), "features", "y")
    fold, active = np.arange(n) % 3, list(range(d))
    for row in got.itertuples():
        assert row.features == active and row.n_features == len(active)
        scores = []
        for f in range(3):
            w, b = plain_ridge(x[fold != f][:, active], y[fold != f], 1.0, "standard")
            e = y[fold == f] - x[fold == f][:, active] @ w - b
            scores.append(1 - (e ** 2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum())
        assert row.cv_r2 == pytest.approx(np.mean(scores), abs=1e-8)
        w, _ = plain_ridge(x[:, active], y, 1.0, "standard")
        active = [a for i, a in enumerate(active) if i != int(np.argmin(np.abs(w * x[:, active].std(0))))]
    assert got["chosen"].sum() == 1
