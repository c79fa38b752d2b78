"""

Every name here is a Spark operator from ``thermoscope.operators``,
``sources``, ``functions`` or ``streaming``; the few composed helpers below
chain operators exactly as the reference's entry points chain its steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import (artifact_path, confidence_band as confidence, from_reading_json,  # noqa: F401
                                numeric_columns as numeric, prediction_log_line, rate_gap,
                                reading_json as to_reading_json, sweep_time)
from .operators.decompose import kernel_pca, pca_fit, pca_table, project, rfe_cv, svd_fit  # noqa: F401
from .operators.ensembles import (ada_boost_r2 as ada_r2, ada_predict, extra_trees,  # noqa: F401
                                  extra_trees_predict, rbf_predict, rbf_regression as rbf_svr)
from .operators.estimators import (ArrayScaler, ArraySelector, OutlierMask, RidgeRegressor,  # noqa: F401
                                   load_model, named_pipeline, save_model)
from .operators.boosting import fit_boosting  # noqa: F401
from .operators.gauss import hsic  # noqa: F401
from .operators.kernel import hsic_scores  # noqa: F401
from .operators.linear import cv_ridge_scores, elastic_net, fit_ridge, lasso, linear_predict, ridge_loo  # noqa: F401
from .operators.metrics import histogram, metrics, residuals  # noqa: F401
from .operators.outliers import (choose_k, cluster_size_mask, isolation_forest_mask, keep_rows,  # noqa: F401
                                 kmeans_mask, knn, lof, outlier_rows, silhouette)
from .operators.parity import accuracy_curve, pair, pair_columns, parity  # noqa: F401
from .operators.ranking import exact_quantiles, ntile_of, ranked  # noqa: F401
from .operators.scale import check_scaling, impute_median, prep_constants, scale, scaler_constants  # noqa: F401
from .operators.search import (best_trial, completed, evaluate_trials as cv_scores, family_params,  # noqa: F401
                               importance, resume_best, run_search, sample_trials, save_trials, slices,
                               stop_at, trial_history, trial_score)
from .operators.select import f_scores, keep_features, mi_scores, reduce_width, top_k, variance_keep  # noqa: F401
from .operators.service import (batch_numbers, bounded_history as history_per_sensor,  # noqa: F401
                                failure_streaks, health, history, latest, rate_alerts, readings,
                                recent, service_stats, slow_readings, trend)
from .operators.split import check_splits, contiguous_folds, split, split_named, write_splits  # noqa: F401
from .operators.split import folds as _hash_folds
from .operators.stats import (check_sweep, feature_quartiles, feature_stats, flatten_sweep,  # noqa: F401
                              has_missing, quality_report, summarize_sweep)
from .operators.transforms import quantile_transform, with_target, yeo_johnson  # noqa: F401
from .operators.trees import ensemble_predict, fit_tree_model, route, tree_nodes  # noqa: F401
from .sources.files import align, alignment_report, dataset_status, pair_parts, read_pairs, read_sweeps, stack  # noqa: F401
from .sources.sinks import (batch_sink, export_range, metrics_long, prediction_log, retained_days,  # noqa: F401
                            write_metrics, write_readings)
from .sources.synth import synth_features  # noqa: F401
from .streaming.service import (ProgressRecorder, bounded_history as history_stream, event_stream,  # noqa: F401
                                health_stream, late_batches, rate_alert_stream, streak_alerts,
                                windowed_stats)
from .streaming.sweeps import (linear_scorer, running_totals, score_stream, sweep_stream,  # noqa: F401
                               tree_scorer, unseen)


def folds(df: DataFrame, key: str = "row_id", k: int = 5, repeats: int = 3, seed: int = 42,
          contiguous: bool = False) -> DataFrame:
    """Shuffled repeated k-fold, or k contiguous folds in key order (one repeat)."""
    if contiguous:
        return contiguous_folds(df, key, k).withColumn("repeat", F.lit(0))
    return _hash_folds(df, key, k, repeats, seed)


def noise_ceiling(df: DataFrame, features: Sequence[str], y: str, k: int = 5, repeats: int = 3,
                  alpha: float = 1.0, floor: float | None = None, standardize: bool = False,
                  contiguous: bool = False, key: str = "row_id") -> DataFrame:
    """Mean + 2·std of ridge CV R² from one Gram pass (optionally floored)."""
    from .operators.linear import noise_ceiling as _ceiling
    f = folds(df, key, k, repeats, contiguous=contiguous)
    scores = cv_ridge_scores(df.sparkSession, f, features, y, [alpha], standardize)
    return _ceiling(scores, floor)


def ridge(df: DataFrame, features: Sequence[str], y: str, alphas: Sequence[float],
          standardize: bool = False) -> list[tuple[float, list[float], float]]:
    """One Gram pass, one (alpha, weights, intercept) per alpha."""
    out = []
    for a in alphas:
        w, b = fit_ridge(df, features, y, a, standardize)
        out.append((float(a), [float(v) for v in w], float(b)))
    return out


def tree(df, features, y, **params):
    return fit_tree_model(df, features, y, "tree", **params)


def forest(df, features, y, **params):
    return fit_tree_model(df, features, y, "forest", **params)


def bagging(df, features, y, **params):
    return fit_tree_model(df, features, y, "bagging", **params)


def boosted(df, features, y, **params):
    return fit_tree_model(df, features, y, "boosted", **params)


def pca(df: DataFrame, features: str, k_or_fraction: int | float) -> dict:
    return pca_fit(df, features, k_or_fraction)


def svd(df: DataFrame, features: str, k: int) -> dict:
    return svd_fit(df, features, k)


def fit_without_outliers(df: DataFrame, detector: Callable[[DataFrame], DataFrame],
                         fit: Callable[[DataFrame], object], key: str = "row_id"):
    """Fit the mask on these (training) rows, drop the outliers, then fit."""
    mask = detector(df)
    return fit(keep_rows(df, mask, key))


def evaluate(df: DataFrame, predict: Callable[[DataFrame], DataFrame], ceiling: float | None = None,
             y: str = "y", best_cv: float | None = None) -> DataFrame:
    """Test metrics of a fitted model, with the ceiling and best CV value."""
    m = metrics(predict(df), y, "prediction")
    out = m.select(F.col("r2").alias("test_r2"), F.col("mae").alias("test_mae"),
                   F.col("mse").alias("test_mse"), F.col("rmse").alias("test_rmse"))
    if ceiling is not None:
        out = out.withColumn("noise_ceiling", F.lit(float(ceiling)))
    if best_cv is not None:
        out = out.withColumn("cv_best_r2", F.lit(float(best_cv)))
    return out


def session(**kwargs) -> SparkSession:
    from .session import get_spark
    return get_spark(**kwargs)
