"""MLlib-style estimators over our operators.

Each estimator follows the ``fit(df) → Model``, ``model.transform(df)``
contract with ``Params`` and default persistence, so steps chain in a
``pyspark.ml.Pipeline`` and a fitted pipeline saves/loads as one directory.
Fitted state is small (per-feature constants, masks, coefficients) and is
kept as plain parameters; transforms are column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _explode(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("__rid"),
                     F.posexplode(col).alias("feature_id", "value"))


class _ArrayParams(HasInputCol, HasOutputCol):
    pass


# ------------------------------------------------------------------ scaler

class ArrayScaler(Estimator, _ArrayParams, DefaultParamsReadable, DefaultParamsWritable):
    """Per-position scaling of an array column: standard (population std),
    robust (median / IQR, exact) or minmax; a zero scale becomes 1."""

    kind = Param(Params._dummy(), "kind", "standard | robust | minmax", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="scaled", kind="standard"):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled", kind="standard")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ArrayScalerModel":
        from .scale import scaler_constants
        long = _explode(df, self.getInputCol()).withColumnRenamed("__rid", "row_id")
        c = scaler_constants(long, self.getOrDefault("kind")).orderBy("feature_id").collect()  # one row per position
        m = ArrayScalerModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                             center=[float(r["center"]) for r in c], scale=[float(r["scale"]) for r in c])
        return m


class ArrayScalerModel(Model, _ArrayParams, DefaultParamsReadable, DefaultParamsWritable):
    center = Param(Params._dummy(), "center", "centers", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "scales", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="scaled", center=None, scale=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from ..functions.columns import scale_array
        c = F.lit(np.array(self.getOrDefault("center"), float))
        s = F.lit(np.array(self.getOrDefault("scale"), float))
        return df.withColumn(self.getOutputCol(), scale_array(self.getInputCol(), c, s))


# --------------------------------------------------------- feature selector

class ArraySelector(Estimator, _ArrayParams, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Variance cut then top-k by a pluggable score (X2: 'f' or 'mi', or a
    callable long_df → (feature_id, score))."""

    k = Param(Params._dummy(), "k", "features to keep (0 = all)", TypeConverters.toInt)
    varianceThreshold = Param(Params._dummy(), "varianceThreshold", "population variance cut",
                              TypeConverters.toFloat)
    score = Param(Params._dummy(), "score", "f | mi", TypeConverters.toString)
    targetBins = Param(Params._dummy(), "targetBins", "quantile bins of a numeric target for mi (0 = classes)",
                       TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="selected", labelCol="y", k=0,
                 varianceThreshold=0.0, score="f", targetBins=10):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="selected", labelCol="y", k=0, varianceThreshold=0.0,
                         score="f", targetBins=10)
        self._set(**self._input_kwargs)
        self.score_fn: Callable[[DataFrame], DataFrame] | None = None

    def copy(self, extra=None):
        that = super().copy(extra)
        that.score_fn = self.score_fn
        return that

    def _fit(self, df: DataFrame) -> "ArraySelectorModel":
        from .select import f_scores, mi_scores, top_k
        long = df.select(F.col(self.getLabelCol()).cast("double").alias("y"),
                         F.posexplode(self.getInputCol()).alias("feature_id", "value"))
        var = long.groupBy("feature_id").agg(F.var_pop("value").alias("v"))
        kept = var.where(F.col("v") > self.getOrDefault("varianceThreshold")).select("feature_id")
        long = long.join(F.broadcast(kept), "feature_id", "left_semi")
        numeric_mi = lambda t: mi_scores(t, y_bins=self.getOrDefault("targetBins") or None)
        fn = self.score_fn or {"f": f_scores, "mi": numeric_mi}[self.getOrDefault("score")]
        scores = fn(long)
        k = self.getOrDefault("k")
        chosen = top_k(scores, k=k) if k else scores
        idx = sorted(int(r["feature_id"]) for r in chosen.select("feature_id").collect())  # ≤ width
        return ArraySelectorModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), indices=idx)


class ArraySelectorModel(Model, _ArrayParams, DefaultParamsReadable, DefaultParamsWritable):
    indices = Param(Params._dummy(), "indices", "kept positions", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="selected", indices=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="selected")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        idx = F.lit(np.array(self.getOrDefault("indices"), np.int32) + 1)
        return df.withColumn(self.getOutputCol(),
                             F.transform(idx, lambda i: F.element_at(F.col(self.getInputCol()), i)))


# ------------------------------------------------------------ outlier mask

class OutlierMask(Estimator, _ArrayParams, DefaultParamsReadable, DefaultParamsWritable):
    """X1 mask estimator: method kmeans | iforest; outputs ``is_inlier``.

    The fitted model scores any row, fitted or new: by the nearest cluster (kept
    when that cluster held at least ``ratio`` of the fitted rows) or by the
    isolation path length against the fitted cut.  ``remove`` drops masked rows in
    ``transform`` (M19 keeps them, flagged).  Local outlier factors compare fitted
    rows with one another; see :func:`outliers.lof`.
    """

    method = Param(Params._dummy(), "method", "kmeans | iforest", TypeConverters.toString)
    remove = Param(Params._dummy(), "remove", "drop masked rows", TypeConverters.toBoolean)
    keyCol = Param(Params._dummy(), "keyCol", "row key", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "clusters", TypeConverters.toInt)
    ratio = Param(Params._dummy(), "ratio", "smallest share of a valid cluster", TypeConverters.toFloat)
    contamination = Param(Params._dummy(), "contamination", "share of rows below the cut", TypeConverters.toFloat)
    trees = Param(Params._dummy(), "trees", "isolation trees", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="is_inlier", method="kmeans", remove=True,
                 keyCol="row_id", k=3, ratio=0.1, contamination=0.1, trees=100, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="is_inlier", method="kmeans", remove=True, keyCol="row_id",
                         k=3, ratio=0.1, contamination=0.1, trees=100, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "OutlierMaskModel":
        from . import outliers as ol
        get = self.getOrDefault
        data = df.select(get("keyCol"), F.col(self.getInputCol()).alias("features")) \
            .withColumnRenamed(get("keyCol"), "row_id")
        if get("method") == "kmeans":
            state = ol.kmeans_state(data, get("k"), get("ratio"), seed=get("seed"))
        elif get("method") == "iforest":
            state = ol.isolation_state(data, get("trees"), get("contamination"), get("seed"))
        else:
            raise ValueError(get("method"))
        return OutlierMaskModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), method=get("method"),
                                remove=get("remove"), state=json.dumps(state))


class OutlierMaskModel(Model, _ArrayParams, DefaultParamsReadable, DefaultParamsWritable):
    method = Param(Params._dummy(), "method", "kmeans | iforest", TypeConverters.toString)
    remove = Param(Params._dummy(), "remove", "drop masked rows", TypeConverters.toBoolean)
    state = Param(Params._dummy(), "state", "fitted centres or trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="is_inlier", method="kmeans", remove=True, state=None):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="is_inlier", method="kmeans", remove=True)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from . import outliers as ol
        state = json.loads(self.getOrDefault("state"))
        judge = ol.kmeans_judge if self.getOrDefault("method") == "kmeans" else ol.isolation_judge
        out = df.withColumn(self.getOutputCol(), judge(df.sparkSession, state)(F.col(self.getInputCol())))
        return out.where(F.col(self.getOutputCol())) if self.getOrDefault("remove") else out


# ------------------------------------------------------------- ridge model

class RidgeRegressor(Estimator, _ArrayParams, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Ridge on an array column from one distributed Gram pass."""

    alpha = Param(Params._dummy(), "alpha", "L2 penalty", TypeConverters.toFloat)
    standardize = Param(Params._dummy(), "standardize", "scale inside the fit", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="prediction", labelCol="y", alpha=1.0, standardize=False):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="prediction", labelCol="y", alpha=1.0, standardize=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "RidgeModel":
        from .decompose import origin, vector_suff
        from .linear import solve_ridge
        shift = origin(df, self.getInputCol(), self.getLabelCol())
        s = vector_suff(df, self.getInputCol(), self.getLabelCol(), shift=shift)[()]
        w, b = solve_ridge(s, self.getOrDefault("alpha"), self.getOrDefault("standardize"))
        b = b + shift[1] - float(np.atleast_1d(w) @ shift[0])   # back from the shifted origin
        return RidgeModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                          weights=[float(v) for v in np.atleast_1d(w)], intercept=float(b))


class RidgeModel(Model, _ArrayParams, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "coefficients", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="prediction", weights=None, intercept=0.0):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="prediction", intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        w = F.lit(np.array(self.getOrDefault("weights"), float))
        dot = F.aggregate(F.zip_with(F.col(self.getInputCol()), w, lambda a, b: a * b),
                          F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumn(self.getOutputCol(), dot + F.lit(self.getOrDefault("intercept")))


def named_pipeline(steps: list[tuple[str, Estimator]]) -> Pipeline:
    """A Pipeline whose stages carry the step names as the start of their uids."""
    for name, step in steps:
        step._resetUid(f"{name}_{step.uid.rsplit('_', 1)[-1]}")
    return Pipeline(stages=[s for _, s in steps])


def save_model(model: PipelineModel, path: str) -> None:
    """The fitted pipeline and every stage's parameters under one path."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """All stages back, in order (``.stages``)."""
    return PipelineModel.load(path)
