"""Minimum slice: documents → features → split → ridge on train → metrics per split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.linear import ridge_1d
from ..operators.metrics import metrics
from ..operators.split import sql_split
from .features import SQL_DOC_FEATURES, doc_features_split

ALPHA = 1.0  # fixed value: the reference's ridge default


def ridge_split_metrics(spark: SparkSession, sf_dir: str, alpha: float = ALPHA) -> DataFrame:
    feats = doc_features_split(spark, sf_dir)
    slope, intercept = ridge_1d(feats.where(F.col("split") == "train"), "n_words", "y", alpha)
    scored = feats.withColumn("prediction", F.lit(intercept) + F.lit(slope) * F.col("n_words"))
    return metrics(scored, "y", "prediction", by=["split"])


SQL_RIDGE_SPLIT_METRICS = f"""
WITH {SQL_DOC_FEATURES.strip()},
s AS (SELECT *, {sql_split('row_id')} AS split FROM doc_features),
fit AS (
  SELECT covar_pop(n_words, y) * count(n_words) / (var_pop(n_words) * count(n_words) + {ALPHA}) AS slope,
         avg(y) AS my, avg(n_words) AS mx
  FROM s WHERE split = 'train'
),
p AS (SELECT s.split, s.y, (fit.my - fit.slope * fit.mx) + fit.slope * s.n_words AS prediction
      FROM s, fit)
SELECT split,
       CAST(count(*) AS BIGINT) AS n,
       round(CASE WHEN var_pop(y) * count(y) > 0
                  THEN 1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(y))
                  WHEN sum((y - prediction) * (y - prediction)) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2,
       round(avg(abs(y - prediction)), 6) AS mae,
       round(avg((y - prediction) * (y - prediction)), 6) AS mse,
       round(sqrt(avg((y - prediction) * (y - prediction))), 6) AS rmse
FROM p GROUP BY split
"""
