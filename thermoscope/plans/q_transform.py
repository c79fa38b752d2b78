"""Decomposition and distribution-transform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decompose as dc
from ..operators import split as sp
from ..operators import transforms as tf
from ..operators.linear import ridge_1d
from ..operators.metrics import metrics
from ..sources.tables import load
from .catalog import query
from .features import SQL_DOC_FEATURES, SQL_EMB_LONG, doc_features_split, embedding_long


def _vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").cast("double").alias("y"))


@query("m11_pca_explained_variance")
def m11_pca_explained_variance(spark, sf_dir):
    """Centred PCA keeping 90 % of the variance (components chosen by fraction)."""
    fit = dc.pca_fit(_vectors(spark, sf_dir), "features", 0.9)
    t = dc.pca_table(fit, spark)
    return t.select("component", F.round("explained_variance", 9).alias("explained_variance"),
                    F.round("ratio", 9).alias("ratio"), F.round("cumulative", 9).alias("cumulative"))


@query("m11_pca_projection")
def m11_pca_projection(spark, sf_dir):
    """Every vector projected on the first 8 principal axes."""
    v = _vectors(spark, sf_dir)
    fit = dc.pca_fit(v, "features", 8)
    p = dc.project(v, "features", fit)
    return p.select("row_id", F.posexplode("components").alias("component", "score")) \
        .select("row_id", "component", F.round("score", 9).alias("score"))


@query("m12_truncated_svd")
def m12_truncated_svd(spark, sf_dir):
    fit = dc.svd_fit(_vectors(spark, sf_dir), "features", 10)
    rows = [(i, round(float(s), 8)) for i, s in enumerate(fit["singular_values"])]
    return spark.createDataFrame(rows, "component int, singular_value double")


@query("m13_kernel_pca")
def m13_kernel_pca(spark, sf_dir):
    """RBF kernel PCA (random Fourier features, declared approximation), 5 components."""
    proj, fit = dc.kernel_pca(_vectors(spark, sf_dir), "features", 5)
    return proj.select("row_id", F.posexplode("components").alias("component", "score"))


_D = 64
# Every set of rows as one matrix (set -1: all rows): swept pivot by pivot to its inverse, then features leave one by one.
_SQL_RFE = f"""
WITH RECURSIVE {SQL_EMB_LONG.strip()},
fr AS MATERIALIZED (SELECT row_id, feature_id + 1 AS f, value AS v, y, {sp.sql_fold('row_id', '0', 3)} AS fold FROM emb_long),
tf AS MATERIALIZED (SELECT b.fold, a.row_id, a.f, a.v, a.y FROM fr a JOIN (SELECT DISTINCT fold FROM fr UNION ALL SELECT -1) b ON a.fold <> b.fold),
st AS MATERIALIZED (SELECT fold, f, avg(v) AS m, avg(y) AS my, stddev_pop(v) AS sd FROM tf GROUP BY fold, f),
z AS MATERIALIZED (SELECT fold, row_id, f, (v - m) / sd AS v, y - my AS y FROM tf JOIN st USING (fold, f)),
g AS (SELECT a.fold, a.f AS i, b.f AS j, sum(a.v * b.v) + CASE WHEN a.f = b.f THEN 1.0 ELSE 0.0 END AS c
      FROM z a JOIN z b USING (fold, row_id) GROUP BY a.fold, a.f, b.f),
mat AS (SELECT fold, i, list(c ORDER BY j) AS row FROM g GROUP BY fold, i),
rhs AS (SELECT fold, list(c ORDER BY f) AS c FROM (SELECT fold, f, sum(v * y) AS c FROM z GROUP BY fold, f) GROUP BY fold),
sw(t, fold, a) AS (
  SELECT 1, fold, list(row ORDER BY i) FROM mat GROUP BY fold
  UNION ALL
  SELECT t + 1, fold, list_transform(range(1, {_D} + 1), lambda i: list_transform(range(1, {_D} + 1), lambda j:
    CASE WHEN i = t AND j = t THEN -1 / a[t][t] WHEN i = t OR j = t THEN a[i][j] / a[t][t] ELSE a[i][j] - a[i][t] * a[t][j] / a[t][t] END))
  FROM sw WHERE t <= {_D}),
inv AS MATERIALIZED (SELECT fold, list_transform(a, lambda r: list_transform(r, lambda x: -x)) AS p FROM sw WHERE t = {_D} + 1),
start AS MATERIALIZED (SELECT fold, p, list_transform(p, lambda r: list_dot_product(r, c)) AS w FROM inv JOIN rhs USING (fold)),
el(t, p, w, act, j) AS (
  SELECT 0, p, w, range(1, {_D} + 1), NULL::BIGINT FROM start WHERE fold = -1
  UNION ALL
  SELECT t + 1, list_transform(range(1, {_D} + 1), lambda i: list_transform(range(1, {_D} + 1), lambda k: p[i][k] - p[i][q] * p[q][k] / p[q][q])),
         list_transform(range(1, {_D} + 1), lambda i: w[i] - p[i][q] * w[q] / p[q][q]), list_filter(act, lambda f: f <> q), q
  FROM (SELECT *, act[list_position(vals, list_min(vals))] AS q FROM (
    SELECT *, list_transform(act, lambda f: abs(w[f])) AS vals FROM el WHERE t < {_D} - 1))),
ord AS MATERIALIZED (SELECT t, j, act FROM el),
fo(t, fold, p, w) AS (
  SELECT 0, fold, p, w FROM start WHERE fold >= 0
  UNION ALL
  SELECT s.t + 1, fold, list_transform(range(1, {_D} + 1), lambda i: list_transform(range(1, {_D} + 1), lambda k:
         p[i][k] - p[i][j] * p[j][k] / p[j][j])), list_transform(range(1, {_D} + 1), lambda i: w[i] - p[i][j] * w[j] / p[j][j])
  FROM fo s JOIN ord o ON o.t = s.t + 1),
wt AS (SELECT fo.t, fo.fold, a.f, fo.w[a.f] AS w FROM fo JOIN (SELECT t, unnest(act) AS f FROM ord) a USING (t)),
pr AS (SELECT wt.t, wt.fold, r.row_id, any_value(r.y) AS y, any_value(st.my) + sum(wt.w * (r.v - st.m) / st.sd) AS p
       FROM wt JOIN fr r ON r.fold = wt.fold AND r.f = wt.f JOIN st ON st.fold = wt.fold AND st.f = wt.f GROUP BY wt.t, wt.fold, r.row_id),
sc AS (SELECT t, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM pr GROUP BY t, fold),
cv AS (SELECT t, avg(r2) AS r2 FROM sc GROUP BY t)
SELECT CAST(len(act) AS BIGINT) AS n_features, round(r2, 6) AS cv_r2,
       array_to_string(list_transform(act, lambda f: f - 1), ',') AS features, r2 = (SELECT max(r2) FROM cv) AS chosen FROM cv JOIN ord USING (t)
"""


@query("m14_rfe_cv", _SQL_RFE)
def m14_rfe_cv(spark, sf_dir):
    """Recursive elimination over the 64 vector dimensions, 3-fold CV per subset size."""
    v = _vectors(spark, sf_dir)
    folded = sp.folds(v, "row_id", k=3, repeats=1)
    res = dc.rfe_cv(folded, "features", "y")
    res = res.assign(features=res["features"].map(lambda f: ",".join(str(int(i)) for i in f)), cv_r2=res["cv_r2"].round(6))
    return spark.createDataFrame(res, "n_features long, cv_r2 double, features string, chosen boolean")


@query("m15_quantile_transform", f"""
WITH {SQL_EMB_LONG.strip()}
SELECT row_id, feature_id,
       round(CASE WHEN count(*) OVER (PARTITION BY feature_id) > 1
                  THEN (rank() OVER (PARTITION BY feature_id ORDER BY value)
                        + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 - 1)
                       / (count(*) OVER (PARTITION BY feature_id) - 1) ELSE 0.0 END, 6) AS quantile
FROM emb_long
""")
def m15_quantile_transform(spark, sf_dir):
    q = tf.quantile_transform(embedding_long(spark, sf_dir, with_target=False))
    return q.select("row_id", "feature_id", F.round("quantile", 6).alias("quantile"))


def _yj_sql(x: str, lam: str) -> str:
    return (f"CASE WHEN {x} >= 0 THEN (CASE WHEN abs({lam}) < 1e-12 THEN ln({x} + 1) "
            f"ELSE (pow({x} + 1, {lam}) - 1) / {lam} END) "
            f"ELSE (CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {x}) "
            f"ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END) END")


_YJ_SQL = _yj_sql("x", "lam")


@query("m16_yeo_johnson_lambda", f"""
WITH {SQL_EMB_LONG.strip()},
g AS (SELECT feature_id, value AS x, unnest([{', '.join(repr(float(v)) for v in tf.YJ_GRID)}]) AS lam FROM emb_long),
t AS (SELECT feature_id, lam, x, {_YJ_SQL} AS psi FROM g),
s AS (SELECT feature_id, lam, -count(*) / 2 * ln(var_pop(psi)) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS ll
      FROM t GROUP BY feature_id, lam)
SELECT feature_id, round(arg_max(lam, ll), 6) AS lambda FROM s GROUP BY feature_id
""")
def m16_yeo_johnson_lambda(spark, sf_dir):
    lam, _ = tf.yeo_johnson(embedding_long(spark, sf_dir, with_target=False))
    return lam.select("feature_id", F.round("lambda", 6).alias("lambda"))


@query("m16_yeo_johnson_transform", f"""
WITH {SQL_EMB_LONG.strip()},
g AS (SELECT feature_id, value AS x, unnest([{', '.join(repr(float(v)) for v in tf.YJ_GRID)}]) AS lam FROM emb_long),
t AS (SELECT feature_id, lam, x, {_YJ_SQL} AS psi FROM g),
s AS (SELECT feature_id, lam, -count(*) / 2 * ln(var_pop(psi)) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS ll
      FROM t GROUP BY feature_id, lam),
best AS (SELECT feature_id, arg_max(lam, ll) AS lam FROM s GROUP BY feature_id),
tt AS (SELECT e.row_id, e.feature_id, {_yj_sql('e.value', 'best.lam')} AS psi
       FROM emb_long e JOIN best USING (feature_id)),
m AS (SELECT feature_id, avg(psi) AS mu, stddev_pop(psi) AS sd FROM tt GROUP BY feature_id)
SELECT row_id, feature_id, round((psi - mu) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 6) AS transformed
FROM tt JOIN m USING (feature_id)
""")
def m16_yeo_johnson_transform(spark, sf_dir):
    _, out = tf.yeo_johnson(embedding_long(spark, sf_dir, with_target=False))
    return out.select("row_id", "feature_id", F.round("transformed", 6).alias("transformed"))


def _refined_sql(levels: int) -> str:
    """The likeliest power by ever finer grids: 21 values around the best so far, one tenth of the step each time."""
    parts, before = [], "SELECT DISTINCT feature_id, 0.0::DOUBLE AS lam FROM fitted_rows"
    for t in range(levels):
        parts.append(f"""
b{t} AS MATERIALIZED (SELECT feature_id, arg_max(lam, ll) AS lam FROM (
  SELECT feature_id, lam, -count(*) / 2.0 * ln(var_pop(psi)) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS ll FROM (
    SELECT r.feature_id, r.value AS x, c.lam, {_yj_sql('r.value', 'c.lam')} AS psi FROM fitted_rows r JOIN (
      SELECT feature_id, lam + (k - 20) * 5.0 * pow(10, {-t - 1}) AS lam FROM ({before}), range(41) s(k)) c USING (feature_id))
  GROUP BY feature_id, lam) GROUP BY feature_id)""")
        before = f"SELECT feature_id, lam FROM b{t}"
    return ",".join(parts)


@query("m16_yeo_johnson_fitted", f"""
WITH {SQL_EMB_LONG.strip()},
fitted_rows AS MATERIALIZED (SELECT * FROM emb_long WHERE row_id % 2 = 0),
{_refined_sql(9)},
m AS (SELECT feature_id, lam, avg(psi) AS mu, stddev_pop(psi) AS sd FROM (
        SELECT feature_id, lam, {_yj_sql('value', 'lam')} AS psi FROM fitted_rows JOIN b8 USING (feature_id)) GROUP BY feature_id, lam)
SELECT feature_id, round(any_value(lam), 3) AS lambda, count(*) AS n,
       round(avg(({_yj_sql('e.value', 'm.lam')} - mu) / sd), 4) AS mean_new
FROM emb_long e JOIN m USING (feature_id) WHERE row_id % 2 <> 0 GROUP BY feature_id
""")
def m16_yeo_johnson_fitted(spark, sf_dir):
    """Powers fitted to the even rows by bracketing, applied to the odd ones."""
    long = embedding_long(spark, sf_dir, with_target=False)
    fit = tf.fit_yeo_johnson(long.where("row_id % 2 = 0"))
    new = tf.apply_yeo_johnson(long.where("row_id % 2 <> 0"), fit)
    return new.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("transformed"), 4).alias("mean_new")) \
        .join(fit.select("feature_id", F.round("lambda", 3).alias("lambda")), "feature_id")


@query("m15_quantile_fitted", f"""
WITH {SQL_EMB_LONG.strip()},
q AS MATERIALIZED (SELECT feature_id, unnest(range(21)) AS k, unnest(vs) AS v FROM (
       SELECT feature_id, quantile_cont(value, [{', '.join(repr(i / 20) for i in range(21))}]) AS vs FROM emb_long
       WHERE row_id % 2 = 0 GROUP BY feature_id)),
seg AS (SELECT feature_id, k, v AS lo, lead(v) OVER (PARTITION BY feature_id ORDER BY k) AS hi FROM q),
ends AS (SELECT feature_id, min(v) AS a, max(v) AS b FROM q GROUP BY feature_id)
SELECT e.row_id, e.feature_id, round(CASE WHEN e.value <= any_value(ends.a) THEN 0.0 WHEN e.value >= any_value(ends.b) THEN 1.0
       ELSE avg((s.k + (e.value - s.lo) / (s.hi - s.lo)) / 20.0) END, 6) AS quantile
FROM emb_long e JOIN ends USING (feature_id) LEFT JOIN seg s ON s.feature_id = e.feature_id AND e.value >= s.lo AND e.value <= s.hi
     AND s.hi > s.lo WHERE e.row_id % 2 <> 0 GROUP BY e.row_id, e.feature_id, e.value
""")
def m15_quantile_fitted(spark, sf_dir):
    """Twenty-one quantiles of the even rows, applied to the odd ones."""
    long = embedding_long(spark, sf_dir, with_target=False)
    fit = tf.fit_quantiles(long.where("row_id % 2 = 0"), 21)
    return tf.apply_quantiles(long.where("row_id % 2 <> 0"), fit).select(
        "row_id", "feature_id", F.round("quantile", 6).alias("quantile"))


@query("m17_target_transform", f"""
WITH {SQL_DOC_FEATURES.strip()},
s AS (SELECT *, {sp.sql_split('row_id')} AS split, ln(1 + y) AS gy FROM doc_features),
fit AS (SELECT covar_pop(n_words, gy) * count(*) / (var_pop(n_words) * count(*) + 1.0) AS slope,
               avg(gy) AS my, avg(n_words) AS mx FROM s WHERE split = 'train'),
p AS (SELECT s.split, s.y, exp((fit.my - fit.slope * fit.mx) + fit.slope * s.n_words) - 1 AS prediction FROM s, fit)
SELECT split, CAST(count(*) AS BIGINT) AS n,
       round(CASE WHEN var_pop(y) * count(y) > 0 THEN 1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(y))
                  WHEN sum((y - prediction) * (y - prediction)) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2,
       round(avg(abs(y - prediction)), 6) AS mae, round(avg((y - prediction) * (y - prediction)), 6) AS mse,
       round(sqrt(avg((y - prediction) * (y - prediction))), 6) AS rmse
FROM p GROUP BY split
""")
def m17_target_transform(spark, sf_dir):
    d = doc_features_split(spark, sf_dir)

    def fit(g, target):
        slope, icpt = ridge_1d(g.where(F.col("split") == "train"), "n_words", target, 1.0)
        return lambda frame: F.lit(icpt) + F.lit(slope) * F.col("n_words")

    p = tf.with_target(d, "y", F.log1p, fit, F.expm1)
    return metrics(p, "y", "prediction", by=["split"])
