"""Metrics, parity and linear-model queries over ``documents`` features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import confidence_band, rate_gap
from ..operators import linear as lin
from ..operators import metrics as me
from ..operators import parity as pa
from ..operators import split as sp
from ..sources.sinks import metrics_long
from .catalog import query
from .features import DOC_FEATURES, SQL_DOC_FEATURES, doc_features_split
from .flagship import ALPHA

ALPHA_B = 1000.0  # second predictor of the parity job: a stronger penalty


def _split_docs(spark, sf_dir):
    return doc_features_split(spark, sf_dir)


def _two_models(spark, sf_dir):
    d = _split_docs(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    (sa, ia), (sb, ib) = lin.ridge_1d_many(train, "n_words", "y", [ALPHA, ALPHA_B])
    return d.select("row_id", "split", "y",
                    (F.lit(ia) + F.lit(sa) * F.col("n_words")).alias("pred_a"),
                    (F.lit(ib) + F.lit(sb) * F.col("n_words")).alias("pred_b"))


def _sql_two_models() -> str:
    return f"""{SQL_DOC_FEATURES.strip()},
s AS (SELECT *, {sp.sql_split('row_id')} AS split FROM doc_features),
fit AS (SELECT covar_pop(n_words, y) * count(*) AS sxy, var_pop(n_words) * count(*) AS sxx,
               avg(y) AS my, avg(n_words) AS mx FROM s WHERE split = 'train'),
p AS (SELECT s.row_id, s.split, s.y,
             (fit.my - fit.sxy / (fit.sxx + {ALPHA}) * fit.mx) + fit.sxy / (fit.sxx + {ALPHA}) * s.n_words AS pred_a,
             (fit.my - fit.sxy / (fit.sxx + {ALPHA_B}) * fit.mx) + fit.sxy / (fit.sxx + {ALPHA_B}) * s.n_words AS pred_b
      FROM s, fit)"""


_R2 = """CASE WHEN var_pop(y) * count(y) > 0
     THEN 1 - sum((y - {p}) * (y - {p})) / (var_pop(y) * count(y))
     WHEN sum((y - {p}) * (y - {p})) = 0 THEN 1.0 ELSE 0.0 END"""


@query("a4_metric_set_per_model", f"""
WITH {_sql_two_models()},
m AS (SELECT 'alpha_a' AS model, y, pred_a AS prediction FROM p UNION ALL SELECT 'alpha_b', y, pred_b FROM p)
SELECT model, CAST(count(*) AS BIGINT) AS n, round({_R2.format(p='prediction')}, 6) AS r2,
       round(avg(abs(y - prediction)), 6) AS mae, round(avg((y - prediction) * (y - prediction)), 6) AS mse,
       round(sqrt(avg((y - prediction) * (y - prediction))), 6) AS rmse,
       round(min(prediction), 6) AS pred_min, round(max(prediction), 6) AS pred_max,
       round(avg(prediction), 6) AS pred_mean
FROM m GROUP BY model
""")
def a4_metric_set_per_model(spark, sf_dir):
    p = _two_models(spark, sf_dir)
    stacked = p.select(F.lit("alpha_a").alias("model"), "y", F.col("pred_a").alias("prediction")) \
        .unionByName(p.select(F.lit("alpha_b").alias("model"), "y", F.col("pred_b").alias("prediction")))
    return me.metrics(stacked, "y", "prediction", by=["model"], with_range=True)


@query("m42_parity_report", f"""
WITH {_sql_two_models()},
d AS (SELECT pred_a, pred_b, abs(pred_a - pred_b) AS abs_diff FROM p),
r AS (SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs_diff), 6) AS mean_abs_diff,
             round(stddev_pop(abs_diff), 6) AS std_abs_diff, round(max(abs_diff), 6) AS max_abs_diff,
             round(min(abs_diff), 6) AS min_abs_diff,
             CAST(count(*) FILTER (WHERE abs_diff <= 0.5) AS BIGINT) AS n_within,
             round(corr(pred_a, pred_b), 6) AS corr FROM d)
SELECT *, round(n_within * 100.0 / n, 6) AS pct_within,
       CASE WHEN round(n_within * 100.0 / n, 6) >= 95 THEN 'PASS'
            WHEN round(n_within * 100.0 / n, 6) >= 90 THEN 'WARNING' ELSE 'FAIL' END AS verdict
FROM r
""")
def m42_parity_report(spark, sf_dir):
    p = _two_models(spark, sf_dir)
    pairs = pa.pair(p.select("row_id", "pred_a"), p.select("row_id", "pred_b"))
    return pa.parity(pairs)


@query("w1_accuracy_curve", f"""
WITH {_sql_two_models()},
d AS (SELECT row_id, abs(pred_a - pred_b) AS abs_diff FROM p)
SELECT row_id, CAST(row_number() OVER (ORDER BY abs_diff, row_id) AS BIGINT) AS k, round(abs_diff, 6) AS abs_diff,
       round(row_number() OVER (ORDER BY abs_diff, row_id) * 100.0 / count(*) OVER (), 6) AS cum_pct
FROM d
""")
def w1_accuracy_curve(spark, sf_dir):
    # both predictors score the rows in one pass, so the pairs need no join
    pairs = pa.pair_columns(_two_models(spark, sf_dir))
    return pa.accuracy_curve(pairs)


@query("a13_residual_histogram", f"""
WITH {_sql_two_models()},
r AS (SELECT y - pred_a AS residual FROM p),
b AS (SELECT min(residual) AS lo, max(residual) AS hi FROM r),
x AS (SELECT CAST(CASE WHEN b.hi - b.lo > 0 THEN least(19, floor((residual - b.lo) / (b.hi - b.lo) * 20)) ELSE 0 END AS INTEGER) AS bin,
             b.lo, b.hi FROM r, b)
SELECT bin, CAST(count(*) AS BIGINT) AS count, round(first(lo) + bin * first(hi - lo) / 20, 6) AS bin_lo,
       round(first(lo) + (bin + 1) * first(hi - lo) / 20, 6) AS bin_hi
FROM x GROUP BY bin
""")
def a13_residual_histogram(spark, sf_dir):
    p = me.residuals(_two_models(spark, sf_dir), "y", "pred_a")
    return me.histogram(p, "residual", 20)


@query("f1_confidence_bands", f"""
WITH {_sql_two_models()},
e AS (SELECT split, abs(y - pred_a) / y AS rel_err FROM p)
SELECT split, CASE WHEN rel_err <= 0.01 THEN 'EXCELLENT' WHEN rel_err <= 0.02 THEN 'GOOD'
                   WHEN rel_err <= 0.05 THEN 'FAIR' ELSE 'POOR' END AS band,
       CAST(count(*) AS BIGINT) AS n
FROM e GROUP BY 1, 2
""")
def f1_confidence_bands(spark, sf_dir):
    p = _two_models(spark, sf_dir)
    # an empty text has y = 0: no relative error, as in the SQL, which makes it POOR
    e = p.select("split", F.try_divide(F.abs(F.col("y") - F.col("pred_a")), F.col("y")).alias("rel_err"))
    return e.groupBy("split", confidence_band("rel_err").alias("band")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


@query("s9_metrics_long", f"""
WITH {_sql_two_models()},
m AS (SELECT split, CAST(count(*) AS DOUBLE) AS n, round({_R2.format(p='pred_a')}, 6) AS r2,
             round(avg(abs(y - pred_a)), 6) AS mae, round(avg((y - pred_a) * (y - pred_a)), 6) AS mse,
             round(sqrt(avg((y - pred_a) * (y - pred_a))), 6) AS rmse FROM p GROUP BY split)
SELECT split, key, value FROM m UNPIVOT (value FOR key IN (n, r2, mae, mse, rmse))
""")
def s9_metrics_long(spark, sf_dir):
    p = _two_models(spark, sf_dir)
    m = me.metrics(p, "y", "pred_a", by=["split"])
    return metrics_long(m, keys=("split",))


# ----------------------------------------------------------- CV ridge (1-D)

def _sql_cv_1d(rows_cte: str, fold_cte: str, alphas: str, standardize: bool,
               per_trial_scaler: bool = False) -> str:
    """SQL twin of the one-pass CV ridge for one feature ``x`` and target ``y``.

    ``rows_cte`` defines ``rows(row_id, x, y)``; ``fold_cte`` defines
    ``fr(rep, fold, x, y)`` from it; ``alphas`` is a SQL list literal or a
    SELECT producing ``(trial, alpha)`` rows.
    """
    if per_trial_scaler:
        # scaler fitted on the training rows of each fold: std from the Gram, IQR exactly
        solve = """0 AS sd, CASE scaler
                 WHEN 'standard' THEN (CASE WHEN sqrt(cxx / nt) = 0 THEN 1.0 ELSE sqrt(cxx / nt) END)
                 WHEN 'robust' THEN (CASE WHEN iqr = 0 THEN 1.0 ELSE iqr END) ELSE 1.0 END AS sdx"""
        w = "(cxy / sdx) / (cxx / (sdx * sdx) + alpha) / sdx"
    elif standardize:
        solve = """sqrt(cxx / nt) AS sd,
               CASE WHEN sqrt(cxx / nt) = 0 THEN 1.0 ELSE sqrt(cxx / nt) END AS sdx"""
        w = "(cxy / sdx) / (cxx / (sdx * sdx) + alpha) / sdx"
    else:
        solve = "0 AS sd, 1.0 AS sdx"
        w = "cxy / (cxx + alpha)"
    if per_trial_scaler:
        iqr_cte = """cv_f AS (SELECT DISTINCT rep, fold FROM fr),
cv_iqr AS (SELECT cv_f.rep, cv_f.fold, quantile_cont(fr.x, 0.75) - quantile_cont(fr.x, 0.25) AS iqr
           FROM cv_f JOIN fr ON fr.rep = cv_f.rep AND fr.fold <> cv_f.fold GROUP BY cv_f.rep, cv_f.fold),
"""
        iqr_from = "cv_c JOIN cv_iqr USING (rep, fold), cv_a"
    else:
        iqr_cte, iqr_from = "", "cv_c, cv_a"
    return f"""{rows_cte},
cv_sh AS (SELECT avg(x) AS mx, avg(y) AS my FROM rows),
{fold_cte},
cv_b AS (SELECT rep, fold, count(*) AS n, sum(x - mx) AS sx, sum(y - my) AS sy,
             sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy
      FROM fr, cv_sh GROUP BY rep, fold),
cv_t AS (SELECT rep, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy
      FROM cv_b GROUP BY rep),
cv_tr AS (SELECT cv_b.rep, cv_b.fold, cv_b.n, cv_b.sx, cv_b.sy, cv_b.sxx, cv_b.sxy, cv_b.syy,
              cv_t.n - cv_b.n AS nt, cv_t.sx - cv_b.sx AS tsx, cv_t.sy - cv_b.sy AS tsy, cv_t.sxx - cv_b.sxx AS tsxx, cv_t.sxy - cv_b.sxy AS tsxy
       FROM cv_b JOIN cv_t USING (rep)),
cv_c AS (SELECT *, tsxx - nt * (tsx / nt) * (tsx / nt) AS cxx, tsxy - nt * (tsx / nt) * (tsy / nt) AS cxy FROM cv_tr),
cv_a AS ({alphas if alphas.lstrip().upper().startswith('SELECT') else f'SELECT 0 AS trial, unnest({alphas}) AS alpha'}),
{iqr_cte}cv_s1 AS (SELECT cv_c.*, cv_a.trial, cv_a.alpha, {solve} FROM {iqr_from}),
cv_s2 AS (SELECT *, {w} AS w FROM cv_s1),
cv_s3 AS (SELECT *, tsy / nt - w * tsx / nt AS bb FROM cv_s2),
cv_sc AS (SELECT trial, CAST(rep AS INTEGER) AS repeat, CAST(fold AS INTEGER) AS fold, alpha,
              syy - 2 * w * sxy - 2 * bb * sy + w * w * sxx + 2 * bb * w * sx + n * bb * bb AS sse,
              syy - sy * sy / n AS sst FROM cv_s3),
scores AS (SELECT trial, repeat, fold, alpha,
                  CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM cv_sc)"""


def prefixed(sql: str, prefix: str, names=("rows", "fr", "scores")) -> str:
    """Rename the generator's CTEs so two CV blocks can share one statement."""
    import re
    sql = re.sub(r"\bcv_", f"{prefix}cv_", sql)
    for n in names:
        sql = re.sub(rf"\b{n}\b", f"{prefix}{n}", sql)
    return sql


_TRAIN_ROWS = f"""{SQL_DOC_FEATURES.strip()},
rows AS (SELECT row_id, n_words AS x, y FROM doc_features WHERE {sp.sql_split('row_id')} = 'train')"""
_HASH_FOLDS = f"""fr AS (SELECT rep, {sp.sql_fold('row_id', 'rep', 5)} AS fold, x, y FROM rows, range(3) r(rep))"""
_CONTIG_FOLDS = """fr AS (SELECT 0 AS rep, ntile(3) OVER (ORDER BY row_id) - 1 AS fold, x, y FROM rows)"""


def _train_docs(spark, sf_dir):
    return _split_docs(spark, sf_dir).where(F.col("split") == "train").drop("split")


@query("a5_noise_ceiling", f"""
WITH {_sql_cv_1d(_TRAIN_ROWS, _HASH_FOLDS, '[1.0]', False)}
SELECT alpha, CAST(count(*) AS BIGINT) AS n_folds, round(avg(r2), 6) AS baseline_r2,
       round(stddev_pop(r2), 6) AS std_r2, round(avg(r2) + 2 * stddev_pop(r2), 6) AS noise_ceiling
FROM scores GROUP BY alpha
""")
def a5_noise_ceiling(spark, sf_dir):
    folded = sp.folds(_train_docs(spark, sf_dir), "row_id", k=5, repeats=3)
    scores = lin.cv_ridge_scores(spark, folded, ["n_words"], "y", [1.0])
    return lin.noise_ceiling(scores)


@query("a6_noise_ceiling_floored", f"""
WITH {_sql_cv_1d(_TRAIN_ROWS, _CONTIG_FOLDS, '[1.0]', True)}
SELECT alpha, CAST(count(*) AS BIGINT) AS n_folds, round(avg(r2), 6) AS baseline_r2,
       round(stddev_pop(r2), 6) AS std_r2, round(greatest(avg(r2) + 2 * stddev_pop(r2), 0.99), 6) AS noise_ceiling
FROM scores GROUP BY alpha
""")
def a6_noise_ceiling_floored(spark, sf_dir):
    folded = sp.contiguous_folds(_train_docs(spark, sf_dir), "row_id", 3).withColumn("repeat", F.lit(0))
    scores = lin.cv_ridge_scores(spark, folded, ["n_words"], "y", [1.0], standardize=True)
    return lin.noise_ceiling(scores, floor=0.99)


@query("m23_ridge_fold_scores", f"""
WITH {_sql_cv_1d(_TRAIN_ROWS, _HASH_FOLDS, '[0.001, 1.0, 1000.0]', False)}
SELECT repeat, fold, alpha, round(r2, 6) AS r2 FROM scores
""")
def m23_ridge_fold_scores(spark, sf_dir):
    folded = sp.folds(_train_docs(spark, sf_dir), "row_id", k=5, repeats=3)
    s = lin.cv_ridge_scores(spark, folded, ["n_words"], "y", [0.001, 1.0, 1000.0])
    return s.select("repeat", "fold", "alpha", F.round("r2", 6).alias("r2"))


def _sql_cv_multi3(alpha: float) -> str:
    """SQL twin of the standardised three-feature CV ridge (5 folds × 3 repeats).

    Per-fold sums → training sums by subtraction → standardised normal
    equations solved by Cramer's rule → validation SSE from the fold's sums.
    """
    k = 3
    xs = ["n_words", "n_lines", "coalesce(avg_word_len, 0.0)"]
    idx = range(1, k + 1)
    pairs = [(i, j) for i in idx for j in idx if i <= j]
    cols = ", ".join(f"{x} AS x{i}" for i, x in zip(idx, xs))
    sums = ", ".join([f"sum(x{i} - m{i}) AS s{i}" for i in idx]
                     + [f"sum((x{i} - m{i}) * (x{j} - m{j})) AS s{i}{j}" for i, j in pairs]
                     + [f"sum((x{i} - m{i}) * (y - my)) AS sy{i}" for i in idx])
    tsum = ", ".join([f"sum(s{i}) AS ts{i}" for i in idx] + [f"sum(s{i}{j}) AS ts{i}{j}" for i, j in pairs]
                     + [f"sum(sy{i}) AS tsy{i}" for i in idx])
    means = ", ".join(f"avg(x{i}) AS m{i}" for i in idx)
    sym = lambda i, j: f"{min(i, j)}{max(i, j)}"
    cent = ", ".join([f"(t.ts{sym(i, j)} - j1.s{sym(i, j)}) - nt * mu{i} * mu{j} AS c{i}{j}" for i in idx for j in idx]
                     + [f"(t.tsy{i} - j1.sy{i}) - nt * mu{i} * nu AS cy{i}" for i in idx])
    mu = ", ".join(f"(t.ts{i} - b.s{i}) / nt AS mu{i}" for i in idx)
    sd = ", ".join(f"CASE WHEN sqrt(c{i}{i} / nt) = 0 THEN 1.0 ELSE sqrt(c{i}{i} / nt) END AS d{i}" for i in idx)
    a = ", ".join(f"c{i}{j} / (d{i} * d{j}){' + ' + repr(alpha) if i == j else ''} AS a{i}{j}"
                  for i in idx for j in idx) + ", " + ", ".join(f"cy{i} / d{i} AS r{i}" for i in idx)

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]})"
                f" - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
    base = [[f"a{i}{j}" for j in idx] for i in idx]
    dets = []
    for c in range(k):
        m = [row[:] for row in base]
        for r in range(k):
            m[r][c] = f"r{r + 1}"
        dets.append(f"{det(m)} / {det(base)} / d{c + 1} AS w{c + 1}")
    wcols = ", ".join(dets)
    bb = "nu - (" + " + ".join(f"w{i} * mu{i}" for i in idx) + ")"
    quad = " + ".join(f"w{i} * w{j} * s{sym(i, j)}" for i in idx for j in idx)
    sse = (f"syy - 2 * ({' + '.join(f'w{i} * sy{i}' for i in idx)}) - 2 * bb * sy + ({quad})"
           f" + 2 * bb * ({' + '.join(f'w{i} * s{i}' for i in idx)}) + n * bb * bb")
    return f"""{SQL_DOC_FEATURES.strip()},
rows AS (SELECT row_id, {cols}, y FROM doc_features WHERE {sp.sql_split('row_id')} = 'train'),
fr AS (SELECT rep, {sp.sql_fold('row_id', 'rep', 5)} AS fold, x1, x2, x3, y FROM rows, range(3) r(rep)),
sh AS (SELECT {means}, avg(y) AS my FROM fr),
b AS (SELECT rep, fold, count(*) AS n, sum(y - my) AS sy, sum((y - my) * (y - my)) AS syy, {sums}
      FROM fr, sh GROUP BY rep, fold),
t AS (SELECT rep, sum(n) AS tn, sum(sy) AS tsy, {tsum} FROM b GROUP BY rep),
j1 AS (SELECT b.*, t.tn - b.n AS nt, (t.tsy - b.sy) / (t.tn - b.n) AS nu, {mu.replace('nt', '(t.tn - b.n)')}
       FROM b JOIN t USING (rep)),
j2 AS (SELECT j1.*, {cent} FROM j1 JOIN t USING (rep)),
j3 AS (SELECT *, {sd} FROM j2),
j4 AS (SELECT *, {a} FROM j3),
j5 AS (SELECT *, {wcols} FROM j4),
j6 AS (SELECT *, {bb} AS bb FROM j5),
sc AS (SELECT rep, fold, {sse} AS sse, syy - sy * sy / n AS sst FROM j6),
scores AS (SELECT CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM sc)
SELECT {alpha!r} AS alpha, CAST(count(*) AS BIGINT) AS n_folds, round(avg(r2), 6) AS baseline_r2,
       round(stddev_pop(r2), 6) AS std_r2, round(avg(r2) + 2 * stddev_pop(r2), 6) AS noise_ceiling FROM scores"""


@query("m23_ridge_multi_feature_cv", "WITH " + _sql_cv_multi3(1.0))
def m23_ridge_multi_feature_cv(spark, sf_dir):
    """Three document features, standardised inside each fold (rows-only check)."""
    folded = sp.folds(_train_docs(spark, sf_dir).na.fill(0.0, ["avg_word_len"]), "row_id", k=5, repeats=3)
    scores = lin.cv_ridge_scores(spark, folded, list(DOC_FEATURES), "y", [1.0], standardize=True)
    return lin.noise_ceiling(scores)


@query("m24_ridge_loo_alphas")
def m24_ridge_loo_alphas(spark, sf_dir):
    """Leave-one-out MSE for 50 log-spaced alphas from one extra data pass."""
    import numpy as np
    train = _train_docs(spark, sf_dir).na.fill(0.0, ["avg_word_len"])
    alphas = list(10.0 ** (-3 + 5 * np.arange(50) / 49))
    return lin.ridge_loo(train, list(DOC_FEATURES), "y", alphas)


@query("m24_ridge_loo_1d", f"""
WITH {_TRAIN_ROWS},
st AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx,
              covar_pop(x, y) * count(*) AS sxy FROM rows),
a AS (SELECT pow(10, -3 + 5 * i / 49) AS alpha FROM range(50) t(i)),
e AS (SELECT a.alpha,
             (rows.y - (st.my + st.sxy / (st.sxx + a.alpha) * (rows.x - st.mx)))
             / (1 - (1.0 / st.n + (rows.x - st.mx) * (rows.x - st.mx) / (st.sxx + a.alpha))) AS loo
      FROM rows, st, a)
SELECT round(alpha, 6) AS alpha, round(avg(loo * loo), 4) AS loo_mse FROM e GROUP BY alpha
""")
def m24_ridge_loo_1d(spark, sf_dir):
    """Leave-one-out MSE of one-feature ridge for the 50-point log grid."""
    import numpy as np
    alphas = list(10.0 ** (-3 + 5 * np.arange(50) / 49))
    r = lin.ridge_loo(_train_docs(spark, sf_dir), ["n_words"], "y", alphas, digits=4)
    return r.select(F.round("alpha", 6).alias("alpha"), "loo_mse")


@query("m25_m26_sparse_linear")
def m25_m26_sparse_linear(spark, sf_dir):
    """Lasso and elastic net on MLlib; test-split metrics per model (rows-only)."""
    d = _split_docs(spark, sf_dir).na.fill(0.0, ["avg_word_len"])
    train = d.where(F.col("split") == "train")
    test = d.where(F.col("split") == "test")
    from pyspark.ml.feature import VectorAssembler
    out = None
    for name, model in (("lasso", lin.lasso(train, list(DOC_FEATURES), "y", 1.0)),
                        ("elastic_net", lin.elastic_net(train, list(DOC_FEATURES), "y", 1.0, 0.5))):
        vec = VectorAssembler(inputCols=list(DOC_FEATURES), outputCol="__features").transform(test)
        m = me.metrics(model.transform(vec), "y", "prediction").withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


@query("f2_ceiling_gap_rating", f"""
WITH {_sql_cv_1d(_TRAIN_ROWS, _HASH_FOLDS, '[1.0]', False)},
ceil AS (SELECT avg(r2) + 2 * stddev_pop(r2) AS ceiling FROM scores),
{SQL_DOC_FEATURES.strip().replace('doc_features AS', 'df2 AS', 1)},
s AS (SELECT *, {sp.sql_split('row_id')} AS split FROM df2),
fit AS (SELECT covar_pop(n_words, y) * count(*) AS sxy, var_pop(n_words) * count(*) AS sxx,
               avg(y) AS my, avg(n_words) AS mx FROM s WHERE split = 'train'),
p AS (SELECT s.y, (fit.my - fit.sxy / (fit.sxx + {ALPHA}) * fit.mx) + fit.sxy / (fit.sxx + {ALPHA}) * s.n_words AS pred
      FROM s, fit WHERE s.split = 'test'),
r AS (SELECT {_R2.format(p='pred')} AS r2 FROM p)
SELECT round(ceil.ceiling, 6) AS noise_ceiling, round(r.r2, 6) AS test_r2,
       CASE WHEN abs(ceil.ceiling - r.r2) <= 0.01 THEN 'excellent'
            WHEN abs(ceil.ceiling - r.r2) <= 0.02 THEN 'near' ELSE 'room' END AS rating,
       r.r2 >= 0.95 AS target_met
FROM ceil, r
""")
def f2_ceiling_gap_rating(spark, sf_dir):
    folded = sp.folds(_train_docs(spark, sf_dir), "row_id", k=5, repeats=3)
    nc = lin.noise_ceiling(lin.cv_ridge_scores(spark, folded, ["n_words"], "y", [1.0])).first()
    p = _two_models(spark, sf_dir).where(F.col("split") == "test")
    # the ceiling is one number computed above; carry it as a literal
    ceiling = F.lit(float(nc["noise_ceiling"]))
    raw = p.agg(me.r2_expr(F.sum((F.col("y") - F.col("pred_a")) ** 2),
                           F.var_pop("y") * F.count("y")).alias("r2"))
    return raw.select(F.round(ceiling, 6).alias("noise_ceiling"), F.round("r2", 6).alias("test_r2"),
                      rate_gap(ceiling, F.col("r2")).alias("rating"),
                      me.target_met(F.col("r2"), 0.95).alias("target_met"))
