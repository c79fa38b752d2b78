"""Trials whose selection is applied inside the folds, and the refit of the best one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search as se
from ..operators import split as sp
from ..operators import trials as tl
from ..sources.tables import load
from .catalog import query
from .features import SQL_EMB_LONG
from .q_search import _sql_draw, _u

N_TRIALS, WIDTH, WIDE, K_RANGE, STEPS = 10, 64, 32, (4, 16), 160


def _rows(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").cast("double").alias("y"))


def _trials(spark):
    return se.sample_trials(spark, N_TRIALS, families=("ridge",), n_features=WIDTH, wide=WIDE, k_range=K_RANGE)


def _study(spark, sf_dir):
    folded = sp.folds(_rows(spark, sf_dir), "row_id", k=3, repeats=1)
    trials = _trials(spark)
    scores = tl.array_trial_scores(spark, folded, "features", "y", trials, wide=WIDE)
    return se.trial_score(scores).join(trials, "trial")


# Selected columns of every trial and fold, then ridge by conjugate gradients on the scaled product matrix.
def _sql_study(rows: str = "true", more: str = "") -> str:
    """Training sets of the folds of some rows, and of ``more`` fold numbers that no row has."""
    return f"""
{SQL_EMB_LONG.strip()},
tr AS (SELECT CAST(t AS INTEGER) AS trial, alpha, scaler, CASE WHEN sel = 'True' THEN k ELSE {WIDTH} END AS k FROM (
        SELECT trial AS t, {_sql_draw('ridge_alpha', 'log', 1e-3, 100.0)} AS alpha,
          ['robust', 'standard'][CAST(floor({_u('trial', 'scaler_type')} * 2) AS INTEGER) + 1] AS scaler,
          ['True', 'False'][CAST(floor({_u('trial', 'use_feature_selection')} * 2) AS INTEGER) + 1] AS sel,
          CAST({_sql_draw('k_features', 'int', *K_RANGE)} AS INTEGER) AS k FROM range({N_TRIALS}) r(trial))),
fr AS MATERIALIZED (SELECT row_id, feature_id AS f, value AS v, y, {sp.sql_fold('row_id', '0', 3)} AS fold FROM emb_long
      WHERE {rows}),
tf AS MATERIALIZED (SELECT b.fold, a.row_id, a.f, a.v, a.y FROM fr a JOIN (SELECT DISTINCT fold FROM fr {more}) b ON a.fold <> b.fold),
st AS MATERIALIZED (SELECT fold, f, avg(v) AS m, avg(y) AS my, stddev_pop(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr,
         corr(v, y) * corr(v, y) AS r2 FROM tf GROUP BY fold, f),
rk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY r2 DESC, f) AS place FROM st),
g AS MATERIALIZED (SELECT a.fold, a.f AS i, b.f AS j, sum((a.v - s.m) * (b.v - u.m)) AS c FROM tf a JOIN tf b USING (fold, row_id)
      JOIN st s ON s.fold = a.fold AND s.f = a.f JOIN st u ON u.fold = b.fold AND u.f = b.f GROUP BY a.fold, a.f, b.f),
h AS (SELECT t.fold, t.f, sum((t.v - s.m) * (t.y - s.my)) AS c FROM tf t JOIN st s USING (fold, f) GROUP BY t.fold, t.f),
d AS MATERIALIZED (SELECT tr.trial, tr.alpha, tr.k, rk.fold, rk.f, CASE WHEN tr.scaler = 'robust' THEN rk.iqr ELSE rk.sd END AS d
      FROM tr JOIN rk ON rk.place <= tr.k),
mat AS (SELECT a.trial, a.fold, a.f, list(g.c / (a.d * b.d) + CASE WHEN a.f = b.f THEN a.alpha ELSE 0 END ORDER BY b.f) AS row
        FROM d a JOIN d b USING (trial, fold) JOIN g ON g.fold = a.fold AND g.i = a.f AND g.j = b.f GROUP BY a.trial, a.fold, a.f),
sys AS MATERIALIZED (SELECT m.trial, m.fold, list(m.row ORDER BY m.f) AS a, list(h.c / d.d ORDER BY m.f) AS b, list(m.f ORDER BY m.f) AS fs,
        list(d.d ORDER BY m.f) AS ds FROM mat m JOIN d USING (trial, fold, f) JOIN h ON h.fold = m.fold AND h.f = m.f GROUP BY m.trial, m.fold),
cg(t, trial, fold, x, r, p, rs) AS (
  SELECT 0, trial, fold, list_transform(b, lambda z: 0.0::DOUBLE), b, b, list_dot_product(b, b) FROM sys
  UNION ALL
  SELECT t + 1, trial, fold, x2, r2, list_transform(range(1, len(p) + 1), lambda i: r2[i] + rs2 / rs * p[i]), rs2 FROM (
    SELECT *, list_dot_product(r2, r2) AS rs2 FROM (
      SELECT *, list_transform(range(1, len(p) + 1), lambda i: x[i] + rs / pap * p[i]) AS x2,
             list_transform(range(1, len(p) + 1), lambda i: r[i] - rs / pap * ap[i]) AS r2 FROM (
        SELECT *, list_dot_product(p, ap) AS pap FROM (
          SELECT c.*, list_transform(s.a, lambda q: list_dot_product(q, c.p)) AS ap FROM cg c JOIN sys s USING (trial, fold)
          WHERE c.t < {STEPS} AND c.rs > 1e-22)))))
"""
_SQL_SCORES = """
w AS (SELECT c.trial, c.fold, unnest(s.fs) AS f, unnest(list_transform(range(1, len(c.x) + 1), lambda i: c.x[i] / s.ds[i])) AS w
      FROM (SELECT *, row_number() OVER (PARTITION BY trial, fold ORDER BY t DESC) AS last FROM cg) c JOIN sys s USING (trial, fold)
      WHERE last = 1),
pred AS (SELECT w.trial, w.fold, v.row_id, any_value(v.y) AS y, any_value(st.my) + sum(w.w * (v.v - st.m)) AS p
         FROM w JOIN fr v ON v.fold = w.fold AND v.f = w.f JOIN st ON st.fold = w.fold AND st.f = w.f GROUP BY w.trial, w.fold, v.row_id),
sc AS (SELECT trial, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM pred GROUP BY trial, fold)
"""


@query("m34_selection_in_folds", f"""
WITH RECURSIVE {_sql_study()}, {_SQL_SCORES}
SELECT sc.trial, any_value(tr.k) AS n_features, round(any_value(tr.alpha), 6) AS alpha, count(*) AS n_folds,
       round(min(r2), 6) AS min_fold, round(avg(r2), 6) AS value
FROM sc JOIN tr USING (trial) GROUP BY sc.trial
""")
def m34_selection_in_folds(spark, sf_dir):
    """Ridge trials on the vectors, each with its own columns chosen inside every fold."""
    s = _study(spark, sf_dir)
    k = F.when(F.col("params")["use_feature_selection"] == "True", F.col("params")["k_features"].cast("int")).otherwise(WIDTH)
    return s.select("trial", k.alias("n_features"), F.round(F.col("params")["ridge_alpha"].cast("double"), 6).alias("alpha"),
                    "n_folds", F.round("min_fold", 6).alias("min_fold"), F.round("value", 6).alias("value"))


@query("m38_refit_best", f"""
WITH RECURSIVE {_sql_study(sp.sql_split('row_id') + " = 'train'", 'UNION ALL SELECT -1')}, {_SQL_SCORES},
best AS (SELECT trial FROM sc GROUP BY trial ORDER BY avg(r2) DESC, trial LIMIT 1),
test AS (SELECT e.row_id, any_value(e.y) AS y, any_value(st.my) + sum(w.w * (e.value - st.m)) AS p
         FROM emb_long e JOIN w ON w.f = e.feature_id AND w.fold = -1 JOIN best USING (trial)
         JOIN st ON st.fold = -1 AND st.f = w.f WHERE {sp.sql_split('e.row_id')} = 'test' GROUP BY e.row_id)
SELECT (SELECT trial FROM best) AS trial, (SELECT CAST(k AS INTEGER) FROM tr JOIN best USING (trial)) AS n_features,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS test_r2, round(avg((y - p) * (y - p)), 6) AS test_mse FROM test
""")
def m38_refit_best(spark, sf_dir):
    """The best saved trial refitted on the training rows, saved, loaded and measured on the test rows."""
    from ..operators.metrics import metrics
    from ..session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark)}/refit-{uuid.uuid4().hex}"
    split = sp.split(_rows(spark, sf_dir))
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    trials = _trials(spark)
    scores = tl.array_trial_scores(spark, sp.folds(train, "row_id", k=3, repeats=1), "features", "y", trials, wide=WIDE)
    se.save_trials(se.trial_score(scores).join(trials, "trial"), f"{base}/trials")
    best, model = tl.refit_best(spark, f"{base}/trials", train, "features", "y", wide=WIDE)
    model.save(spark, f"{base}/model")
    back = tl.TrialModel.load(spark, f"{base}/model")
    m = metrics(back.transform(test), "y", "prediction")
    return m.select(F.lit(int(best["trial"])).alias("trial"), F.lit(len(back.kept)).alias("n_features"),
                    F.round("r2", 6).alias("test_r2"), F.round("mse", 6).alias("test_mse"))
