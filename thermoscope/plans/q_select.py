"""Feature selection and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scale as sc
from ..operators import select as se
from ..operators import stats as st
from ..session import materialize
from ..sources.tables import load
from .catalog import query
from .features import SQL_DOC_FEATURES, SQL_EMB_LONG, doc_features, embedding_long

VARIANCE_THRESHOLD = 1e-8  # fixed value: default variance cut
RATIO = "1:4"              # a NUM:DEN selection ratio

_F_SQL = """
f AS (SELECT feature_id, CAST(count(value) AS BIGINT) AS n, corr(value, y) AS r FROM emb_long GROUP BY feature_id),
fs AS (SELECT feature_id, n, CASE WHEN r IS NULL THEN 0.0 ELSE r * r / (1 - r * r) * (n - 2) END AS score FROM f)"""


@query("a18_f_scores", f"""
WITH {SQL_EMB_LONG.strip()},{_F_SQL}
SELECT feature_id, n, round(score, 6) AS score FROM fs
""")
def a18_f_scores(spark, sf_dir):
    s = se.f_scores(embedding_long(spark, sf_dir))
    return s.select("feature_id", "n", F.round("score", 6).alias("score"))


@query("m8_select_k_best_ratio", f"""
WITH {SQL_EMB_LONG.strip()},{_F_SQL},
r AS (SELECT feature_id, score, row_number() OVER (ORDER BY score DESC, feature_id) AS rank FROM fs)
SELECT feature_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r
WHERE rank <= greatest(1, least((SELECT count(*) FROM fs), floor((SELECT count(*) FROM fs) * 1.0 / 4)))
""")
def m8_select_k_best_ratio(spark, sf_dir):
    s = se.f_scores(embedding_long(spark, sf_dir))
    t = se.top_k(s, ratio=RATIO)
    return t.select("feature_id", F.round("score", 6).alias("score"), "rank")


@query("m7_variance_threshold", f"""
WITH {SQL_EMB_LONG.strip()}
SELECT feature_id, round(var_pop(value), 6) AS var_pop, var_pop(value) > {VARIANCE_THRESHOLD} AS keep
FROM emb_long GROUP BY feature_id
""")
def m7_variance_threshold(spark, sf_dir):
    long = embedding_long(spark, sf_dir, with_target=False)
    v = long.groupBy("feature_id").agg(F.var_pop("value").alias("var_pop"))
    k = se.variance_keep(v, VARIANCE_THRESHOLD)
    return k.select("feature_id", F.round("var_pop", 6).alias("var_pop"), "keep")


@query("t3_width_reduction", f"""
WITH {SQL_EMB_LONG.strip()},{_F_SQL},
v AS (SELECT feature_id, var_pop(value) AS var_pop FROM emb_long GROUP BY feature_id)
SELECT v.feature_id, round(fs.score, 6) AS score, round(v.var_pop, 6) AS var_pop,
       CASE WHEN (SELECT count(*) FROM v) > 5000 THEN v.var_pop > 0.1 ELSE true END AS keep,
       CASE WHEN (SELECT count(*) FROM v) > 5000 THEN 'variance' ELSE 'none' END AS stage
FROM v JOIN fs USING (feature_id)
""")
def t3_width_reduction(spark, sf_dir):
    long = embedding_long(spark, sf_dir)
    stats = long.groupBy("feature_id").agg(F.var_pop("value").alias("var_pop"))
    scores = se.f_scores(long)
    t = se.reduce_width(stats, scores)
    return t.select("feature_id", F.round("score", 6).alias("score"),
                    F.round("var_pop", 6).alias("var_pop"), "keep", "stage")


# One feature per order of four lines or more: thousands of features at sf0.01, so both rules fire.
_WIDE_SQL = """
o AS (SELECT l_orderkey AS feature_id, l_discount * 14 AS value, l_quantity AS y FROM lineitem),
v AS (SELECT feature_id, var_pop(value) AS var_pop, count(*) AS n,
             CASE WHEN var_pop(value) < 1e-12 OR var_pop(y) < 1e-12 THEN 0.0 ELSE corr(value, y) END AS r
      FROM o GROUP BY feature_id HAVING count(*) >= 4),
w AS (SELECT feature_id, var_pop, CASE WHEN r * r >= 1 THEN 1e300 ELSE r * r / (1 - r * r) * (n - 2) END AS score,
             count(*) OVER () AS width FROM v),
c AS (SELECT *, CASE WHEN width > 5000 THEN var_pop > 0.1 ELSE true END AS pass FROM w),
k AS (SELECT *, count(*) FILTER (WHERE pass) OVER () AS remaining,
             row_number() OVER (PARTITION BY pass ORDER BY score DESC, feature_id) AS rk FROM c)"""


@query("t3_width_reduction_wide", f"""
WITH {_WIDE_SQL.strip()}
SELECT feature_id, round(var_pop, 6) AS var_pop,
       pass AND (remaining <= 2000 OR rk <= least(2000, remaining // 2)) AS keep,
       CASE WHEN width > 5000 THEN 'variance' || CASE WHEN remaining > 2000 THEN '+top_k' ELSE '' END
            WHEN remaining > 2000 THEN 'top_k' ELSE 'none' END AS stage
FROM k
""")
def t3_width_reduction_wide(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem", "l_orderkey", "l_discount", "l_quantity")
    long = lines.select(F.col("l_orderkey").alias("feature_id"), (F.col("l_discount") * 14).alias("value"),
                        F.col("l_quantity").alias("y"))
    stats = long.groupBy("feature_id").agg(F.var_pop("value").alias("var_pop"), F.var_pop("y").alias("vy"),
                                           F.count("value").alias("n")).where("n >= 4")
    flat = (F.col("var_pop") < 1e-12) | (F.col("vy") < 1e-12)
    scores = se.f_scores(long).drop("n").join(stats.select("feature_id", flat.alias("flat")), "feature_id") \
        .withColumn("score", F.when(F.col("flat"), F.lit(0.0)).otherwise(F.col("score")))
    t = se.reduce_width(stats, scores)
    return t.select("feature_id", F.round("var_pop", 6).alias("var_pop"), "keep", "stage")


@query("a19_mi_scores", f"""
WITH {SQL_EMB_LONG.strip()},
b AS (SELECT feature_id, min(value) AS lo, max(value) AS hi FROM emb_long GROUP BY feature_id),
x AS (SELECT e.feature_id,
             CAST(CASE WHEN b.hi - b.lo > 0 THEN least(9, floor((e.value - b.lo) / (b.hi - b.lo) * 10)) ELSE 0 END AS INTEGER) AS xb,
             e.y AS yb FROM emb_long e JOIN b USING (feature_id)),
j AS (SELECT feature_id, xb, yb, count(*) AS nxy FROM x GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY feature_id) AS n,
             sum(nxy) OVER (PARTITION BY feature_id, xb) AS nx,
             sum(nxy) OVER (PARTITION BY feature_id, yb) AS ny FROM j)
SELECT feature_id, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS score FROM m GROUP BY feature_id
""")
def a19_mi_scores(spark, sf_dir):
    m = se.mi_scores(embedding_long(spark, sf_dir), bins=10)
    return m.select("feature_id", F.round("score", 6).alias("score"))


_Y_CUTS = ", ".join(f"quantile_cont(y, {i / 10}) AS c{i}" for i in range(1, 10))
_Y_BIN = " + ".join(f"(CASE WHEN l.y > q.c{i} THEN 1 ELSE 0 END)" for i in range(1, 10))


@query("m9_mi_numeric_target", f"""
WITH {SQL_DOC_FEATURES.strip()},
l AS (SELECT 0 AS feature_id, n_words AS value, y FROM doc_features
      UNION ALL SELECT 1, n_lines, y FROM doc_features),
q AS (SELECT {_Y_CUTS} FROM l),
b AS (SELECT feature_id, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature_id),
x AS (SELECT l.feature_id,
             CAST(CASE WHEN b.hi - b.lo > 0 THEN least(19, floor((l.value - b.lo) / (b.hi - b.lo) * 20)) ELSE 0 END AS INTEGER) AS xb,
             {_Y_BIN} AS yb FROM l JOIN b USING (feature_id) CROSS JOIN q),
j AS (SELECT feature_id, xb, yb, count(*) AS nxy FROM x GROUP BY ALL),
m AS (SELECT *, sum(nxy) OVER (PARTITION BY feature_id) AS n,
             sum(nxy) OVER (PARTITION BY feature_id, xb) AS nx,
             sum(nxy) OVER (PARTITION BY feature_id, yb) AS ny FROM j)
SELECT feature_id, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS score FROM m GROUP BY feature_id
""")
def m9_mi_numeric_target(spark, sf_dir):
    d = materialize(doc_features(spark, sf_dir))
    long = d.select("y", F.posexplode(F.array("n_words", "n_lines")).alias("feature_id", "value"))
    m = se.mi_scores(long, bins=20, y_bins=10)
    return m.select("feature_id", F.round("score", 6).alias("score"))


@query("p2_keep_features", f"""
WITH {SQL_EMB_LONG.strip()},{_F_SQL},
k AS (SELECT feature_id FROM (SELECT feature_id, row_number() OVER (ORDER BY score DESC, feature_id) AS rk FROM fs) WHERE rk <= 16)
SELECT row_id, feature_id, round(value, 6) AS value FROM emb_long WHERE feature_id IN (SELECT feature_id FROM k)
""")
def p2_keep_features(spark, sf_dir):
    long = embedding_long(spark, sf_dir)
    mask = se.top_k(se.f_scores(long), k=16)
    return se.keep_features(long, mask).select("row_id", "feature_id", F.round("value", 6).alias("value"))


def _scaled_sql(center: str, scale: str) -> str:
    return f"""
WITH {SQL_EMB_LONG.strip()},
c AS (SELECT feature_id, {center} AS center,
             CASE WHEN {scale} = 0 THEN 1.0 ELSE {scale} END AS scale FROM emb_long GROUP BY feature_id)
SELECT e.row_id, e.feature_id, round((e.value - c.center) / c.scale, 6) AS scaled
FROM emb_long e JOIN c USING (feature_id)
"""


def _scaled(spark, sf_dir, kind):
    long = embedding_long(spark, sf_dir, with_target=False)
    c = sc.scaler_constants(long, kind)
    return sc.scale(long, c).select("row_id", "feature_id", F.round("scaled", 6).alias("scaled"))


query("m4_standard_scale", _scaled_sql("avg(value)", "stddev_pop(value)"))(
    lambda spark, sf_dir: _scaled(spark, sf_dir, "standard"))
query("m5_robust_scale", _scaled_sql(
    "quantile_cont(value, 0.5)", "(quantile_cont(value, 0.75) - quantile_cont(value, 0.25))"))(
    lambda spark, sf_dir: _scaled(spark, sf_dir, "robust"))
query("m6_minmax_scale", _scaled_sql("min(value)", "(max(value) - min(value))"))(
    lambda spark, sf_dir: _scaled(spark, sf_dir, "minmax"))


@query("m43_scaling_check", f"""
WITH {SQL_EMB_LONG.strip()},
c AS (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS s FROM emb_long GROUP BY feature_id),
a AS (SELECT e.row_id, e.feature_id, (e.value - c.m) / CASE WHEN c.s = 0 THEN 1.0 ELSE c.s END AS scaled
      FROM emb_long e JOIN c USING (feature_id)),
b AS (SELECT row_id, feature_id,
             (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1.0 ELSE stddev_pop(value) OVER w END
               AS manual
      FROM emb_long WINDOW w AS (PARTITION BY feature_id))
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs(scaled - manual)), 9) AS mean_abs_diff,
       round(max(abs(scaled - manual)), 9) AS max_abs_diff
FROM a JOIN b USING (row_id, feature_id)
""")
def m43_scaling_check(spark, sf_dir):
    long = embedding_long(spark, sf_dir, with_target=False)
    scaled = sc.scale(long, sc.scaler_constants(long, "standard"))
    # manual: the same formula evaluated from a separately computed stats table
    stats = st.feature_stats(long, y=None, digits=17).select("feature_id", "mean", "std_pop")
    manual = long.join(F.broadcast(stats), "feature_id").select(
        "row_id", "feature_id",
        ((F.col("value") - F.col("mean")) /
         F.when(F.col("std_pop") == 0, 1.0).otherwise(F.col("std_pop"))).alias("manual"))
    return sc.check_scaling(scaled, manual)


@query("m3_median_impute", """
WITH x AS (SELECT d.doc_id AS row_id, f.name AS feature, f.v AS value
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id,
           LATERAL (VALUES ('quality', CAST(l.quality AS DOUBLE)), ('toxic', CAST(l.toxic AS DOUBLE))) f(name, v)),
m AS (SELECT feature, quantile_cont(value, 0.5) AS median FROM x GROUP BY feature)
SELECT feature, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE x.value IS NULL) AS BIGINT) AS n_imputed,
       round(avg(coalesce(x.value, m.median)), 6) AS mean_after
FROM x JOIN m USING (feature) GROUP BY feature
""")
def m3_median_impute(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id")
    lab = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    x = d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.inline(F.array(F.struct(F.lit("quality").alias("feature"), F.col("quality").cast("double").alias("value")),
                         F.struct(F.lit("toxic").alias("feature"), F.col("toxic").cast("double").alias("value")))))
    x = x.withColumn("was_missing", F.col("value").isNull())
    imp = sc.impute_median(x, feature="feature")
    return imp.groupBy("feature").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if("was_missing").cast("bigint").alias("n_imputed"),
        F.round(F.avg("value"), 6).alias("mean_after"))


@query("s14_prep_constants", f"""
WITH {SQL_EMB_LONG.strip()},{_F_SQL},
s AS (SELECT feature_id, avg(value) AS center, stddev_pop(value) AS sd, var_pop(value) AS variance
      FROM emb_long GROUP BY feature_id)
SELECT s.feature_id, s.variance > {VARIANCE_THRESHOLD} AS keep, round(center, 6) AS center,
       round(CASE WHEN sd = 0 THEN 1.0 ELSE sd END, 6) AS scale, round(variance, 6) AS variance,
       round(fs.score, 6) AS importance
FROM s LEFT JOIN fs USING (feature_id)
""")
def s14_prep_constants(spark, sf_dir):
    long = embedding_long(spark, sf_dir)
    return sc.prep_constants(long, se.f_scores(long), VARIANCE_THRESHOLD)
