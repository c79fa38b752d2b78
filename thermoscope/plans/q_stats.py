"""Statistics queries over the long form and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as st
from ..sources.tables import load
from .catalog import query
from .features import (SQL_EMB_LONG, SQL_EMB_SWEEPS, embedding_long, embedding_sweeps)


@query("a16_a22_a23_feature_stats", f"""
WITH {SQL_EMB_LONG.strip()}
SELECT feature_id, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS BIGINT) AS n_missing,
       round(avg(value), 6) AS mean, round(var_pop(value), 6) AS var_pop,
       round(stddev_pop(value), 6) AS std_pop, round(min(value), 6) AS min,
       round(max(value), 6) AS max, round(corr(value, y), 6) AS corr_y
FROM emb_long GROUP BY feature_id
""")
def a16_a22_a23_feature_stats(spark, sf_dir):
    return st.feature_stats(embedding_long(spark, sf_dir))


@query("a17_feature_quartiles", f"""
WITH {SQL_EMB_LONG.strip()}
SELECT feature_id, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75
FROM emb_long GROUP BY feature_id
""")
def a17_feature_quartiles(spark, sf_dir):
    return st.feature_quartiles(embedding_long(spark, sf_dir, with_target=False), digits=6)


@query("p4_missing_probe", f"""
WITH {SQL_EMB_LONG.strip()}
SELECT feature_id, bool_or(value IS NULL OR isnan(value)) AS has_missing
FROM emb_long GROUP BY feature_id
""")
def p4_missing_probe(spark, sf_dir):
    return st.has_missing(embedding_long(spark, sf_dir, with_target=False))


@query("a9_sweep_six_stats", f"""
WITH {SQL_EMB_SWEEPS.strip()}
SELECT sweep_id, measurement, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75
FROM emb_sweeps GROUP BY sweep_id, measurement
""")
def a9_sweep_six_stats(spark, sf_dir):
    return st.summarize_sweep(embedding_sweeps(spark, sf_dir))


@query("p5_sweep_flatten", """
SELECT vec_id AS sweep_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature_idx,
       round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
FROM embeddings
""")
def p5_sweep_flatten(spark, sf_dir):
    flat = st.flatten_sweep(embedding_sweeps(spark, sf_dir))
    return flat.select("sweep_id", F.posexplode("features").alias("feature_idx", "value")) \
        .select("sweep_id", F.col("feature_idx").cast("int").alias("feature_idx"),
                F.round("value", 6).alias("value"))


@query("p1_sweep_check", f"""
WITH {SQL_EMB_SWEEPS.strip()},
per AS (SELECT sweep_id, measurement, count(*) AS pts,
               count(*) FILTER (WHERE value IS NULL) AS nulls FROM emb_sweeps GROUP BY 1, 2),
s AS (SELECT sweep_id, CAST(count(*) AS BIGINT) AS n_measurements, CAST(min(pts) AS BIGINT) AS min_points,
             CAST(max(pts) AS BIGINT) AS max_points, CAST(sum(nulls) AS BIGINT) AS n_null
      FROM per GROUP BY sweep_id)
SELECT *, (n_measurements = 4 AND n_null = 0 AND min_points = max_points AND min_points = 16) AS valid FROM s
""")
def p1_sweep_check(spark, sf_dir):
    return st.check_sweep(embedding_sweeps(spark, sf_dir), n_points=16)


@query("p9_quality_report", f"""
WITH {SQL_EMB_LONG.strip()},
s AS (SELECT feature_id, avg(value) AS m, stddev_pop(value) AS sd FROM emb_long GROUP BY feature_id),
z AS (SELECT e.row_id, e.feature_id, e.value,
             CASE WHEN s.sd > 0 THEN abs((e.value - s.m) / s.sd) ELSE 0.0 END AS z
      FROM emb_long e JOIN s USING (feature_id)),
a AS (SELECT count(*) AS cells, count(*) FILTER (WHERE z > 3.0) AS n_outlier_cells,
             count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS n_missing,
             count(DISTINCT row_id) AS n_rows, count(DISTINCT feature_id) AS n_features,
             (SELECT count(*) FROM embeddings) AS n_targets FROM z)
SELECT 'z_outlier_cells' AS rule, CAST(n_outlier_cells AS DOUBLE) AS value, n_outlier_cells = 0 AS passed FROM a
UNION ALL SELECT 'samples_per_feature', round(n_rows / n_features, 6), n_rows / n_features >= 5 FROM a
UNION ALL SELECT 'missing_share', round(n_missing / cells, 6), n_missing / cells <= 0.1 FROM a
UNION ALL SELECT 'x_y_count_gap', CAST(n_rows - n_targets AS DOUBLE), n_rows = n_targets FROM a
""")
def p9_quality_report(spark, sf_dir):
    long = embedding_long(spark, sf_dir, with_target=False)
    wide = load(spark, sf_dir, "embeddings", "vec_id")
    # the targets (label) live on the same rows; the predictor rows are the wide table
    return st.quality_report(long, wide, rows=wide)


@query("a11_predictor_correlation", """
SELECT round(corr(l.l_extendedprice, p.p_retailprice), 6) AS corr_price,
       round(corr(CAST(l.l_partkey AS DOUBLE), p.p_retailprice), 6) AS corr_key_price,
       round(corr(l.l_quantity, l.l_extendedprice), 6) AS corr_qty_price
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
""")
def a11_predictor_correlation(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem", "l_partkey", "l_extendedprice", "l_quantity")
    pa = load(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    j = li.join(pa, li["l_partkey"] == pa["p_partkey"])
    return j.agg(F.round(F.corr("l_extendedprice", "p_retailprice"), 6).alias("corr_price"),
                 F.round(F.corr(F.col("l_partkey").cast("double"), F.col("p_retailprice")), 6)
                 .alias("corr_key_price"),
                 F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr_qty_price"))
