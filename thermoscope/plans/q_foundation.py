"""Foundation queries: flagship, splits, folds, alignment, projection, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..operators import split as sp
from ..sources.files import align, alignment_report
from ..sources.tables import load
from .catalog import query
from .features import SQL_DOC_FEATURES, doc_features
from .flagship import SQL_RIDGE_SPLIT_METRICS, ridge_split_metrics

query("flagship_ridge_split_metrics", SQL_RIDGE_SPLIT_METRICS)(ridge_split_metrics)


@query("m1_split_sizes", f"""
SELECT split, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key
FROM (SELECT o_orderkey, {sp.sql_split('o_orderkey')} AS split FROM orders) GROUP BY split
""")
def m1_split_sizes(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey")
    return sp.split(o, "o_orderkey").groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"))


@query("m44_named_split_sizes", f"""
SELECT split, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 6) AS avg_price
FROM (SELECT o_totalprice, {sp.sql_split_named('o_orderkey')} AS split FROM orders) GROUP BY split
""")
def m44_named_split_sizes(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return sp.split_named(o, "o_orderkey").groupBy("split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.avg("o_totalprice"), 6).alias("avg_price"))


@query("u2_split_partition_check", f"""
WITH s AS (SELECT o_orderkey, {sp.sql_split_named('o_orderkey')} AS split FROM orders),
k AS (SELECT o_orderkey, count(*) AS rows, count(DISTINCT split) AS splits,
             count(*) FILTER (WHERE split IS NULL) AS nulls FROM s GROUP BY o_orderkey)
SELECT CAST(sum(rows) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_keys,
       CAST(count(*) FILTER (WHERE splits > 1) AS BIGINT) AS n_multi,
       CAST(sum(nulls) AS BIGINT) AS n_unassigned
FROM k
""")
def u2_split_partition_check(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey")
    return sp.check_splits(sp.split_named(o, "o_orderkey"), "o_orderkey")


@query("m2_repeated_kfold_sizes", f"""
WITH r AS (SELECT o_orderkey, o_totalprice, rep FROM orders, range(3) t(rep)),
f AS (SELECT rep, {sp.sql_fold('o_orderkey', 'rep', 5)} AS fold, o_totalprice FROM r)
SELECT CAST(rep AS INTEGER) AS repeat, fold, CAST(count(*) AS BIGINT) AS n,
       round(sum(o_totalprice), 4) AS sum_price
FROM f GROUP BY rep, fold
""")
def m2_repeated_kfold_sizes(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    f = sp.folds(o, "o_orderkey", k=5, repeats=3)
    return f.groupBy(F.col("repeat").cast("int").alias("repeat"), "fold").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.sum("o_totalprice"), 4).alias("sum_price"))


@query("w7_contiguous_folds", """
SELECT CAST(fold - 1 AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n,
       min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM (SELECT o_orderkey, ntile(3) OVER (ORDER BY o_orderkey) AS fold FROM orders)
GROUP BY fold
""")
def w7_contiguous_folds(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey")
    return sp.contiguous_folds(o, "o_orderkey", 3).groupBy("fold").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("j1_align_predictors_targets", f"""
WITH {SQL_DOC_FEATURES.strip()}
SELECT f.row_id, f.n_words, f.n_lines, CAST(l.quality AS DOUBLE) AS target
FROM doc_features f JOIN labels l ON f.row_id = l.doc_id
""")
def j1_align_predictors_targets(spark, sf_dir):
    x = doc_features(spark, sf_dir).select("row_id", "n_words", "n_lines")
    y = load(spark, sf_dir, "labels", "doc_id", "quality").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("target"))
    return align(x, y, "row_id")


@query("j1_alignment_report", """
SELECT CAST(count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS BIGINT) AS n_matched,
       CAST(count(*) FILTER (WHERE l.doc_id IS NULL) AS BIGINT) AS n_x_only,
       CAST(count(*) FILTER (WHERE d.doc_id IS NULL) AS BIGINT) AS n_y_only
FROM (SELECT doc_id FROM documents) d FULL OUTER JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id
""")
def j1_alignment_report(spark, sf_dir):
    x = load(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "row_id")
    y = load(spark, sf_dir, "labels", "doc_id").withColumnRenamed("doc_id", "row_id")
    return alignment_report(x, y, "row_id")


@query("s4_numeric_projection", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
       CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax
FROM lineitem
""")
def s4_numeric_projection(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return numeric_columns(li)


@query("u1_stack_batches", """
SELECT src, CAST(count(*) AS BIGINT) AS n, round(sum(v), 4) AS total
FROM (SELECT 'orders' AS src, o_totalprice AS v FROM orders
      UNION ALL SELECT 'lineitem' AS src, l_extendedprice AS v FROM lineitem
      UNION ALL SELECT 'customer' AS src, c_acctbal AS v FROM customer)
GROUP BY src
""")
def u1_stack_batches(spark, sf_dir):
    from ..sources.files import stack
    parts = [load(spark, sf_dir, "orders", "o_totalprice").select(
                 F.lit("orders").alias("src"), F.col("o_totalprice").alias("v")),
             load(spark, sf_dir, "lineitem", "l_extendedprice").select(
                 F.lit("lineitem").alias("src"), F.col("l_extendedprice").alias("v")),
             load(spark, sf_dir, "customer", "c_acctbal").select(
                 F.lit("customer").alias("src"), F.col("c_acctbal").alias("v"))]
    return stack(*parts).groupBy("src").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                            F.round(F.sum("v"), 4).alias("total"))
