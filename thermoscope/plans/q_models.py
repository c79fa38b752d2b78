"""Outlier-detector and model queries (embeddings as sweeps, documents as regression set)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as ol
from ..sources.tables import load
from .catalog import query
from .features import SQL_EMB_LONG


def _vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("row_id"),
                    F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").alias("label"))


@query("a7_a8_cluster_size_filter", """
WITH c AS (SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label),
n AS (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) AS min_size FROM embeddings)
SELECT cluster, CAST(size AS BIGINT) AS size, min_size, size >= min_size AS valid,
       (SELECT count(DISTINCT label) FROM embeddings) > 1 AS multi_cluster
FROM c, n
""")
def a7_a8_cluster_size_filter(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumnRenamed("label", "cluster")
    sizes = ol.cluster_sizes(v, "cluster")
    multi = v.agg(F.countDistinct("cluster")).first()[0] > 1   # A8: one scalar
    return sizes.withColumn("multi_cluster", F.lit(multi))


@query("a26_j4_outlier_rows", """
WITH c AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label),
v AS (SELECT label FROM c WHERE size >= (SELECT floor(count(*) * 0.1) FROM embeddings))
SELECT vec_id AS row_id FROM embeddings WHERE label NOT IN (SELECT label FROM v)
""")
def a26_j4_outlier_rows(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumnRenamed("label", "cluster")
    return ol.outlier_rows(ol.cluster_size_mask(v, "cluster"))


@query("m18_kmeans_outlier_mask")
def m18_kmeans_outlier_mask(spark, sf_dir):
    """k-means (k=3, best of 10 seeds) then cluster-size mask; one row per cluster."""
    m = ol.kmeans_mask(_vectors(spark, sf_dir))
    return m.groupBy("cluster").agg(F.count(F.lit(1)).cast("bigint").alias("size"),
                                    F.bool_and("is_inlier").alias("valid"))


@query("m19_outlier_flag_keep")
def m19_outlier_flag_keep(spark, sf_dir):
    """remove=False: every row kept, carrying its k-means inlier flag."""
    v = _vectors(spark, sf_dir)
    mask = ol.kmeans_mask(v)
    return ol.keep_rows(v.select("row_id", "label"), mask, remove=False)


@query("m20_choose_k_silhouette")
def m20_choose_k_silhouette(spark, sf_dir):
    return ol.choose_k(_vectors(spark, sf_dir))


@query("m21_isolation_forest")
def m21_isolation_forest(spark, sf_dir):
    return ol.isolation_forest_mask(_vectors(spark, sf_dir)).select(
        "row_id", F.round("score", 6).alias("score"), "is_inlier")


@query("m22_local_outlier_factor", """
WITH p AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.row_id, b.row_id AS nb, list_distance(a.v, b.v) AS dist FROM p a, p b WHERE a.row_id <> b.row_id),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, nb) AS rk FROM d),
nn AS (SELECT * FROM r WHERE rk <= least(20, (SELECT count(*) FROM p) - 1)),
kd AS (SELECT row_id AS nb, dist AS kdist FROM nn WHERE rk = least(20, (SELECT count(*) FROM p) - 1)),
lrd AS (SELECT nn.row_id, 1.0 / (avg(greatest(nn.dist, kd.kdist)) + 1e-10) AS lrd
        FROM nn JOIN kd USING (nb) GROUP BY nn.row_id),
lo AS (SELECT nn.row_id, avg(l2.lrd) / any_value(l1.lrd) AS lof
       FROM nn JOIN lrd l2 ON nn.nb = l2.row_id JOIN lrd l1 ON nn.row_id = l1.row_id GROUP BY nn.row_id),
cut AS (SELECT quantile_cont(-lof, 0.1) AS c FROM lo)
SELECT row_id, round(lof, 6) AS lof, -lof >= c AS is_inlier FROM lo, cut
""")
def m22_local_outlier_factor(spark, sf_dir):
    r = ol.lof(_vectors(spark, sf_dir).select("row_id", "features"))
    return r.select("row_id", F.round("lof", 6).alias("lof"), "is_inlier")


# ------------------------------------------------------------ kernel scores

_SQL_HSIC = f"""
{SQL_EMB_LONG},
pair AS (SELECT a.feature_id, a.row_id, exp(-(a.value - b.value) * (a.value - b.value)) AS kx, exp(-(a.y - b.y) * (a.y - b.y)) AS ky
         FROM emb_long a JOIN emb_long b USING (feature_id)),
sums AS (SELECT feature_id, row_id, sum(kx) AS rx, sum(ky) AS ry, sum(kx * ky) AS kk FROM pair GROUP BY feature_id, row_id),
hsic AS (SELECT feature_id, count(*) AS n, (sum(kk) - 2.0 / count(*) * sum(rx * ry) + sum(rx) * sum(ry) / (count(*) * count(*)))
                / ((count(*) - 1.0) * (count(*) - 1.0)) AS score FROM sums GROUP BY feature_id)
"""


@query("a20_hsic_scores", f"""
WITH {_SQL_HSIC} SELECT feature_id, n, round(score, 8) AS score FROM hsic
""")
def a20_hsic_scores(spark, sf_dir):
    """HSIC per embedding dimension with the label: kernel sums over all pairs by a fast Gauss transform."""
    from ..operators.gauss import hsic
    from .features import embedding_long
    return hsic(embedding_long(spark, sf_dir)).select("feature_id", "n", F.round("score", 8).alias("score"))


@query("m10_hsic_selector", f"""
WITH {_SQL_HSIC}, top AS (SELECT feature_id FROM hsic ORDER BY score DESC, feature_id LIMIT 10)
SELECT feature_id, count(*) AS n, round(avg(value), 6) AS mean FROM emb_long JOIN top USING (feature_id) GROUP BY feature_id
""")
def m10_hsic_selector(spark, sf_dir):
    """Top-10 features by HSIC (k=10, γ=1), then the projected long rows per kept feature."""
    from ..operators.gauss import hsic
    from ..operators.kernel import K_BEST
    from ..operators.select import keep_features, top_k
    from .features import embedding_long
    long = embedding_long(spark, sf_dir)
    top = top_k(hsic(long), k=K_BEST)
    kept = keep_features(long, top)
    return kept.groupBy("feature_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                          F.round(F.avg("value"), 6).alias("mean"))


# ------------------------------------------------------------------- trees

def _doc_split(spark, sf_dir):
    from .features import doc_features_split
    return doc_features_split(spark, sf_dir).na.fill(0.0, ["avg_word_len"])


@query("m27_m31_tree_models")
def m27_m31_tree_models(spark, sf_dir):
    """Decision tree, forest, bagging and boosting on train; test metrics per model."""
    from ..operators.metrics import metrics
    from ..operators.trees import assemble, fit_tree_model
    from .features import DOC_FEATURES
    d = _doc_split(spark, sf_dir)
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    specs = {"tree": dict(maxDepth=8, minInstancesPerNode=2),
             "forest": dict(numTrees=50, maxDepth=8, minInstancesPerNode=2),
             "bagging": dict(numTrees=10, maxDepth=12),
             "boosted": dict(maxIter=50, stepSize=0.1, maxDepth=3, subsamplingRate=1.0)}
    out = None
    tv = assemble(test, DOC_FEATURES)
    for name, params in specs.items():
        model = fit_tree_model(train, DOC_FEATURES, "y", name, **params)
        m = metrics(model.transform(tv), "y", "prediction").withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


@query("s13_j7_a24_forest_routing")
def s13_j7_a24_forest_routing(spark, sf_dir):
    """Forest → node table → level-by-level routing and broadcast scoring, each
    compared with MLlib's own predictions on every document."""
    from ..operators.trees import (assemble, ensemble_mean, ensemble_predict, fit_tree_model,
                                   route, tree_nodes)
    from ..session import ensure_checkpoint_dir
    from .features import DOC_FEATURES
    d = _doc_split(spark, sf_dir)
    rows = d.select("row_id", "y", *DOC_FEATURES,
                    F.array(*[F.col(c) for c in DOC_FEATURES]).alias("features"))
    out = None
    for kind, params in (("forest", dict(numTrees=20, maxDepth=6)), ("boosted", dict(maxIter=20, maxDepth=3))):
        model = fit_tree_model(d.where(F.col("split") == "train"), DOC_FEATURES, "y", kind, **params)
        nodes = tree_nodes(model, ensure_checkpoint_dir(spark)).cache()
        mllib = model.transform(assemble(rows, DOC_FEATURES)).select("row_id", F.col("prediction").alias("p_mllib"))
        joined = ensemble_mean(route(rows, nodes, max_depth=model.getMaxDepth())).withColumnRenamed("prediction", "p_route") \
            .join(ensemble_predict(rows, nodes).withColumnRenamed("prediction", "p_vec"), "row_id") \
            .join(mllib, "row_id")
        rep = joined.agg(
            F.count(F.lit(1)).cast("bigint").alias("n"),
            F.round(F.max(F.abs(F.col("p_route") - F.col("p_mllib"))), 9).alias("max_diff_route"),
            F.round(F.max(F.abs(F.col("p_vec") - F.col("p_mllib"))), 9).alias("max_diff_vectorised"),
        ).withColumn("model", F.lit(kind)).withColumn("n_nodes", F.lit(nodes.count()))
        out = rep if out is None else out.unionByName(rep)
    return out
