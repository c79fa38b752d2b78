"""Nearest-neighbour mutual information; SQL compares all pairs of rows of a feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.mutual import NEIGHBORS, SCALE_DIGITS, knn_mi
from ..operators.select import top_k
from .catalog import query
from .features import DOC_FEATURES, SQL_DOC_FEATURES, SQL_EMB_LONG, doc_features, embedding_long


def _mi_sql(long: str) -> str:
    """CTEs from ``long(feature_id, row_id, value, y)`` to ``mi(feature_id, n, score)``."""
    return f"""
sd AS (SELECT feature_id, count(*) AS n, round(stddev_pop(value), {SCALE_DIGITS}) AS sx, round(stddev_pop(y), {SCALE_DIGITS}) AS sy
       FROM {long} GROUP BY feature_id),
p AS MATERIALIZED (SELECT feature_id, row_id, value / sx AS x, y / sy AS t FROM {long} JOIN sd USING (feature_id)),
e AS MATERIALIZED (SELECT a.feature_id, a.row_id, min(greatest(abs(a.x - b.x), abs(a.t - b.t)), {NEIGHBORS})[{NEIGHBORS}] AS e
      FROM p a JOIN p b ON a.feature_id = b.feature_id AND a.row_id <> b.row_id GROUP BY a.feature_id, a.row_id),
c AS (SELECT a.feature_id, a.row_id, count(*) FILTER (WHERE abs(a.x - b.x) < e.e OR a.x = b.x) AS nx,
             count(*) FILTER (WHERE abs(a.t - b.t) < e.e OR a.t = b.t) AS nt
      FROM p a JOIN e USING (feature_id, row_id) JOIN p b ON a.feature_id = b.feature_id GROUP BY a.feature_id, a.row_id),
psi AS MATERIALIZED (SELECT n, -0.5772156649015329 + sum(CASE WHEN n > 1 THEN 1.0 / (n - 1) ELSE 0 END) OVER (ORDER BY n) AS v
        FROM (SELECT unnest(range(1, (SELECT max(n) + 1 FROM sd))) AS n)),
mi AS (SELECT c.feature_id, any_value(sd.n) AS n,
              greatest(0.0, any_value(pn.v) + (SELECT v FROM psi WHERE n = {NEIGHBORS}) - avg(px.v + pt.v)) AS score
       FROM c JOIN sd USING (feature_id) JOIN psi px ON px.n = c.nx JOIN psi pt ON pt.n = c.nt JOIN psi pn ON pn.n = sd.n
       GROUP BY c.feature_id)"""


@query("a19_knn_mi_scores", f"""
WITH {SQL_EMB_LONG.strip()}, {_mi_sql('emb_long')}
SELECT feature_id, n, round(score, 6) AS score FROM mi
""")
def a19_knn_mi_scores(spark, sf_dir):
    """Mutual information of every vector dimension with the label, by the third neighbour."""
    return knn_mi(embedding_long(spark, sf_dir)).select("feature_id", "n", F.round("score", 6).alias("score"))


@query("m9_knn_mi_numeric_target", f"""
WITH {SQL_DOC_FEATURES.strip()},
long AS (SELECT 0 AS feature_id, row_id, n_words AS value, y FROM doc_features UNION ALL
         SELECT 1, row_id, n_lines, y FROM doc_features UNION ALL
         SELECT 2, row_id, avg_word_len, y FROM doc_features WHERE avg_word_len IS NOT NULL),
{_mi_sql('long')}
SELECT feature_id, round(score, 6) AS score FROM mi ORDER BY mi.score DESC, feature_id LIMIT 2
""")
def m9_knn_mi_numeric_target(spark, sf_dir):
    """The two document features of greatest mutual information with the text length."""
    d = doc_features(spark, sf_dir)
    long = d.select("row_id", "y", F.posexplode(F.array(*DOC_FEATURES)).alias("feature_id", "value"))
    return top_k(knn_mi(long), k=2).select("feature_id", F.round("score", 6).alias("score"))
