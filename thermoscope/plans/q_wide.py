"""Wide decompositions; SQL finds the same values by repeated squaring of the 64 x 64 product matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import wide
from ..sources.tables import load
from .catalog import SQL, query
from .features import SQL_EMB_LONG

SQUARINGS, VALUES = 30, 6


def _vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))


def eigen_sql(center: bool, k: int) -> str:
    """CTEs ``lam1 .. lamk`` (value) and ``values(component, value)``: eigenvalues of the product matrix of the vectors.

    A power of a matrix, divided by its trace, tends to the projection on its first eigenvector; that part is then taken off.
    """
    value = "value - avg(value) OVER (PARTITION BY feature_id)" if center else "value"
    parts = [SQL_EMB_LONG.strip(), f"""
x AS MATERIALIZED (SELECT row_id, feature_id AS f, {value} AS v FROM emb_long),
g1 AS MATERIALIZED (SELECT a.f AS i, b.f AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (row_id) GROUP BY a.f, b.f)"""]
    for c in range(1, k + 1):
        parts.append(f"""
p{c}(t, i, j, v) AS (
  SELECT 0, i, j, v / (SELECT sum(v) FROM g{c} WHERE i = j) FROM g{c}
  UNION ALL
  SELECT t + 1, i, j, v / sum(CASE WHEN i = j THEN v END) OVER () FROM (
    SELECT a.t, a.i, b.j, sum(a.v * b.v) AS v FROM p{c} a JOIN p{c} b ON a.j = b.i WHERE a.t < {SQUARINGS} GROUP BY a.t, a.i, b.j)),
e{c} AS MATERIALIZED (SELECT i, j, v FROM p{c} WHERE t = {SQUARINGS}),
lam{c} AS MATERIALIZED (SELECT sum(g.v * e.v) AS value FROM g{c} g JOIN e{c} e ON e.i = g.j AND e.j = g.i),
g{c + 1} AS MATERIALIZED (SELECT g.i, g.j, g.v - l.value * e.v AS v FROM g{c} g JOIN e{c} e USING (i, j), lam{c} l)""")
    parts.append("\nvalues_of AS (" + " UNION ALL ".join(f"SELECT {c - 1} AS component, value FROM lam{c}"
                                                      for c in range(1, k + 1)) + ")")
    return "WITH RECURSIVE " + ",".join(parts)


SQL["m12_truncated_svd"] = f"""{eigen_sql(False, 10)}
SELECT component, round(sqrt(value), 8) AS singular_value FROM values_of"""


@query("m12_wide_svd", f"""{eigen_sql(False, VALUES)}
SELECT component, round(sqrt(value), 8) AS singular_value FROM values_of""")
def m12_wide_svd(spark, sf_dir):
    """Singular values of the vectors by the block Krylov range finder; columns are read in blocks of 16."""
    fit = wide.svd(_vectors(spark, sf_dir), "features", VALUES, block_cols=16)
    rows = [(i, round(float(s), 8)) for i, s in enumerate(fit["singular_values"])]
    return spark.createDataFrame(rows, "component int, singular_value double")


@query("m11_wide_pca", f"""{eigen_sql(True, VALUES)},
n AS (SELECT count(*) AS n FROM embeddings), total AS (SELECT sum(v * v) AS t FROM x)
SELECT component, round(value / (n - 1), 9) AS explained_variance, round(value / t, 9) AS ratio FROM values_of, n, total""")
def m11_wide_pca(spark, sf_dir):
    """Explained variances of the centred vectors by the same passes."""
    fit = wide.pca(_vectors(spark, sf_dir), "features", VALUES, block_cols=16)
    rows = [(i, round(float(v), 9), round(float(r), 9)) for i, (v, r) in enumerate(zip(fit["explained_variance"], fit["ratio"]))]
    return spark.createDataFrame(rows, "component int, explained_variance double, ratio double")


@query("m11_incremental_pca", f"""{eigen_sql(True, VALUES)},
n AS (SELECT count(*) AS n FROM embeddings)
SELECT component, round(value / (n - 1), 9) AS explained_variance FROM values_of, n""")
def m11_incremental_pca(spark, sf_dir):
    """The same variances from two halves of the table: a full fit of the first, updated by the second."""
    v = _vectors(spark, sf_dir)
    first = wide.pca(v.where("row_id % 2 = 0"), "features", 64)
    fit = wide.update(first, v.where("row_id % 2 <> 0"), "features")
    rows = [(i, round(float(x), 9)) for i, x in enumerate(fit["explained_variance"][:VALUES])]
    return spark.createDataFrame(rows, "component int, explained_variance double")
