"""Feature tables derived from the driver tables.

``documents`` is the regression set with real signal (target ``n_chars``),
``embeddings`` stands in for sweeps: each 64-point vector is one sweep, kept
in long form ``(row_id, feature_id, value)`` so a 40,004-wide sweep never
becomes 40,004 DataFrame columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

DOC_FEATURES = ("n_words", "n_lines", "avg_word_len")


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, n_words, n_lines, avg_word_len, y) over every document, whole text."""
    d = load(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    n_words = F.regexp_count(F.col("text"), F.lit(r"\S+")).cast("double")
    n_lines = (F.length("text") - F.length(F.regexp_replace("text", "\n", "")) + 1).cast("double")
    return d.select(
        F.col("doc_id").alias("row_id"),
        n_words.alias("n_words"),
        n_lines.alias("n_lines"),
        F.try_divide(F.length(F.regexp_replace("text", r"\s", "")).cast("double"),
                     n_words).alias("avg_word_len"),
        F.col("n_chars").cast("double").alias("y"),
    )


def doc_features_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_features + the 80/10/10 split, materialised once for multi-job plans.

    The whole-text regex pass is the expensive part; the result is narrow
    (five numbers per document), so writing it once is cheaper than parsing
    every text again for each fit and each metric.
    """
    from ..operators.split import split
    from ..session import materialize
    return materialize(split(doc_features(spark, sf_dir)))


SQL_DOC_FEATURES = r"""
doc_features AS (
  SELECT doc_id AS row_id,
         CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) AS n_words,
         CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS n_lines,
         CAST(length(regexp_replace(text, '\s', '', 'g')) AS DOUBLE)
           / NULLIF(CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE), 0) AS avg_word_len,
         CAST(n_chars AS DOUBLE) AS y
  FROM documents
)"""


def embedding_long(spark: SparkSession, sf_dir: str, with_target: bool = True) -> DataFrame:
    """(row_id, feature_id, value[, y]) — one row per vector component."""
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    cols = [F.col("vec_id").alias("row_id"),
            F.posexplode("embedding").alias("feature_id", "value")]
    if with_target:
        cols.append(F.col("label").cast("double").alias("y"))
    out = e.select(*cols).withColumn("value", F.col("value").cast("double"))
    return out.withColumn("feature_id", F.col("feature_id").cast("int"))


SQL_EMB_LONG = """
emb_long AS (
  SELECT vec_id AS row_id,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature_id,
         CAST(unnest(embedding) AS DOUBLE) AS value,
         CAST(label AS DOUBLE) AS y
  FROM embeddings
)"""


# Fixed layout for the embedding stand-in of a sweep: 64 values read as
# 4 measurements × 16 points (measurement-major, like the flattened sweep).
SWEEP_MEASUREMENTS, SWEEP_POINTS = 4, 16


def embedding_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sweep_id, measurement, point_idx, value) from ``embeddings``."""
    e = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    x = e.select(F.col("vec_id").alias("sweep_id"), F.posexplode("embedding").alias("pos", "value"))
    return x.select("sweep_id",
                    (F.col("pos") / SWEEP_POINTS).cast("int").alias("measurement"),
                    (F.col("pos") % SWEEP_POINTS).cast("int").alias("point_idx"),
                    F.col("value").cast("double").alias("value"))


SQL_EMB_SWEEPS = f"""
emb_sweeps AS (
  SELECT sweep_id, CAST((pos - 1) // {SWEEP_POINTS} AS INTEGER) AS measurement,
         CAST((pos - 1) % {SWEEP_POINTS} AS INTEGER) AS point_idx, value
  FROM (SELECT vec_id AS sweep_id, generate_subscripts(embedding, 1) AS pos,
               CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
)"""
