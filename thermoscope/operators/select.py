"""Feature selection over the long form.

Scores are per-feature aggregates (one row per feature), so every selection
rule runs on a table bounded by the sweep width, never on the data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def f_scores(long: DataFrame, feature: str = "feature_id", value: str = "value",
             y: str = "y") -> DataFrame:
    """Univariate F = r²/(1−r²)·(n−2) per feature (r = Pearson corr with y).

    A perfect predictor (r² = 1) scores +infinity, so it ranks first; a feature
    or target without variance scores 0.
    """
    both = F.col(value).isNotNull() & F.col(y).isNotNull()
    v, t = F.when(both, F.col(value)), F.when(both, F.col(y))
    s = long.groupBy(feature).agg(   # corr() itself divides by zero on a constant column
        F.try_divide(F.pow(F.covar_pop(v, t), 2), F.var_pop(v) * F.var_pop(t)).alias("r2"),
        F.count(value).alias("n"))
    r2 = F.col("r2")
    score = F.when(r2.isNull() | F.isnan(r2), F.lit(0.0)) \
        .when(r2 >= 1, F.lit(float("inf"))).otherwise(F.try_divide(r2, 1 - r2) * (F.col("n") - 2))
    return s.select(feature, F.col("n").cast("bigint").alias("n"), score.alias("score"))


def variance_keep(stats: DataFrame, threshold: float, feature: str = "feature_id",
                  var: str = "var_pop") -> DataFrame:
    """M7: keep features whose population variance is strictly above ``threshold``."""
    return stats.select(feature, var, (F.col(var) > threshold).alias("keep"))


def parse_ratio(ratio: str | None, n: int) -> int | None:
    """T2: 'NUM:DEN' → clamp(⌊n·num/den⌋, 1, n); None for an invalid ratio (skip)."""
    if not ratio or ":" not in ratio:
        return None
    num, den = ratio.split(":", 1)
    try:
        a, b = float(num), float(den)
    except ValueError:
        return None
    if b == 0 or a < 0 or b < 0:
        return None
    return max(1, min(n, int(n * a / b)))


def ratio_k(ratio: Column, n: Column) -> Column:
    """T2 as a column expression (NULL = skip selection)."""
    parts = F.split(ratio, ":")
    num = F.get(parts, 0).try_cast("double")   # get(): NULL instead of an ANSI index error
    den = F.get(parts, 1).try_cast("double")
    ok = (F.size(parts) == 2) & num.isNotNull() & den.isNotNull() & (den != 0) & (num >= 0) & (den > 0)
    return F.when(ok, F.greatest(F.lit(1), F.least(n, F.floor(n * num / den)))).cast("int")


def top_k(scores: DataFrame, k: int | None = None, ratio: str | None = None,
          score: str = "score", feature: str = "feature_id") -> DataFrame:
    """Highest scores first, ties broken by feature id; adds ``rank``.

    ``orderBy(...).limit(k)`` plans as a per-partition top-k followed by one
    merge of k rows per partition, so no task ever sorts the whole table.
    """
    if k is None:
        n = scores.count()  # number of features: bounded by the width
        k = parse_ratio(ratio, n) if ratio is not None else n
        if k is None:
            k = n
    top = scores.orderBy(F.col(score).desc_nulls_last(), F.col(feature).asc()).limit(k)
    return _rank_small(top, score, feature)


def _rank_small(top: DataFrame, score: str, feature: str) -> DataFrame:
    # the input has at most k rows, so a global window here is bounded by k
    from pyspark.sql import Window
    w = Window.orderBy(F.col(score).desc_nulls_last(), F.col(feature).asc())
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


# Width-driven reduction rules (classic and network variants).
WIDTH_RULES = {
    "classic": ((5000, 0.1), (2000, 2000)),
    "network": ((10000, 0.01), (5000, 5000)),
}


def reduce_width(stats: DataFrame, scores: DataFrame, rules: str = "classic",
                 feature: str = "feature_id") -> DataFrame:
    """Variance cut when wider than the first limit, then top-k by F when
    still wider than the second (k = min(cap, half of the remaining features)).

    Returns (feature_id, score, var_pop, keep, stage).
    """
    (wide1, var_t), (wide2, cap) = WIDTH_RULES[rules]
    table = stats.select(feature, "var_pop").join(scores.select(feature, "score"), feature)
    width = table.count()
    stage = "none"
    keep = F.lit(True)
    if width > wide1:
        keep = F.col("var_pop") > var_t
        stage = "variance"
    kept = table.where(keep)
    remaining = kept.count() if stage != "none" else width
    if remaining > wide2:
        k = min(cap, remaining // 2)
        chosen = top_k(kept, k=k, feature=feature).select(feature, F.lit(True).alias("__top"))
        out = table.join(chosen, feature, "left").withColumn(
            "keep", keep & F.coalesce(F.col("__top"), F.lit(False))).drop("__top")
        stage = stage + "+top_k" if stage != "none" else "top_k"
    else:
        out = table.withColumn("keep", keep)
    return out.withColumn("stage", F.lit(stage))


def keep_features(long: DataFrame, mask: DataFrame, feature: str = "feature_id") -> DataFrame:
    """Project the long form onto the kept features.

    The mask has one row per feature (bounded by the width) and is broadcast
    into a semi join, so the data side is not shuffled.
    """
    kept = mask.where(F.col("keep")).select(feature) if "keep" in mask.columns else mask.select(feature)
    return long.join(F.broadcast(kept), feature, "left_semi")


def mi_scores(long: DataFrame, bins: int = 10, y_bins: int | None = None,
              feature: str = "feature_id", value: str = "value", y: str = "y") -> DataFrame:
    """A19 (declared approximation): mutual information of equal-width binned x with y.

    y is used as classes when ``y_bins`` is None; a numeric target is cut at its
    exact quantiles into ``y_bins`` bins of equal weight (over cells, so a row
    counts once per feature).  The joint-count table has at most features × bins ×
    classes rows.
    """
    b = long.groupBy(feature).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    x = long.join(F.broadcast(b), feature)
    w = F.col("__hi") - F.col("__lo")
    xb = F.when(w > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("__lo")) / w * bins))) \
        .otherwise(F.lit(0)).cast("int")
    if y_bins is None:
        yb = F.col(y)
    else:
        from .ranking import exact_quantiles
        names = [f"c{i}" for i in range(1, y_bins)]
        cuts = exact_quantiles(long.select(F.col(y).cast("double").alias("__y")), "__y",
                               [i / y_bins for i in range(1, y_bins)], names=names).first()
        yb = sum((F.when(F.col(y) > F.lit(cuts[n]), 1).otherwise(0) for n in names), F.lit(0)) if cuts else F.lit(0)
    joint = x.groupBy(feature, xb.alias("xb"), yb.alias("yb")).agg(F.count(F.lit(1)).alias("nxy"))
    from pyspark.sql import Window
    by_f = Window.partitionBy(feature)
    joint = (joint.withColumn("n", F.sum("nxy").over(by_f))
             .withColumn("nx", F.sum("nxy").over(Window.partitionBy(feature, "xb")))
             .withColumn("ny", F.sum("nxy").over(Window.partitionBy(feature, "yb"))))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return joint.groupBy(feature).agg(F.sum(term).alias("score"))


def selection_table(spark: SparkSession, rows: list[tuple[int, bool]]) -> DataFrame:
    schema = T.StructType([T.StructField("feature_id", T.IntegerType()),
                           T.StructField("keep", T.BooleanType())])
    return spark.createDataFrame(rows, schema)
