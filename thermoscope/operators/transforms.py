"""Distribution transforms over the long form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked

# Fixed value: λ grid for Yeo–Johnson (declared approximation of the 1-D optimiser).
YJ_GRID = tuple(np.round(np.arange(-2.0, 2.0001, 0.1), 10))


def quantile_transform(long: DataFrame, feature: str = "feature_id", value: str = "value",
                       key: str = "row_id") -> DataFrame:
    """Uniform output per feature, from skew-safe ranks.

    (mean rank − 1)/(n − 1): equal values get the same output, the middle of
    their ranks.
    """
    counts = long.groupBy(feature, value).agg(F.count(F.lit(1)).alias("__ties"))
    r = ranked(counts, [value], [feature], name="__rn", running={"__end": F.col("__ties")})
    total = counts.groupBy(feature).agg(F.sum("__ties").alias("__n")).withColumnRenamed(feature, "__f")
    middle = F.col("__end") - (F.col("__ties") - 1) / 2   # mean rank of the equal values
    q = F.when(F.col("__n") > 1, (middle - 1) / (F.col("__n") - 1)).otherwise(F.lit(0.0))
    fitted = r.join(total, F.col(feature).eqNullSafe(F.col("__f"))).select(
        F.col(feature).alias("__f"), F.col(value).alias("__x"), q.alias("quantile"))
    return long.join(fitted, F.col(feature).eqNullSafe(F.col("__f")) & F.col(value).eqNullSafe(F.col("__x"))) \
        .drop("__f", "__x")


def yj(x: Column, lam: Column) -> Column:
    """Yeo–Johnson ψ(x, λ)."""
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    neg = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(
        -(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson(long: DataFrame, feature: str = "feature_id", value: str = "value",
                grid=YJ_GRID) -> tuple[DataFrame, DataFrame]:
    """λ per feature maximising the profile log-likelihood over a grid,
    then ψ standardised to mean 0 / std 1.  Returns (lambdas, transformed)."""
    lam_arr = F.array(*[F.lit(float(v)) for v in grid])
    x = F.col(value)
    g = long.select(feature, x.alias("__x"), F.explode(lam_arr).alias("lam"))
    t = yj(F.col("__x"), F.col("lam"))
    s = g.groupBy(feature, "lam").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(t).alias("v"),
        F.sum(F.signum("__x") * F.log1p(F.abs("__x"))).alias("sl"))
    ll = s.withColumn("ll", -F.col("n") / 2 * F.log(F.col("v")) + (F.col("lam") - 1) * F.col("sl"))
    lam = ll.groupBy(feature).agg(F.max_by("lam", F.struct("ll", -F.col("lam"))).alias("lambda"))
    j = long.join(F.broadcast(lam), feature)   # one row per feature (bounded by width)
    j = j.withColumn("__t", yj(x, F.col("lambda")))
    m = j.groupBy(feature).agg(F.avg("__t").alias("__m"), F.stddev_pop("__t").alias("__s"))
    out = j.join(F.broadcast(m), feature).withColumn(
        "transformed", (F.col("__t") - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s")))
    return lam, out.drop("__t", "__m", "__s")


# ------------------------------------------------------------- fit on one table, map another

POINTS = 16         # penalties tried per step: the bracket shrinks to 2 / (POINTS + 1) of its width
LAMBDA_TOL = 1e-7
START = (-2.0, 2.0)  # fixed value: the first bracket, widened while the best lies at its edge
WIDEST = 64.0


def _profile(x: Column, lam: Column) -> list[Column]:
    t = yj(x, lam)
    return [F.count(x).alias("n"), F.var_pop(t).alias("v"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("sl")]


def fit_yeo_johnson(long: DataFrame, feature: str = "feature_id", value: str = "value", tol: float = LAMBDA_TOL) -> DataFrame:
    """``feature, lambda, center, scale`` with lambda of greatest profile likelihood to ``tol``.

    One bracketing search for all features at once: a step is one aggregate over the rows, of ``POINTS`` values per feature
    spread over its bracket, and the neighbours of the best one are the next bracket.  The driver holds two numbers a
    feature.  A feature without variance keeps lambda 1.  Nulls and NaN are not used.
    """
    spark, kind = long.sparkSession, long.schema[feature].dataType.simpleString()
    rows = long.select(F.col(feature).alias("f"), F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    spread = rows.groupBy("f").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()   # one row per feature
    known = {r["f"]: 1.0 for r in spread if r["a"] == r["b"]}
    bracket = {r["f"]: START for r in spread if r["a"] < r["b"]}
    while bracket:
        grid = spark.createDataFrame([(f, lo, hi) for f, (lo, hi) in bracket.items()], f"f {kind}, lo double, hi double")
        share = [F.lit(k / (POINTS + 1)) for k in range(POINTS + 2)]
        lams = F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * s for s in share])
        tried = rows.join(F.broadcast(grid), "f").select("f", "x", F.posexplode(lams).alias("k", "lam"))
        s = tried.groupBy("f", "k", "lam").agg(*_profile(F.col("x"), F.col("lam")))
        ll = -F.col("n") / 2 * F.log("v") + (F.col("lam") - 1) * F.col("sl")
        best = s.where("v > 0").groupBy("f").agg(F.max_by("k", F.struct(ll, -F.abs(F.col("k") - (POINTS + 1) / 2))).alias("k")).collect()
        for r in best:
            lo, hi = bracket[r["f"]]
            step, k = (hi - lo) / (POINTS + 1), r["k"]
            if k in (0, POINTS + 1) and hi - lo >= START[1] - START[0] and hi - lo < WIDEST:   # the best lies beyond
                bracket[r["f"]] = (lo - (hi - lo), hi) if k == 0 else (lo, hi + (hi - lo))
                continue
            lo, hi = lo + max(0, k - 1) * step, lo + min(POINTS + 1, k + 1) * step
            bracket[r["f"]] = (lo, hi)
            if hi - lo <= tol:
                known[r["f"]] = (lo + hi) / 2
        bracket = {f: b for f, b in bracket.items() if f not in known and f in {r["f"] for r in best}}
    lam = spark.createDataFrame(list(known.items()), f"f {kind}, lambda double")
    t = rows.join(F.broadcast(lam), "f").withColumn("t", yj(F.col("x"), F.col("lambda")))
    s = t.groupBy("f", "lambda").agg(F.avg("t").alias("center"), F.stddev_pop("t").alias("s"))
    return s.select(F.col("f").alias(feature), "lambda", "center", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("scale"))


def apply_yeo_johnson(long: DataFrame, fitted: DataFrame, feature: str = "feature_id", value: str = "value",
                      out: str = "transformed") -> DataFrame:
    """Fitted or new rows with the transformed, standardised value; rows of unknown features go."""
    j = long.join(F.broadcast(fitted), feature)   # one row per feature
    return j.withColumn(out, (yj(F.col(value).cast("double"), F.col("lambda")) - F.col("center")) / F.col("scale")) \
        .drop("lambda", "center", "scale")


TABLE_NUMBERS = 4_000_000   # quantiles held by a task at once; wider tables are mapped in several groups of features


def fit_quantiles(long: DataFrame, n_quantiles: int = 100, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """``feature, quantiles``: the values at ``n_quantiles`` even steps from the least to the greatest."""
    from .ranking import exact_quantiles
    names = [f"q{i}" for i in range(n_quantiles)]
    q = exact_quantiles(long, value, [i / (n_quantiles - 1) for i in range(n_quantiles)], by=[feature], names=names)
    return q.select(feature, F.array(*names).alias("quantiles"))


def apply_quantiles(long: DataFrame, fitted: DataFrame, feature: str = "feature_id", value: str = "value",
                    out: str = "quantile") -> DataFrame:
    """Fitted or new rows with the share of fitted values below theirs, by interpolation; 0 and 1 beyond the ends.

    A value that several quantiles share gets the middle of their shares.  Null values stay null; rows of unknown features go.
    """
    spark = long.sparkSession
    table = fitted.select(F.col(feature).alias("f"), "quantiles").collect()   # width x quantiles, dealt out in bounded groups
    if not table:
        return long.withColumn(out, F.lit(None).cast("double")).where(F.lit(False))
    per_group = max(1, TABLE_NUMBERS // len(table[0]["quantiles"]))
    parts = None
    for lo in range(0, len(table), per_group):
        held = {r["f"]: np.array(r["quantiles"], float) for r in table[lo:lo + per_group]}
        bc = spark.sparkContext.broadcast(held)

        @F.pandas_udf("double")
        def share(f, v, bc=bc):
            import pandas as pd
            res = np.full(len(f), np.nan)
            for name, at in f.groupby(f).indices.items():
                q = bc.value[name]
                p, x = np.linspace(0, 1, len(q)), v.to_numpy(float)[at]
                up = np.interp(x, q, p)
                res[at] = (up - np.interp(-x, -q[::-1], -p[::-1])) / 2
            return pd.Series(res).where(~np.isnan(res), None)

        mine = long.where(F.col(feature).isin(list(held)))
        mapped = mine.withColumn(out, share(F.col(feature), F.col(value).cast("double")))
        parts = mapped if parts is None else parts.unionByName(mapped)
    return parts


def with_target(df: DataFrame, y: str, forward: Callable[[Column], Column],
                fit: Callable[[DataFrame, str], Callable[[DataFrame], Column]],
                inverse: Callable[[Column], Column], out: str = "prediction") -> DataFrame:
    """Fit on g(y), predict g⁻¹(model(x))."""
    g = df.withColumn("__gy", forward(F.col(y)))
    predict = fit(g, "__gy")
    return g.withColumn(out, inverse(predict(g))).drop("__gy")
