"""Mutual information of each feature with a numeric target by nearest neighbours.

The estimator of Kraskov, Stoegbauer and Grassberger (2004, the first of the two):
``psi(n) + psi(k) - mean(psi(nx) + psi(ny))`` and at least 0, where e is the distance of a row's k-th neighbour in
(feature, target) by the largest difference, and nx, ny count the rows (itself included) that are closer than e in one of
the two alone; rows with an equal value always count.

* Values are divided by their standard deviation, rounded to six digits so that any engine divides by the same number.
  No noise is added to break ties.
* **Neighbours**, where a target has few values (classes): rows of one feature and value are sorted by the feature, in pieces;
  the k rows on either side bound e, and settle it unless another value or piece lies closer.  What is left meets
  the pieces within its bound, where again k rows on either side of its place are all that matter (``_reach_by_values``).
* **Neighbours** of other targets come from the tree of pivots; features lie so far apart in a third
  coordinate that none is another's neighbour, so one tree serves all features.
* **Counts** are differences of ranks: values and the two ends of every row's interval are sorted together by range, and a
  running count over values answers all intervals.  A feature spans as many ranges as it needs.

Rows with a null or NaN in feature or target are left out; a feature with k or fewer rows scores null, one without variance
in feature or target scores 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from .neighbors import LEAF, knn
from .ranking import ranked

NEIGHBORS = 3   # fixed value: the reference's library default
SCALE_DIGITS = 6
APART = 4.0     # features are this many ranges apart
VALUES = 64     # a target of more values goes to the tree
PIECE = 1 << 20   # rows of a piece at most, about
CHUNK = 1 << 17   # rows that meet a piece at once, about


def digamma(n: Column) -> Column:
    """psi of a positive integer: six steps of its recurrence, then the asymptotic series."""
    z = n.cast("double")
    below = F.lit(0.0)
    for j in range(6):
        below = below + 1.0 / (z + j)
    y = z + 6
    w = 1.0 / (y * y)
    series = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return F.log(y) - 0.5 / y - series - below


def _ordered(v: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles they stand for (its own inverse up to the type)."""
    i = np.ascontiguousarray(v, np.float64).view(np.int64)
    return np.where(i < 0, np.int64(-2**63) - i, i)


def _double(i: np.ndarray) -> np.ndarray:
    return np.where(i < 0, np.int64(-2**63) - i, i).view(np.float64)


def _ends(v: pd.Series, e: pd.Series, up: bool) -> pd.Series:
    """The last number on one side whose difference from ``v``, as computed, is below ``e`` (v itself when e is 0).

    The sum v + e rounds, so the neighbour at distance e could fall on the wrong side; the end is found by halving
    between a number that is surely inside and one that is surely not.
    """
    x, r = v.to_numpy(float), e.to_numpy(float)
    sign = 1.0 if up else -1.0
    far = x + sign * r
    slack = 8 * np.spacing(np.maximum(np.abs(x), r))
    low, high = _ordered(far - sign * slack), _ordered(far + sign * slack)
    inside = sign * (_double(low) - x) < r
    low = np.where(inside & (sign * (_double(low) - x) >= 0), low, _ordered(x))
    for _ in range(64):
        mid = low + (high - low) // 2
        ok = sign * (_double(mid) - x) < r
        low, high = np.where(ok, mid, low), np.where(ok, high, mid)
    return pd.Series(np.where(r > 0, _double(low), x))


def _counts(rows: DataFrame, value: str) -> DataFrame:
    """``id, n``: rows of the feature within each row's interval, by ranks."""
    @F.pandas_udf("double")
    def above(v: pd.Series, e: pd.Series) -> pd.Series:
        return _ends(v, e, True)

    @F.pandas_udf("double")
    def below(v: pd.Series, e: pd.Series) -> pd.Series:
        return _ends(v, e, False)

    v = F.col(value)
    marks = F.array(F.struct(F.lit(1).alias("kind"), v.alias("v")), F.struct(F.lit(0).alias("kind"), below(v, F.col("e")).alias("v")),
                    F.struct(F.lit(2).alias("kind"), above(v, F.col("e")).alias("v")))
    flat = rows.select("f", "id", F.explode(marks).alias("m")).select("f", "id", "m.kind", "m.v")
    run = ranked(flat, ["v", "kind"], ["f"], name="r", running={"upto": F.when(F.col("kind") == 1, 1).otherwise(0)})
    sign = F.when(F.col("kind") == 2, F.col("upto")).when(F.col("kind") == 0, -F.col("upto")).otherwise(0)
    return run.groupBy("id").agg(F.sum(sign).alias("n"))


def _beside(queries: pd.DataFrame, piece: pd.DataFrame, k: int) -> pd.DataFrame:
    """``id, d``: distances of each query to the 2k rows beside its place in a piece (one feature and target value)."""
    piece = piece.sort_values("x")
    xs = np.repeat(piece["x"].to_numpy(float), np.minimum(piece["c"].to_numpy(np.int64), k))
    x, t = queries["x"].to_numpy(float), queries["t"].to_numpy(float)
    at = np.searchsorted(xs, x)[:, None] + np.arange(-k, k)[None, :]
    inside = (at >= 0) & (at < len(xs))
    d = np.maximum(np.abs(x[:, None] - xs[np.clip(at, 0, len(xs) - 1)]), np.abs(t - piece["v"].iloc[0])[:, None])
    d = np.sort(np.where(inside, d, np.inf), axis=1)[:, :k]
    return pd.DataFrame({"id": queries["id"].to_numpy(), "d": list(d)})


def _reach_by_values(scaled: DataFrame, values: DataFrame, total: int, k: int) -> DataFrame:
    """``f, id, x, t, e, nt``: the distance of every row's k-th neighbour, and the count of its target.

    ``values`` holds ``f, t, c``, the count of each target value.  A row outside a piece of sorted rows is at least as
    far as the piece next to it, a row of another value at least as far as the next value: a bound no larger is exact.
    """
    beside = Window.partitionBy("f").orderBy("t")   # at most VALUES rows
    values = materialize(values.withColumn("gap", F.least(F.col("t") - F.lag("t").over(beside), F.lead("t").over(beside) - F.col("t"))))
    ranges = max(shuffle_partitions(scaled.sparkSession), total // PIECE + 1)
    tagged = materialize(scaled.select("f", "t", "x", "id").repartitionByRange(ranges, "f", "t", "x").sortWithinPartitions("f", "t", "x")
                         .withColumn("piece", F.spark_partition_id()))
    pieces = tagged.groupBy("piece", "f", "t").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))   # at most ranges + values
    order = Window.partitionBy("f", "t").orderBy("piece")
    pieces = materialize(pieces.withColumn("before", F.lag("hi").over(order)).withColumn("after", F.lead("lo").over(order))
                         .join(values, ["f", "t"]))
    row = Window.partitionBy("piece", "f", "t").orderBy("x")   # a part of one range
    near = F.array(*[F.col("x") - F.lag("x", i).over(row) for i in range(1, k + 1)],
                   *[F.lead("x", i).over(row) - F.col("x") for i in range(1, k + 1)])
    own = tagged.withColumn("d", F.slice(F.array_sort(F.array_compact(near)), 1, k)).withColumn(
        "u", F.coalesce(F.get("d", F.lit(k - 1)), F.lit(float("inf")))).join(pieces.hint("merge"), ["piece", "f", "t"])
    closed = ((F.col("before").isNull() | (F.col("x") - F.col("before") >= F.col("u")))
              & (F.col("after").isNull() | (F.col("after") - F.col("x") >= F.col("u")))
              & (F.col("gap").isNull() | (F.col("gap") >= F.col("u"))))
    own = materialize(own.select("piece", "f", "t", "x", "id", "d", "u", "c", closed.alias("closed")))
    open_ = own.where("NOT closed").select("piece", "f", "t", "x", "id", "d", "u")
    other = pieces.select(F.col("piece").alias("p"), F.col("f").alias("g"), F.col("t").alias("v"), "lo", "hi")
    visits = materialize(open_.join(other, (F.col("f") == F.col("g")) & ~((F.col("piece") == F.col("p")) & (F.col("t") == F.col("v")))
                                    & (F.abs(F.col("t") - F.col("v")) < F.col("u")) & (F.col("x") - F.col("hi") < F.col("u"))
                                    & (F.col("lo") - F.col("x") < F.col("u"))).select("p", "g", "v", "id", "x", "t"))
    # rows that reach one piece are dealt to chunks, each with its own copy of the piece
    keys = ["p", "g", "v"]
    chunks = visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = visits.join(chunks, keys).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    members = tagged.groupBy(F.col("piece").alias("p"), F.col("f").alias("g"), F.col("t").alias("v"), "x").agg(
        F.count(F.lit(1)).alias("c")).join(chunks, keys).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    found = dealt.groupBy(*keys, "chunk").cogroup(members.groupBy(*keys, "chunk")).applyInPandas(
        lambda q, m: _beside(q, m, k) if len(q) else pd.DataFrame({"id": [], "d": []}, dtype=object), "id long, d array<double>")
    best = F.get(F.array_sort(F.flatten(F.collect_list("d"))), F.lit(k - 1))
    met = open_.select("id", "d").union(found).groupBy("id").agg(best.alias("e"))
    met = materialize(open_.select("f", "id", "x", "t").join(met, "id"))
    counted = met.join(values.select("f", F.col("t").alias("v"), "c"), "f").where(
        (F.abs(F.col("t") - F.col("v")) < F.col("e")) | (F.col("t") == F.col("v"))).groupBy("id").agg(F.sum("c").alias("nt"))
    cols = ["f", "id", "x", "t", "e", "nt"]
    return own.where("closed").select("f", "id", "x", "t", F.col("u").alias("e"), F.col("c").alias("nt")).union(
        met.join(counted, "id").select(*cols))


def knn_mi(long: DataFrame, k: int = NEIGHBORS, feature: str = "feature_id", value: str = "value", y: str = "y",
           leaf: int = LEAF) -> DataFrame:
    """``feature, n, score`` of every feature of a long table (feature, value, y)."""
    kind = long.schema[feature].dataType
    rows = long.select(F.col(feature).cast("long").alias("f"), F.col(value).cast("double").alias("x"),
                       F.col(y).cast("double").alias("t")).where("x IS NOT NULL AND t IS NOT NULL AND NOT isnan(x) AND NOT isnan(t)")
    stats = materialize(rows.groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("x"), SCALE_DIGITS).alias("sx"), F.round(F.stddev_pop("t"), SCALE_DIGITS).alias("st"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("t").alias("t0"), F.max("t").alias("t1")))
    use = stats.where(f"n > {k} AND sx > 0 AND st > 0")
    scaled = rows.join(F.broadcast(use.select("f", "sx", "st")), "f").select(   # one row per feature: bounded by the width
        "f", (F.col("x") / F.col("sx")).alias("x"), (F.col("t") / F.col("st")).alias("t"))
    # stored with its numbers: the same rows keep the same numbers in every later job
    scaled = materialize(scaled.withColumn("id", F.monotonically_increasing_id()))
    span = use.agg(F.max(F.greatest((F.col("x1") - F.col("x0")) / F.col("sx"), (F.col("t1") - F.col("t0")) / F.col("st")))).first()[0]
    if span is not None:
        values = materialize(scaled.groupBy("f", "t").agg(F.count(F.lit(1)).alias("c")))
        most, total = values.groupBy("f").agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("c")).agg(F.max("m"), F.sum("c")).first()
        if most <= VALUES:
            rows = materialize(_reach_by_values(scaled, values, total, k))
            both = _counts(rows, "x").withColumnRenamed("n", "nx").join(rows.select("id", "f", "nt"), "id")
        else:
            apart = F.col("f") * F.lit(APART * float(span) + 1.0)
            near = knn(scaled.select("id", F.array(apart, "x", "t").alias("p")), k, "p", "id", leaf, metric="chebyshev")
            reach = near.where(F.col("rank") == k).select("id", F.col("dist").alias("e"))
            rows = materialize(scaled.join(reach, "id"))
            both = _counts(rows, "x").withColumnRenamed("n", "nx").join(_counts(rows, "t").withColumnRenamed("n", "nt"), "id") \
                .join(rows.select("id", "f"), "id")
        means = both.groupBy("f").agg(
            F.avg(digamma(F.col("nx")) + digamma(F.col("nt"))).alias("m"))
        out = stats.join(means, "f", "left")
    else:
        out = stats.withColumn("m", F.lit(None).cast("double"))
    score = F.greatest(F.lit(0.0), digamma(F.col("n")) + digamma(F.lit(k)) - F.col("m"))
    return out.select(F.col("f").cast(kind).alias(feature), "n",
                      F.when(F.col("n") <= k, None).when(F.col("m").isNull(), F.lit(0.0)).otherwise(score).alias("score"))
