"""Scalar column functions (F1–F14, S4 projection).

Everything here returns a ``Column`` built from built-in expressions, so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def numeric_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Keep numeric columns; integers stay integers, fractions become DOUBLE."""
    cols = []
    for f in df.schema.fields:
        if f.name in keep:
            cols.append(F.col(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, _NUMERIC):
            cols.append(F.col(f.name))
    return df.select(*cols)


def to_number(x: Column | str) -> Column:
    """numeric coercion with NULL fallback instead of an error."""
    return F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else x.try_cast("double")


# Confidence bands (upper bounds, inclusive) and their labels.
CONFIDENCE_BANDS = ((0.01, "EXCELLENT"), (0.02, "GOOD"), (0.05, "FAIR"))
CONFIDENCE_ELSE = "POOR"


def confidence_band(err: Column | str) -> Column:
    """EXCELLENT ≤ .01, GOOD ≤ .02, FAIR ≤ .05, else POOR."""
    e = _c(err)
    expr = None
    for bound, name in CONFIDENCE_BANDS:
        expr = F.when(e <= bound, name) if expr is None else expr.when(e <= bound, name)
    return expr.otherwise(CONFIDENCE_ELSE)


# Ceiling-gap rating thresholds.
GAP_EXCELLENT, GAP_NEAR = 0.01, 0.02


def rate_gap(ceiling: Column | str, r2: Column | str) -> Column:
    """|ceiling − r2| ≤ .01 excellent, ≤ .02 near, else room to improve."""
    g = F.abs(_c(ceiling) - _c(r2))
    return F.when(g <= GAP_EXCELLENT, "excellent").when(g <= GAP_NEAR, "near").otherwise("room")


# Parity verdict thresholds (percent of rows within tolerance).
PASS_PCT, WARN_PCT = 95.0, 90.0


def parity_verdict(pct: Column | str, strict: bool = False) -> Column:
    """≥95 PASS, ≥90 WARNING, else FAIL (strict: ≥95 PASS else FAIL)."""
    p = _c(pct)
    if strict:
        return F.when(p >= PASS_PCT, "PASS").otherwise("FAIL")
    return F.when(p >= PASS_PCT, "PASS").when(p >= WARN_PCT, "WARNING").otherwise("FAIL")


def scale_value(x: Column | str, center: Column | str | float, scale: Column | str | float) -> Column:
    """(x − c)/s."""
    c = F.lit(center) if isinstance(center, (int, float)) else _c(center)
    s = F.lit(scale) if isinstance(scale, (int, float)) else _c(scale)
    return (_c(x) - c) / s


def scale_array(arr: Column | str, centers: Column | str, scales: Column | str) -> Column:
    """F9 over arrays: zip_with((x − c)/s)."""
    cs = F.arrays_zip(_c(centers).alias("c"), _c(scales).alias("s"))
    return F.zip_with(_c(arr), cs, lambda x, p: (x - p["c"]) / p["s"])


def log_grid(lo_exp: float = -3.0, hi_exp: float = 2.0, n: int = 50) -> Column:
    """n log-spaced values 10^lo … 10^hi as an array column."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.pow(F.lit(10.0), F.lit(lo_exp) + F.lit(hi_exp - lo_exp) * i / (n - 1)))


def artifact_path(template: str, dataset: Column | str, ts: Column | str) -> Column:
    """e.g. template 'models/hold%s/best_%s.json' with a yyyyMMdd_HHmmss stamp."""
    return F.format_string(template, _c(dataset).cast("string"),
                           F.date_format(_c(ts), "yyyyMMdd_HHmmss"))


# Sweep file names look like live-vna{yyMMdd}_{HHmmss}.<ext>
SWEEP_NAME_PATTERN = r"(\d{6}_\d{6})"
SWEEP_NAME_FORMAT = "yyMMdd_HHmmss"


def sweep_time(file_name: Column | str) -> Column:
    """F8: timestamp embedded in a sweep file name, NULL when absent/invalid."""
    stamp = F.regexp_extract(_c(file_name), SWEEP_NAME_PATTERN, 1)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit(SWEEP_NAME_FORMAT))


def sweep_file_name(ts: Column | str, ext: str = "csv") -> Column:
    return F.concat(F.lit("live-vna"), F.date_format(_c(ts), SWEEP_NAME_FORMAT), F.lit(f".{ext}"))


# Component status by last-seen age (seconds).
ONLINE_MAX_AGE_S, WARNING_MAX_AGE_S = 300, 1800


def status_flag(age_seconds: Column | str) -> Column:
    """online / warning / offline from the age of the last reading."""
    a = _c(age_seconds)
    return F.when(a <= ONLINE_MAX_AGE_S, "online").when(a <= WARNING_MAX_AGE_S, "warning") \
        .otherwise("offline")


def reading_json(ts: Column | str, temp: Column | str, confidence: Column | str,
                 ms: Column | str, n_features: Column | str) -> Column:
    """F7 + F6: reading record as JSON (temp 3 dp, inference time 1 dp)."""
    return F.to_json(F.struct(
        F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.round(_c(temp), 3).alias("temp_c"),
        _c(confidence).alias("confidence"),
        F.round(_c(ms), 1).alias("inference_time_ms"),
        _c(n_features).alias("features_processed")))


READING_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("temp_c", T.DoubleType()),
    T.StructField("confidence", T.StringType()), T.StructField("inference_time_ms", T.DoubleType()),
    T.StructField("features_processed", T.LongType())])


def from_reading_json(js: Column | str) -> Column:
    return F.from_json(_c(js), READING_SCHEMA)


def prediction_log_line(ts: Column | str, file: Column | str, value: Column | str) -> Column:
    """S10/F6: 'yyyy-MM-dd HH:mm:ss | file | 12.34°C'."""
    return F.format_string("%s | %s | %.2f°C", F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss"),
                           _c(file), _c(value))


def safe_corr(a, b):
    """Pearson correlation as an aggregate; NULL when either side has no variance.

    ``corr`` itself divides by zero there under ANSI rules.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
