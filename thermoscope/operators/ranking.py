"""Exact, skew-safe positional operators.

``row_number() OVER (PARTITION BY g ORDER BY o)`` in Spark moves every row of
a group into one task, and with no PARTITION BY the whole table goes to a
single task.  A key that holds a third of the data therefore stalls the job.

:func:`ranked` computes the same numbers without that funnel:

1. range-partition the rows by ``(g, o)``: Spark samples the bounds, so a hot
   group is spread over many ranges; sort inside each range, and note the
   range number and the place in the range;
2. write this table once to the shared checkpoint folder, so that all later
   reads, and retried tasks, see the same ranges;
3. count rows per ``(range, group)`` — at most ``ranges + groups`` rows —
   and turn the counts into per-group offsets with a window over that small
   table;
4. join the offsets back, null-safely (AQE broadcasts them when they are small).

Sort keys may hold nulls and may be descending; the order is Spark's own.
``ntile`` and exact interpolated quantiles are derived from the same ranks, so
none of them ever gathers a group into one task or the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions, write_table

_PID = "__pid"
_LIX = "__lix"


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ranked(df: DataFrame, order_by: Sequence[Column | str],
           partition_by: Sequence[str] = (), name: str = "rn",
           count_name: str | None = None, num_partitions: int | None = None,
           running: dict[str, Column] | None = None) -> DataFrame:
    """Add ``name`` = exact 1-based row number within ``partition_by``.

    ``order_by`` must be a total order inside each group (end it with a unique
    key) so results are deterministic; nulls and descending keys order as in
    ``orderBy``, and a null group is a group.  With ``count_name`` the group size
    is added as well.  ``running`` maps output names to numeric expressions whose
    running sum (in the same order, inclusive) is added the same way: a sum
    inside the range plus the totals of the earlier ranges of the group.
    """
    parts = list(partition_by)
    n_ranges = num_partitions or shuffle_partitions(df.sparkSession)
    order = [*[F.col(p).asc() for p in parts], *[_as_col(o) for o in order_by]]
    running = running or {}
    tagged = df
    for i, ex in enumerate(running.values()):
        tagged = tagged.withColumn(f"__rv{i}", ex)
    place = F.monotonically_increasing_id()   # range number << 33 | place in the range
    tagged = (tagged.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
              .withColumn(_PID, F.shiftright(place, 33).cast("int"))
              .withColumn(_LIX, place.bitwiseAND(F.lit((1 << 33) - 1))))
    tagged = write_table(tagged)
    if running:
        # a group's part of one range: never more than a range's rows
        upto = Window.partitionBy(_PID, *parts).orderBy(_LIX).rowsBetween(Window.unboundedPreceding, 0)
        for i in range(len(running)):
            tagged = tagged.withColumn(f"__rl{i}", F.sum(f"__rv{i}").over(upto))
    counts = tagged.groupBy(_PID, *parts).agg(   # <= ranges + groups rows
        F.count(F.lit(1)).alias("__c"), F.min(_LIX).alias("__first"),
        *[F.sum(f"__rv{i}").alias(f"__rt{i}") for i in range(len(running))])
    before = Window.partitionBy(*parts).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    for i in range(len(running)):
        counts = counts.withColumn(f"__rb{i}", F.coalesce(F.sum(f"__rt{i}").over(before), F.lit(0)))
    if count_name:
        counts = counts.withColumn(count_name, F.sum("__c").over(Window.partitionBy(*parts)))
    keys = [_PID, *parts]
    small = counts.withColumnsRenamed({k: f"__g{i}" for i, k in enumerate(keys)})
    match = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__g{i}"))
        match = same if match is None else match & same
    out = tagged.join(small, match, "inner")
    out = out.withColumn(name, (F.col("__before") + F.col(_LIX) - F.col("__first") + 1).cast("long"))
    tmp = [f"__g{i}" for i in range(len(keys))]
    for i, nm in enumerate(running):
        out = out.withColumn(nm, F.col(f"__rb{i}") + F.coalesce(F.col(f"__rl{i}"), F.lit(0)))
        tmp += [f"__rv{i}", f"__rl{i}", f"__rt{i}", f"__rb{i}"]
    return out.drop(_PID, _LIX, "__c", "__first", "__before", *tmp)


def ntile_of(rn: Column | str, n: Column | str, k: int) -> Column:
    """SQL ``ntile(k)`` from a 1-based row number and the group size."""
    rn, n = _as_col(rn), _as_col(n)
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
        .otherwise(r + F.floor((rn - 1 - big) / q) + 1).cast("int")


# Accuracy of the first, approximate pass: brackets hold about 3/BRACKET of a group's rows.
BRACKET = 2000
# Below this size the two ranks next to a position may leave the bracket: it is then the whole range.
WHOLE_BELOW = 4 * BRACKET


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = (), tiebreak: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """Interpolated quantiles (``percentile`` / ``quantile_cont``) per group, without sorting the data.

    1. One aggregate with mergeable sketches brackets every requested position
       between two values of the group.
    2. One pass counts the cells of each bracket's values and those below it
       (map-side partial counts); equal values collapse to one row.
    3. The order statistics are read from running counts over the distinct
       values inside the brackets.

    A sketch guarantees its rank error, so the position lies inside its bracket;
    the bracket of a small group is its whole range.
    ``tiebreak`` is accepted for symmetry with :func:`ranked`; equal values need
    no order here.
    """
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    order = sorted(range(len(probs)), key=lambda i: probs[i])   # brackets in ascending order
    probs, names = [float(probs[i]) for i in order], [names[i] for i in order]
    by = list(by)
    base = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))).select(*by, F.col(value).cast("double").alias("__v"))
    wide = 1.5 / BRACKET
    points = [x for p in probs for x in (max(0.0, p - wide), min(1.0, p + wide))]
    sketch = base.groupBy(*by).agg(
        F.percentile_approx("__v", [float(x) for x in points], BRACKET).alias("__b"),
        F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.count(F.lit(1)).alias("__n"))
    # a point at either end of the range is the exact extreme
    small = F.col("__n") < WHOLE_BELOW
    lows = [F.col("__min") if p - wide <= 0 else F.when(small, F.col("__min")).otherwise(F.get("__b", F.lit(2 * i)))
            for i, p in enumerate(probs)]
    highs = [F.col("__max") if p + wide >= 1 else F.when(small, F.col("__max")).otherwise(F.get("__b", F.lit(2 * i + 1)))
             for i, p in enumerate(probs)]
    sketch = write_table(sketch.select(*by, "__n", *[c.alias(f"__lo{i}") for i, c in enumerate(lows)],
                                       *[c.alias(f"__hi{i}") for i, c in enumerate(highs)]))
    named = sketch.withColumnsRenamed({k: f"__g{i}" for i, k in enumerate(by)})
    match = F.lit(True)
    for i, k in enumerate(by):
        match = match & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    # per cell: the value itself inside some bracket, else only which brackets lie above it
    cells = base.join(named if by else F.broadcast(named), match)
    inside = F.lit(False)
    for i in range(len(probs)):
        inside = inside | F.col("__v").between(F.col(f"__lo{i}"), F.col(f"__hi{i}"))
    level = sum((F.when(F.col("__v") >= F.col(f"__lo{i}"), 1).otherwise(0) for i in range(len(probs))), F.lit(0))
    binned = cells.select(*by, level.alias("__lv"), F.when(inside, F.col("__v")).alias("__x")) \
        .groupBy(*by, "__lv", "__x").agg(F.count(F.lit(1)).alias("__c"))
    # cells outside all brackets stand before the next bracket's values: order by (level, outside last)
    run = ranked(binned, [F.col("__lv"), F.col("__x").asc_nulls_last()], by, name="__r",
                 running={"__end": F.col("__c")}).where(F.col("__x").isNotNull())
    run = run.join(sketch.select(*by, "__n").withColumnsRenamed({k: f"__g{i}" for i, k in enumerate(by)}), match)
    aggs = []
    for p, nm in zip(probs, names):
        h = (F.col("__n") - 1) * F.lit(float(p))
        at = lambda r: F.min(F.when(F.col("__end") > r, F.col("__x")))  # noqa: E731  value of 0-based rank r
        lo_v, hi_v = at(F.floor(h)), at(F.ceil(h))
        aggs.append((lo_v + (hi_v - lo_v) * F.max(h - F.floor(h))).alias(nm))
    return run.groupBy(*by).agg(*aggs)
