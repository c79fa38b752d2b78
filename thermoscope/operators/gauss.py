"""Sums of Gaussian kernels over all pairs of rows by a fast Gauss transform.

The kernel dependence of a feature with the target,

    HSIC = (sum Kx Ky - (2/n) sum rx ry + sx sy / n^2) / (n - 1)^2,

with ``K(a, b) = exp(-gamma (a - b)^2)``, row sums r and totals s, needs every pair of
rows.  Here rows fall into cells of a fixed grid (side ``SIDE / sqrt(2 gamma)``), and a
cell keeps only its moments ``sum u^k v^l`` about its centre, k and l below ``ORDER``.  The kernel
between two cells is its Taylor series in both offsets, so the sum over the pairs of two cells is a
bilinear form of their moments.

* One pass turns rows into cell moments: sums inside a task, then one shuffle by cell.
  The work grows with the rows; what follows grows with the cells.
* Cells are dealt to square blocks of ``BLOCK`` x ``BLOCK`` cells; a block also gets the cells around it up
  to ``REACH``, beyond which the kernel is below 1e-17.  The pair sums of a block are
  two matrix products, since the kernel is a product over the two dimensions.
* Row sums of one dimension are local series about the cell centres; with the cell moments they
  give ``sum rx ry`` and the totals, without a second pass over rows.

Error: Hermite functions obey ``|f_m| <= 1.09 (2 gamma)^(m/2) sqrt(m!)`` (Cramer), so a
kernel value is off by less than :func:`error_bound`, 4e-12 at the defaults; a score is a mean of
such values and off by a small multiple of that.  No task holds more than a block, whatever the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import TableStore, shuffle_partitions

ORDER = 14
SIDE = 0.5
BLOCK = 64
REACH = 19   # exp(-gamma (REACH - 1)^2 h^2) < 1e-17 with h = SIDE / sqrt(2 gamma)
BATCH_ROWS = 4096


def error_bound(order: int = ORDER, side: float = SIDE) -> float:
    """Largest error of one two-dimensional kernel value."""
    r = side / math.sqrt(2.0)
    tail = sum(r ** k / math.sqrt(math.factorial(k)) for k in range(order, order + 60))
    whole = sum(r ** k / math.sqrt(math.factorial(k)) for k in range(60))
    one = 1.09 * 2 * tail * whole   # one dimension: a term of either offset is cut
    return 2 * one + one * one      # the other factor of the product is at most 1


def _derivatives(d: np.ndarray, gamma: float, order: int) -> np.ndarray:
    """Derivatives 0..order-1 of exp(-gamma z^2) at ``d``, along the last axis."""
    out = np.empty((*d.shape, order))
    out[..., 0] = np.exp(-gamma * d * d)
    if order > 1:
        out[..., 1] = -2 * gamma * d * out[..., 0]
    for m in range(2, order):
        out[..., m] = -2 * gamma * (d * out[..., m - 1] + (m - 1) * out[..., m - 2])
    return out


def _coupling(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """T[i, k, j, l]: what offset power l in cell b[j] adds to the series term k of cell a[i]."""
    h = SIDE / math.sqrt(2 * gamma)
    f = _derivatives((a[:, None] - b[None, :]) * h, gamma, 2 * ORDER - 1)
    k = np.arange(ORDER)
    fact = np.array([math.factorial(i) for i in k], float)
    t = f[:, :, k[:, None] + k[None, :]] * ((-1.0) ** k / fact)[None, None, None, :] / fact[None, None, :, None]
    return t.transpose(0, 2, 1, 3)


def cell_moments(long: DataFrame, gamma: float, feature: str, value: str, y: str) -> DataFrame:
    """``feature, cx, cy, m`` (ORDER x ORDER moments, row by row) of every cell: partial sums of the tasks, then one shuffle."""
    h = SIDE / math.sqrt(2 * gamma)
    rows = long.select(F.col(feature).cast("long").alias("feature"), F.col(value).cast("double").alias("x"),
                       F.col(y).cast("double").alias("t"))
    rows = rows.where("x IS NOT NULL AND t IS NOT NULL AND NOT isnan(x) AND NOT isnan(t)")

    def partial(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BATCH_ROWS):
                f, x, t = (c.to_numpy() for c in b.slice(lo, BATCH_ROWS).columns)
                cx, cy = np.floor(x / h).astype(np.int64), np.floor(t / h).astype(np.int64)
                order = np.lexsort((cy, cx, f))
                f, x, t, cx, cy = f[order], x[order], t[order], cx[order], cy[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])
                at = np.flatnonzero(new)
                u = (x - (cx + 0.5) * h)[:, None] ** np.arange(ORDER)
                v = (t - (cy + 0.5) * h)[:, None] ** np.arange(ORDER)
                m = np.add.reduceat((u[:, :, None] * v[:, None, :]).reshape(len(f), -1), at, axis=0)
                yield _rows([f[at], cx[at], cy[at]], m, ["feature", "cx", "cy"])

    parts = rows.mapInArrow(partial, "feature long, cx long, cy long, m binary")
    return added(parts, ["feature", "cx", "cy"])


def _rows(keys, m: np.ndarray, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())],
                                      [*names, "m"])


def _values(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the number arrays ``m`` of every key; a task streams its sorted rows and holds one batch.

    A key has at most one row per batch of an earlier step, so sums are taken per task before they meet.
    """
    def run(batches):
        held = None   # the last key of the batch before, with its sum so far
        for b in batches:
            width = len(b.column("m")[0].as_py()) // 8 if b.num_rows else 0
            if not width:
                continue
            k = np.stack([b.column(c).to_numpy() for c in keys], 1)
            m = _values(b.column("m"), width)
            if held is not None:
                k, m = np.vstack((held[0][None], k)), np.vstack((held[1][None], m))
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]).any(1)
            at = np.flatnonzero(new)
            sums = np.add.reduceat(m, at, axis=0)
            if len(at) > 1:
                yield _rows(list(np.ascontiguousarray(k[at[:-1]].T)), sums[:-1], keys)
            held = (k[at[-1]], sums[-1])
        if held is not None:
            yield _rows([held[0][i:i + 1] for i in range(len(keys))], held[1][None], keys)

    schema = ", ".join(f"{k} long" for k in keys) + ", m binary"
    parts = parts.select(*keys, "m")
    early = parts.sortWithinPartitions(*keys).mapInArrow(run, schema)
    n = shuffle_partitions(parts.sparkSession)
    return early.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _margin(cells: DataFrame, axis: str) -> DataFrame:
    """``feature, c, m``: moments of one dimension (ORDER numbers per cell of that axis)."""
    def run(batches):
        for b in batches:
            m = _values(b.column("m"), ORDER * ORDER).reshape(-1, ORDER, ORDER)
            part = m[:, :, 0] if axis == "cx" else m[:, 0, :]
            yield _rows([b.column("feature").to_numpy(), b.column(axis).to_numpy()], part, ["feature", "c"])

    return added(cells.mapInArrow(run, "feature long, c long, m binary"), ["feature", "c"])


def _blocks(df: DataFrame, axes: list[str]) -> DataFrame:
    """Every cell in its block and, as ``own = false``, in the blocks within REACH cells."""
    out = df.withColumn("own", F.lit(True))
    for axis in axes:
        block = lambda c: F.floor(c / F.lit(float(BLOCK))).cast("long")
        out = out.withColumn(f"b_{axis}", F.explode(F.sequence(block(F.col(axis) - REACH), block(F.col(axis) + REACH))))
        out = out.withColumn("own", F.col("own") & (F.col(f"b_{axis}") == block(F.col(axis))))
    return out


def _local_series(margin: DataFrame, gamma: float) -> DataFrame:
    """``feature, c, m``: coefficients of the row sum about the centre of every cell."""
    def run(key, t):
        c, m, own = t.column("c").to_numpy(), _values(t.column("m"), ORDER), t.column("own").to_numpy()
        mine = np.flatnonzero(own)
        coef = np.zeros((len(mine), ORDER))
        if len(mine):
            coef = np.einsum("ikjl,jl->ik", _coupling(c[mine], c, gamma), m)
        rows = _rows([np.full(len(mine), key[0].as_py()), c[mine]], coef, ["feature", "c"])
        return pa.Table.from_batches([rows])

    return _blocks(margin, ["c"]).groupBy("feature", "b_c").applyInArrow(run, "feature long, c long, m binary")


def _pair_sums(cells: DataFrame, gamma: float) -> DataFrame:
    """``feature, kk``: sum of Kx Ky over all pairs, one partial per block."""
    def run(key, t):
        cx, cy, own = (t.column(c).to_numpy() for c in ("cx", "cy", "own"))
        m = _values(t.column("m"), ORDER * ORDER).reshape(-1, ORDER, ORDER)
        total = 0.0
        if own.any():
            ux, ix = np.unique(cx, return_inverse=True)
            uy, iy = np.unique(cy, return_inverse=True)
            grid = np.zeros((len(ux), ORDER, len(uy), ORDER))
            grid[ix, :, iy, :] = m
            grid = grid.reshape(len(ux) * ORDER, len(uy) * ORDER)
            tx = _coupling(ux, ux, gamma).reshape(len(ux) * ORDER, -1)
            ty = _coupling(uy, uy, gamma).reshape(len(uy) * ORDER, -1)
            field = (tx @ grid @ ty.T).reshape(len(ux), ORDER, len(uy), ORDER)
            mine = np.flatnonzero(own)
            total = float((m[mine] * field[ix[mine], :, iy[mine], :]).sum())
        return pa.table({"feature": pa.array([key[0].as_py()], pa.int64()), "kk": [total]})

    return _blocks(cells, ["cx", "cy"]).groupBy("feature", "b_cx", "b_cy").applyInArrow(run, "feature long, kk double")


def _row_sum_products(cells: DataFrame, sx: DataFrame, sy: DataFrame) -> DataFrame:
    """``feature, n, rr, tx, ty``: rows, sum rx ry and the totals of both kernels."""
    met = (cells.join(sx.select("feature", F.col("c").alias("cx"), F.col("m").alias("ax")), ["feature", "cx"])
           .join(sy.select("feature", F.col("c").alias("cy"), F.col("m").alias("ay")), ["feature", "cy"]))

    def run(batches):
        for b in batches:
            m = _values(b.column("m"), ORDER * ORDER).reshape(-1, ORDER, ORDER)
            ax, ay = _values(b.column("ax"), ORDER), _values(b.column("ay"), ORDER)
            yield pa.RecordBatch.from_arrays(
                [b.column("feature"), pa.array(m[:, 0, 0]), pa.array(np.einsum("ckl,ck,cl->c", m, ax, ay)),
                 pa.array((m[:, :, 0] * ax).sum(1)), pa.array((m[:, 0, :] * ay).sum(1))], ["feature", "n", "rr", "tx", "ty"])

    parts = met.select("feature", "m", "ax", "ay").mapInArrow(run, "feature long, n double, rr double, tx double, ty double")
    return parts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "rr", "tx", "ty")])


def hsic(long: DataFrame, gamma: float = 1.0, feature: str = "feature_id", value: str = "value", y: str = "y") -> DataFrame:
    """``feature, n, score`` of every feature of a long table (feature, value, y); nulls and NaN are left out.

    The score of a feature with fewer than two rows is null.
    """
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    store = TableStore(long.sparkSession)
    cells = store.write(cell_moments(long, gamma, feature, value, y), "cells")
    sx, sy = (_local_series(_margin(cells, axis), gamma) for axis in ("cx", "cy"))
    sums = _row_sum_products(cells, sx, sy).join(
        _pair_sums(cells, gamma).groupBy("feature").agg(F.sum("kk").alias("kk")), "feature")
    n = F.col("n")
    score = (F.col("kk") - 2 / n * F.col("rr") + F.col("tx") * F.col("ty") / (n * n)) / ((n - 1) * (n - 1))
    return sums.select(F.col("feature").cast(long.schema[feature].dataType).alias(feature),
                       n.cast("long").alias("n"), F.when(n > 1, score).alias("score"))
