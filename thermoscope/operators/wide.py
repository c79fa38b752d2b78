"""Truncated SVD and PCA of wide tables without a features x features matrix.

A randomised block Krylov range finder with a tall-skinny QR:

* A pass multiplies every row by the basis found so far (features x b, b of some hundreds).  Each
  task keeps the triangle R of the QR of its products and the sum ``X^T (X z)`` for the newest block
  z; triangles meet in a tree of QRs, the sums by blocks of ``BLOCK_COLS`` columns.
* The newest sum, made orthogonal to the basis, is the next block.  The singular values
  of the joined R are the best approximations inside the basis, from the products themselves, so
  their accuracy is not that of squared values.  The passes end when the wanted ones
  stand still, or when the basis holds every direction: then they are exact.
* Rows reach the tasks in blocks of columns, so a batch is bounded at any width.  Tasks and
  driver hold features x b numbers, never features x features.

``update`` is the incremental form: the former factors enter as a few extra rows beside the new data.
A null or NaN value raises: impute first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import TableStore
from .gauss import added

BLOCK_COLS = 1024
OVERSAMPLE = 10
TOLERANCE = 1e-10
MAX_PASSES = 40
FAN_IN = 16


def _matrices(batches, width: int, block: int):
    """Whole rows as matrices, from records (row block, values) that arrive in order."""
    parts, held = -(-width // block), None
    for b in batches:
        rows = pa.concat_arrays([held, b.column(0)]) if held is not None else b.column(0)
        whole = len(rows) // parts
        held = rows.slice(whole * parts) if len(rows) % parts else None
        if whole:
            flat = rows.slice(0, whole * parts).flatten()
            if flat.null_count or len(flat) != whole * width:
                raise ValueError("rows need values in every feature, of one width")
            x = flat.to_numpy(zero_copy_only=False).reshape(whole, width)
            if not np.isfinite(x).all():
                raise ValueError("rows need finite values: impute first")
            yield x
    if held is not None:
        raise ValueError("rows need values in every feature, of one width")


def _blocked(df: DataFrame, features: str, width: int, block: int) -> DataFrame:
    """Every row as its blocks of columns, one record each, in order."""
    cuts = F.sequence(F.lit(1), F.lit(width), F.lit(block))
    x = F.col(features).cast("array<double>")
    return df.select(F.explode(F.transform(cuts, lambda c: F.slice(x, c, block))).alias("v"))


def _numbers(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, float).tobytes()


def _blocks_of(kind: int, m: np.ndarray, block: int):
    """Rows (kind, block, numbers) of a features x b matrix."""
    for k, lo in enumerate(range(0, len(m), block)):
        yield kind, k, _numbers(m[lo:lo + block])


def _record(rows) -> pa.RecordBatch:
    kinds, blocks, ms = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(blocks, pa.int64()), pa.array(ms, pa.binary())],
                                      ["kind", "block", "m"])


def _gather(sums: DataFrame, columns: int) -> np.ndarray:
    """A features x ``columns`` matrix from its summed blocks (bounded by the width)."""
    rows = sorted(sums.collect(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["m"], float).reshape(-1, columns) for r in rows])


def _moments(blocked: DataFrame, width: int, block: int) -> tuple[int, np.ndarray, float]:
    """Rows, column means and the sum of squares about the means."""
    def run(batches):
        n, s, q, origin = 0, np.zeros(width), np.zeros(width), None
        for x in _matrices(batches, width, block):
            origin = x[0].copy() if origin is None else origin
            n += len(x)
            s += (x - origin).sum(0)
            q += ((x - origin) ** 2).sum(0)
        if n:   # sums about the task's own origin are moved to zero mean, not to zero
            mean = origin + s / n
            yield _record(list(_blocks_of(n, np.column_stack((mean, q - s * s / n)), block)))

    stats = blocked.mapInArrow(run, "kind long, block long, m binary")

    def merged(key, t):
        n, mean, m2 = 0, None, None
        for k, m in zip(t.column("kind").to_pylist(), t.column("m").to_pylist()):
            m = np.frombuffer(m, float).reshape(-1, 2)
            if mean is None:
                n, mean, m2 = k, m[:, 0].copy(), m[:, 1].copy()
                continue
            d, both = m[:, 0] - mean, n + k
            mean += d * k / both
            m2 += m[:, 1] + d * d * n * k / both
            n = both
        return pa.table({"kind": pa.array([n], pa.int64()), "block": pa.array([key[0].as_py()], pa.int64()),
                         "m": pa.array([_numbers(np.column_stack((mean, m2)))], pa.binary())})

    # partials of the tasks meet in two steps, so no task reads those of all others
    stats = stats.withColumn("b", F.pmod(F.spark_partition_id(), F.lit(64)))
    schema = "kind long, block long, m binary"
    first = stats.groupBy("block", "b").applyInArrow(lambda k, t: merged(k, t), schema)
    rows = sorted(first.groupBy("block").applyInArrow(lambda k, t: merged(k, t), schema).collect(), key=lambda r: r["block"])
    if not rows:
        return 0, np.zeros(width), 0.0
    both = np.concatenate([np.frombuffer(r["m"], float).reshape(-1, 2) for r in rows])
    return int(rows[0]["kind"]), both[:, 0].copy(), float(both[:, 1].sum())


def _joined_triangle(parts: DataFrame, store: TableStore, name: str, b: int) -> np.ndarray:
    """R of all products: triangles meet in a tree of QRs on the executors, the last few on the driver."""
    def run(batches):
        r = None
        for batch in batches:
            for m in batch.column("m").to_pylist():
                r = np.linalg.qr(np.vstack(([r] if r is not None else []) + [np.frombuffer(m, float).reshape(-1, b)]), "r")
        if r is not None:
            yield _record([(0, 0, _numbers(r))])

    left, k = parts.count(), 0
    while left > FAN_IN:
        left, k = -(-left // FAN_IN), k + 1
        parts = store.write(parts.repartition(left).mapInArrow(run, "kind long, block long, m binary"), f"{name}-{k}")
    rows = [np.frombuffer(r["m"], float).reshape(-1, b) for r in parts.collect()]
    return np.linalg.qr(np.vstack(rows), "r") if rows else np.zeros((0, b))


def _pass(blocked: DataFrame, store: TableStore, step: int, basis: np.ndarray, newest: int, mean: np.ndarray,
          block: int):
    """(R of X basis, X^T X z for the ``newest`` columns z of the basis) with X the centred rows."""
    width, b = basis.shape
    bc = blocked.sparkSession.sparkContext.broadcast((basis, mean))

    def run(batches):
        q, mu = bc.value
        r, w = None, np.zeros((-(-width // block) * block, newest))   # blocks of one size: the last is filled up
        for x in _matrices(batches, width, block):
            x = x - mu
            y = x @ q
            w[:width] += x.T @ y[:, b - newest:]
            r = np.linalg.qr(y if r is None else np.vstack((r, y)), "r")
        if r is not None:
            yield _record([(0, 0, _numbers(r))])
            for row in _blocks_of(1, w, block):
                yield _record([row])

    parts = store.write(blocked.mapInArrow(run, "kind long, block long, m binary"), f"pass-{step}")
    r = _joined_triangle(parts.where("kind = 0"), store, f"tree-{step}", b)
    w = _gather(added(parts.where("kind = 1"), ["kind", "block"]), newest)[:width] if len(r) else np.zeros((width, newest))
    store.drop(f"pass-{step}")
    return r, w


def _orthonormal(w: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Columns that span what ``w`` adds to ``basis`` (none if it adds nothing)."""
    scale = np.linalg.norm(w, axis=0).max(initial=0.0)
    if scale == 0:
        return w[:, :0]
    w = w / scale
    for _ in range(2):   # a second round removes what rounding left of the basis
        if basis is not None:
            w = w - basis @ (basis.T @ w)
        u, s, _ = np.linalg.svd(w, full_matrices=False)
        w = u[:, s > 1e-12 * max(1.0, s[0])]
        if not w.shape[1]:
            break
    return w


def svd(df: DataFrame, features: str, k: int, center: bool = False, seed: int = 42, tol: float = TOLERANCE,
        max_passes: int = MAX_PASSES, extra: np.ndarray | None = None, width: int | None = None,
        extra_mean: tuple[int, np.ndarray] | None = None, block_cols: int = BLOCK_COLS) -> dict:
    """The ``k`` greatest singular values and right vectors of an array column.

    Returns ``singular_values, components (features x k), mean, n, total (sum of squares about the mean), passes``.
    ``extra`` rows (already centred) count beside the data; ``extra_mean`` is the (rows, mean) they stand for.
    """
    store = TableStore(df.sparkSession)
    if width is None:
        width = df.select(F.max(F.size(features))).first()[0] or 0
    if width <= 0:
        raise ValueError("no features")
    blocked = _blocked(df, features, width, block_cols)
    n, mean, total = _moments(blocked, width, block_cols)
    shift = mean if center else np.zeros(width)
    more = extra if extra is not None else np.zeros((0, width))
    if extra_mean is not None and n:
        m, old = extra_mean
        more = np.vstack((more, np.sqrt(n * m / (n + m)) * (old - mean)))
    rng = np.random.default_rng(seed)
    size = min(width, k + OVERSAMPLE)
    basis = np.linalg.qr(rng.normal(size=(width, size)))[0]
    newest, seen, passes = size, None, 0
    while True:
        passes += 1
        r, w = _pass(blocked, store, passes, basis, newest, shift, block_cols)
        z = basis[:, basis.shape[1] - newest:]
        r = np.linalg.qr(np.vstack((r, more @ basis)), "r")
        w = w + more.T @ (more @ z)
        s = np.linalg.svd(r, compute_uv=False)[:k]
        still = seen is not None and len(s) == len(seen) and np.all(np.abs(s - seen) <= tol * max(s[0], 1e-300))
        if still or basis.shape[1] >= width or passes >= max_passes:
            break
        fresh = _orthonormal(w, basis)[:, :width - basis.shape[1]]
        if not fresh.shape[1]:
            break   # the basis holds the whole row space
        basis, newest, seen = np.hstack((basis, fresh)), fresh.shape[1], s
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    v = basis @ vt[:k].T
    for j in range(v.shape[1]):   # the largest loading is positive
        if v[np.argmax(np.abs(v[:, j])), j] < 0:
            v[:, j] = -v[:, j]
    store.close()
    return {"singular_values": s[:k], "components": v, "mean": mean if center else None, "n": n, "total": total,
            "passes": passes}


def pca(df: DataFrame, features: str, k: int, **options) -> dict:
    """Centred decomposition: what ``decompose.project`` reads, with variances and their shares of the whole."""
    return _as_pca(svd(df, features, k, center=True, **options))


def _as_pca(fit: dict) -> dict:
    var = fit["singular_values"] ** 2 / max(1, fit["n"] - 1)
    whole = fit["total"] / max(1, fit["n"] - 1)
    return {**fit, "explained_variance": var, "ratio": var / whole if whole else var, "k": len(var)}


def update(fit: dict, df: DataFrame, features: str, **options) -> dict:
    """A fitted PCA after more rows: the former factors stand for the rows they came from.

    Exact while the former fit held the whole row space; otherwise what it had cut off stays cut off.
    """
    k, m, old = fit["k"], fit["n"], fit["mean"]
    rows = fit["singular_values"][:, None] * fit["components"].T
    new = svd(df, features, k, center=True, extra=rows, extra_mean=(m, old), width=len(old), **options)
    n = new["n"]
    if not n:
        return fit
    total = fit["total"] + new["total"] + n * m / (n + m) * float(((old - new["mean"]) ** 2).sum())
    return _as_pca({**new, "n": n + m, "mean": old + (new["mean"] - old) * n / (n + m), "total": total})
