"""Seeded synthetic 42-feature rows (S15), keyed by the rows of a given table.

Each (row, feature) value is a portable draw: two md5-hash uniforms turned
into a normal by Box–Muller, or one uniform scaled to [a, b].  The same keys
give the same values on every executor and in the SQL oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit, sql_hash32

# 7 measurement groups × 6 statistics; (kind, a, b) = normal(mean, std)
# or uniform(low, high), in the group order return loss, phase, Rs, SWR, Xs, |Z|, θ.
GROUPS_SET1 = (("normal", -15.0, 5.0), ("normal", 45.0, 30.0), ("normal", 50.0, 10.0),
               ("uniform", 1.0, 3.0), ("normal", 0.0, 25.0), ("normal", 75.0, 20.0),
               ("normal", 0.0, 45.0))
GROUPS_SET2 = (("normal", -12.0, 8.0), ("normal", 30.0, 40.0), ("normal", 50.0, 15.0),
               ("uniform", 1.0, 4.0), ("normal", 0.0, 30.0), ("normal", 75.0, 25.0),
               ("normal", 0.0, 50.0))
PER_GROUP = 6


def _u(key: Column, j: int, part: str, seed: int) -> Column:
    # strictly inside (0, 1) so the logarithm is finite
    return (hash_unit(key, f"{seed}:{j}:{part}") * 4294967296.0 + 0.5) / 4294967297.0


def synth_features(keys: DataFrame, key: str, groups=GROUPS_SET1, seed: int = 42) -> DataFrame:
    """(row_id, feature_id, value) with 42 features per key row."""
    cols = []
    k = F.col(key)
    for g, (kind, a, b) in enumerate(groups):
        for s in range(PER_GROUP):
            j = g * PER_GROUP + s
            if kind == "normal":
                z = F.sqrt(-2.0 * F.log(_u(k, j, "a", seed))) * F.cos(2 * math.pi * _u(k, j, "b", seed))
                v = F.lit(a) + F.lit(b) * z
            else:
                v = F.lit(a) + F.lit(b - a) * _u(k, j, "a", seed)
            cols.append(F.struct(F.lit(j).alias("feature_id"), v.alias("value")))
    return keys.select(k.alias("row_id"), F.inline(F.array(*cols)))


def sql_synth_features(table: str, key: str, groups=GROUPS_SET1, seed: int = 42) -> str:
    def u(j, part):
        return f"(({sql_hash32(key, f'{seed}:{j}:{part}')} + 0.5) / 4294967297.0)"
    parts = []
    for g, (kind, a, b) in enumerate(groups):
        for s in range(PER_GROUP):
            j = g * PER_GROUP + s
            if kind == "normal":
                v = f"({a!r} + {b!r} * sqrt(-2.0 * ln({u(j, 'a')})) * cos({2 * math.pi!r} * {u(j, 'b')}))"
            else:
                v = f"({a!r} + {b - a!r} * {u(j, 'a')})"
            parts.append(f"SELECT {key} AS row_id, {j} AS feature_id, {v} AS value FROM {table}")
    return " UNION ALL ".join(parts)
