"""Comparison of two keyed tables within tolerances."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Tolerances for equal results of different summation orders.
ABSOLUTE, RELATIVE = 1e-12, 1e-10


def differences(left: DataFrame, right: DataFrame, keys: list[str], absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """(keys, column, left, right): values that differ, and ``<row>`` for keys that one side lacks.

    Doubles may differ by ``absolute`` plus ``relative`` times the right one; all else must
    be equal, null with null and NaN with NaN.  Keys must be unique on both sides.
    """
    values = [c for c in left.columns if c not in keys]
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("the tables have different columns")
    kinds = dict(left.dtypes)
    a = left.select(*keys, F.struct(*values, F.lit(True).alias("__there")).alias("__a"))
    b = right.select(*keys, F.struct(*values, F.lit(True).alias("__there")).alias("__b"))
    both = a.join(b, keys, "full_outer")
    found = [F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.struct(F.lit("<row>").alias("column"), F.col("__a").isNotNull().cast("string").alias("left"), F.col("__b").isNotNull().cast("string").alias("right")))]
    for c in values:
        x, y = F.col("__a")[c], F.col("__b")[c]
        same = x.eqNullSafe(y)
        if kinds[c] in ("double", "float"):
            same |= F.coalesce(F.abs(x - y) <= F.lit(absolute) + F.lit(relative) * F.abs(y), F.lit(False))
        found.append(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~same, F.struct(F.lit(c).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"))))
    rows = both.select(*keys, F.explode(F.filter(F.array(*found), lambda d: d.isNotNull())).alias("d"))
    return rows.select(*keys, "d.column", "d.left", "d.right")
