"""Exact quantiles without one task or one hash map for all values.

Equal values are counted first (combined before the shuffle), the distinct ones are range
partitioned by (keys, value), and the counts of the partitions before give every value its
rank.  Memory is bounded by a partition, whatever a group's share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from popnet.storage import written


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], times: str | None = None) -> DataFrame:
    """Per ``keys`` one column for each name in ``at``: the linearly interpolated quantile of ``value`` (nulls left out).

    A row counts as often as its whole number ``times`` says, which must be above zero, or once.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg((F.sum(times) if times else F.count("*")).alias("n"))
    order = [*keys, "value"]
    # the partition's number must be the same wherever it is read: the table is written with it
    ranged = counted.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    heads = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("rows"))
    upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
    totals = heads.groupBy(*keys).agg(F.sum("rows").alias("total")) if keys else heads.agg(F.sum("rows").alias("total"))
    inside = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("last", F.sum("n").over(inside)).join(heads.select(*keys, "part", "before"), [*keys, "part"])
    placed = placed.join(totals, keys) if keys else placed.crossJoin(totals)
    placed = placed.withColumn("last", F.col("last") + F.col("before")).withColumn("first", F.col("last") - F.col("n"))
    out = []
    for name, q in at.items():
        place = F.lit(float(q)) * (F.col("total") - 1)
        low, share = F.floor(place), place - F.floor(place)
        holds = lambda k: (F.col("first") <= k) & (F.col("last") > k)
        a = F.max(F.when(holds(low), F.col("value")))
        b = F.max(F.when(holds(F.least(low + 1, F.col("total") - 1)), F.col("value")))
        out.append((a + (b - a) * F.max(share)).alias(name))
    return placed.groupBy(*keys).agg(*out) if keys else placed.agg(*out)
