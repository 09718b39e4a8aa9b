"""Numbers of rows in an order, inside groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from popnet.storage import written


def numbered(rows: DataFrame, order: list[str], group: list[str] | None = None, into: str = "pos", size: str | None = None) -> DataFrame:
    """``rows`` with their number from 0 by ``order`` in their group (null groups are groups), and with the group's size where ``size`` names it; an action.

    Rows are range partitioned by group and order and sorted inside partitions, so a hot group
    is many partitions.  A partition's rows are counted by group, and the counts of the
    partitions before it are the offset.  Rows that tie in ``order`` must be alike, or ``order``
    must tell them apart.
    """
    group = group or []
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftright("__at", 33))
    runs = ranged.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)  # a row for each partition that the group is in
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    runs = runs.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__of"), start.alias("__start"), F.sum("__n").over(whole).alias("__size"))
    same = F.col("__part") == F.col("__of")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = ranged.join(runs, same).withColumn(into, F.col("__at") + F.col("__start"))
    return (out.withColumn(size, F.col("__size")) if size else out).select(*rows.columns, into, *([size] if size else []))
