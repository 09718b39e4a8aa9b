"""Deterministic stratified samples of cells for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from popnet.functions.columns import name_hash


def sample_size(n_cells: int, n_groups: int) -> int:
    """Cells that a report shows: every group at least once, and a bounded number of (cell, group) values."""
    bound = max(n_groups, 300_000 // n_groups)
    return max(n_groups, min(n_cells, max(30_000, n_groups), bound))


def allocation(sizes: DataFrame, budget: int) -> DataFrame:
    """(grp, n, allocated): one per group, the rest by largest remainders of the sizes less one, ties by group; ``sizes`` is (grp, n)."""
    totals = sizes.agg(F.sum("n").alias("cells"), F.count("*").alias("groups"))
    rows = sizes.crossJoin(totals)
    spare = F.greatest(F.lit(0), F.lit(budget) - F.col("groups"))
    room, weight = F.col("cells") - F.col("groups"), F.col("n") - 1
    quota = F.when(room == 0, F.lit(0.0)).otherwise(F.least(spare, room).cast("double") * weight / room)
    rows = rows.withColumn("whole", F.floor(quota)).withColumn("rest", quota - F.floor(quota))
    left = rows.agg((F.first(F.least(spare, room)) - F.sum("whole")).alias("left"))
    w = Window.orderBy(F.desc("rest"), "grp")  # one row per group
    rows = rows.withColumn("at", F.row_number().over(w)).crossJoin(left)
    return rows.select("grp", "n", (1 + F.col("whole") + F.when(F.col("at") <= F.col("left"), 1).otherwise(0)).cast("long").alias("allocated"))


def stratified(cells: DataFrame, alloc: DataFrame) -> DataFrame:
    """The ``allocated`` cells of each group with the smallest name hashes (ties by name).

    The rank is limited per task before the shuffle, so a large group sends its smallest only.
    """
    w = Window.partitionBy("grp").orderBy("hash", "cell")
    most = alloc.agg(F.max("allocated")).first()[0] or 0
    ranked = cells.withColumn("hash", name_hash(F.col("cell"))).withColumn("at", F.row_number().over(w)).where(F.col("at") <= int(most))
    return ranked.join(alloc.select("grp", "allocated"), "grp").where("at <= allocated").drop("at", "allocated")
