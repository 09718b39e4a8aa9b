"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each step is a
grouped minimum (combined before its shuffle) and an equi-join whose large partitions
adaptive execution may split, so one hub with very many neighbours stays no single task.
Every step's edges are written to the shared folder: nothing is gathered on the driver
but two sums that tell whether the edges still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from popnet.llm.shared import released, written


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("u"), F.col(b).alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, "u", "v").unionByName(_pairs(edges, "v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(_pairs(least, "u", "m")).where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (u long, v long, u <> v).

    ``component`` is the smallest node reachable.  Nodes without an edge don't appear.
    An empty table gives an empty table.  Rows repeated or reversed change nothing.
    Raises RuntimeError when ``max_rounds`` double steps have not settled it (the number
    needed grows with the logarithm of the longest path).
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        before, now = now, written(_small_star(_large_star(now)), "star")
        released(before)
        fresh = _digest(now)
        if fresh == seen:
            break
        seen = fresh
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
