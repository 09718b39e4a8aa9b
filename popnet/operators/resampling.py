"""Bootstrap intervals and nested subsets, from hashes alone: no copies are drawn, and reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from popnet.operators.ordering import numbered
from popnet.operators.quantiles import exact_quantiles

#: The most often that a row is drawn in a replicate: more has a probability under 1e-9.
MOST = 11
#: Hexadecimal digits of a hash that make a uniform number: exact in doubles.
HEX = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-256 of ``parts``, joined by colons."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, HEX), 16, 10).cast("double") / float(16**HEX)


def drawn(u: Column) -> Column:
    """How often a row is drawn, by the Poisson distribution of mean 1: the number of its cumulative probabilities that ``u`` reaches."""
    steps, total = [], 0.0
    for k in range(MOST):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(F.when(u >= total, 1).otherwise(0))
    return sum(steps[1:], steps[0])


def bootstrap(rows: DataFrame, keys: list[str], row: str, value: str, replicates: int = 1000, level: float = 0.95, quantile: float = 0.5, seed: int = 0) -> DataFrame:
    """(keys, estimate, low, high): a quantile of ``value`` and its percentile interval over Poisson replicates.

    ``row`` names each row.  In a replicate a row counts as often as a hash of (seed, row,
    replicate) says, so a replicate is a grouped aggregate of counts, combined before its
    shuffle; no copies of rows are made.  Replicates that draw no row of a group are left out.
    """
    if not 0 < level < 1 or replicates < 1:
        raise ValueError("the level must lie between zero and one, and there must be replicates")
    # a small file is one task's, but its rows times the replicates are not
    spread = rows.select(*keys, F.col(value).alias("x"), F.col(row).alias("row")).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    each = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    u = uniform(F.lit(seed), F.col("row"), F.col("replicate"))
    # rows that are drawn at all are told by the first step alone: a condition on the sum would be pushed down and hash a row once a step
    counted = each.where(u >= math.exp(-1.0)).withColumn("times", drawn(u))
    found = exact_quantiles(counted, [*keys, "replicate"], "x", {"q": quantile}, "times")
    tail = (1 - level) / 2
    interval = exact_quantiles(found, keys, "q", {"low": tail, "high": 1 - tail})
    plain = exact_quantiles(rows, keys, value, {"estimate": quantile})
    return plain.join(interval, keys, "left") if keys else plain.crossJoin(interval)


def nested(targets: DataFrame, name: str, sizes: list[int], seed: int = 0) -> DataFrame:
    """(size, name): for each size a subset of the names; a smaller one lies inside every larger one, whichever sizes are asked for together."""
    if any(s < 1 for s in sizes):
        raise ValueError("sizes must be positive")
    names = targets.select(F.col(name).alias("name")).distinct()
    ranked = numbered(names.withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col("name").cast("string")), 256)), ["h", "name"], into="at")
    return ranked.select(F.explode(F.lit(sorted(set(sizes)))).alias("size"), "name", "at").where("at < size").select("size", F.col("name").alias(name))
