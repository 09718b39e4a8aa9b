"""Synthetic expression with planted regulation, made in parallel from hashes of its coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on its parts alone."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _normal(*parts: Column) -> Column:
    """A standard normal number, by the Box-Muller transform."""
    return F.sqrt(F.lit(-2.0) * F.ln(_uniform(F.lit(1), *parts))) * F.cos(F.lit(6.283185307179586) * _uniform(F.lit(2), *parts))


def expression(spark: SparkSession, n_cells: int, n_genes: int, n_tfs: int, n_groups: int, seed: int = 1) -> DataFrame:
    """(gene, cell, grp, x): factors vary around their group's mean; other genes mix up to four factors with an offset of their group.

    Factors are ``TF0``, ``TF1``, ...; the other genes ``G0``, ``G1``, ...
    """
    s = F.lit(seed)
    cells = spark.range(n_cells).select(F.col("id").alias("c"), F.concat(F.lit("population_"), F.pmod(F.xxhash64(s, "id"), F.lit(n_groups)).cast("string")).alias("grp"))
    level = lambda tf: F.greatest(F.lit(0.0), 0.4 + 2.0 * _uniform(s, F.lit("mean"), F.col("grp"), tf) + 0.15 * _normal(s, F.lit("tf"), F.col("c"), tf))
    factors = cells.crossJoin(F.broadcast(spark.range(n_tfs).withColumnRenamed("id", "t"))).select(F.concat(F.lit("TF"), "t").alias("gene"), "c", "grp", level(F.col("t")).alias("x"))
    rest = cells.crossJoin(F.broadcast(spark.range(n_genes - n_tfs).withColumnRenamed("id", "g")))
    picks = [F.pmod(F.xxhash64(s, F.lit("pick"), F.col("g"), F.lit(i)), F.lit(n_tfs)) for i in range(4)]
    shares = [_uniform(s, F.lit("share"), F.col("g"), F.lit(i)) for i in range(4)]
    mixed = sum((w * level(t) for w, t in zip(shares[1:], picks[1:], strict=True)), shares[0] * level(picks[0])) / sum(shares[1:], shares[0])
    value = F.greatest(F.lit(0.0), mixed + 0.6 * _uniform(s, F.lit("offset"), F.col("grp"), F.col("g")) + 0.08 * _normal(s, F.lit("noise"), F.col("c"), F.col("g")))
    genes = rest.select(F.concat(F.lit("G"), "g").alias("gene"), "c", "grp", value.alias("x"))
    return factors.unionByName(genes).select("gene", F.concat(F.lit("cell_"), "c").alias("cell"), "grp", "x")
