"""Which models can be fitted, and with which predictors: aggregates over weighted cells.

``expression`` is (gene, cell, x); ``positive`` is (target_group, cell) with positive weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Statuses in the order in which they are tested.
INSUFFICIENT, CONSTANT, ONLY_SELF, NO_VARIABLE = (
    "insufficient_positive_weight_samples", "constant_target", "no_predictors_after_self_exclusion", "no_variable_predictors",
)


def positive_cells(weights: DataFrame) -> DataFrame:
    """(target_group, cell) with positive final weight."""
    return weights.where("final_weight > 0").select("target_group", "cell")


def ranges(expression: DataFrame, positive: DataFrame) -> DataFrame:
    """(target_group, gene, n, low, high, low32, high32) over cells of positive weight: extremes in double and in single precision."""
    rows = expression.join(positive, "cell")
    return rows.groupBy("target_group", "gene").agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.min(F.col("x").cast("float")).alias("low32"), F.max(F.col("x").cast("float")).alias("high32")
    )


def constant_predictors(spread: DataFrame, tfs: DataFrame) -> DataFrame:
    """(target_group, gene): transcription factors with one single-precision value among the positive cells."""
    return spread.where("low32 = high32").join(tfs.select("gene"), "gene", "left_semi").select("target_group", "gene")


def candidate_pairs(targets: DataFrame, tfs: DataFrame, constants: DataFrame) -> DataFrame:
    """(target_group, target, source): each target with each factor that is neither itself nor constant in the group.

    The factors of a group are listed once; a target expands into its own list only.
    """
    lists = targets.select("target_group").distinct().join(tfs.select(F.col("gene").alias("source")), how="cross")
    lists = lists.join(constants.withColumnRenamed("gene", "source"), ["target_group", "source"], "left_anti")
    return targets.join(lists, "target_group").where("target <> source").select("target_group", "target", "source")


def preflight(spread: DataFrame, targets: DataFrame, tfs: DataFrame, constants: DataFrame, sizes: DataFrame) -> DataFrame:
    """(target_group, target, n_positive, n_predictors, status): status is ``fit`` or the first reason to skip.

    ``sizes`` is (target_group, n_positive); ``targets`` (target_group, target).
    """
    n_tfs = tfs.agg(F.countDistinct("gene").alias("n_tfs"))
    own = tfs.select(F.col("gene").alias("target"), F.lit(1).alias("is_tf")).distinct()
    bad = constants.groupBy("target_group").agg(F.count("*").alias("n_constant"))
    own_bad = constants.select("target_group", F.col("gene").alias("target"), F.lit(1).alias("self_constant"))
    y = spread.select("target_group", F.col("gene").alias("target"), "low", "high")
    rows = (
        targets.join(sizes, "target_group", "left").join(y, ["target_group", "target"], "left").join(own, "target", "left")
        .join(own_bad, ["target_group", "target"], "left").join(bad, "target_group", "left").crossJoin(n_tfs)
        .fillna(0, ["n_positive", "is_tf", "self_constant", "n_constant"])
    )
    eligible = F.col("n_tfs") - F.col("is_tf")
    usable = F.col("n_tfs") - F.col("n_constant") - F.col("is_tf") * (1 - F.col("self_constant"))
    status = (
        F.when(F.col("n_positive") < 2, INSUFFICIENT).when(F.col("low") == F.col("high"), CONSTANT).when(eligible == 0, ONLY_SELF).when(usable == 0, NO_VARIABLE).otherwise("fit")
    )
    return rows.select("target_group", "target", F.col("n_positive").cast("long").alias("n_positive"), usable.cast("long").alias("n_predictors"), status.alias("status"))
