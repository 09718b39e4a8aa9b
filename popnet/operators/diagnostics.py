"""Audits of weights: mass by source group, effective sample size, warnings, quartiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from popnet.functions.columns import EPSILON
from popnet.operators.quantiles import exact_quantiles
from popnet.operators.weighting import ess


def weight_mass(weights: DataFrame) -> DataFrame:
    """(target_group, source_group, source_is_target, source_weight, source_mass_percent)."""
    mass = weights.groupBy("target_group", F.col("cell_group").alias("source_group")).agg(F.sum("final_weight").alias("source_weight"))
    total = mass.groupBy("target_group").agg(F.sum("source_weight").alias("total"))
    rows = mass.join(total, "target_group")
    percent = F.when(F.col("total") > 0, F.col("source_weight") / F.col("total") * 100.0)
    return rows.select("target_group", "source_group", (F.col("target_group") == F.col("source_group")).alias("source_is_target"), "source_weight", percent.alias("source_mass_percent"))


def weight_summary(weights: DataFrame, quantiles: bool = True) -> DataFrame:
    """One row per target group: counts, totals, target and external mass, extremes, mean, median, effective sample size, canonicalisation."""
    own = F.col("cell_group") == F.col("target_group")
    w = F.col("final_weight")
    audit = (w == 0) & (F.col("raw_weight") > 0)
    rows = weights.groupBy("target_group").agg(
        F.count("*").alias("n_cells"), F.count_if(own).alias("n_target_cells"), F.sum(w).alias("total_weight"),
        F.coalesce(F.sum(F.when(own, w)), F.lit(0.0)).alias("target_weight"), F.coalesce(F.sum(F.when(~own, w)), F.lit(0.0)).alias("external_weight"),
        F.min(w).alias("min_weight"), F.max(w).alias("max_weight"), F.avg(w).alias("mean_weight"), F.max("raw_weight_sum").alias("raw_weight_sum"),
        F.count_if(F.col("raw_weight") > 0).alias("raw_positive_cell_count"), F.count_if(w > 0).alias("positive_cell_count"),
        F.count_if(audit).alias("canonicalized_cell_count"), F.coalesce(F.sum(F.when(audit, F.col("raw_weight"))), F.lit(0.0)).alias("canonicalized_weight_mass"),
        (F.lit(EPSILON) * F.max("raw_weight_sum")).alias("canonicalization_threshold"), ess(F.sum(w), F.sum(w * w)).alias("effective_sample_size"),
    )
    percent = lambda c: F.when(F.col("total_weight") > 0, F.col(c) / F.col("total_weight") * 100.0)
    rows = rows.withColumn("target_mass_percent", percent("target_weight")).withColumn("external_mass_percent", percent("external_weight"))
    return rows.join(exact_quantiles(weights, ["target_group"], "final_weight", {"median_weight": 0.5}), "target_group") if quantiles else rows


def dominant(mass: DataFrame, fraction: float = 0.5) -> DataFrame:
    """The rows of ``weight_mass`` of external groups with more than this fraction of a target group's mass."""
    return mass.where(~F.col("source_is_target") & (F.col("source_mass_percent") > 100.0 * fraction))


def warning_flags(summary: DataFrame, mass: DataFrame, low_ess_fraction: float = 0.1, dominant_external_fraction: float = 0.5) -> DataFrame:
    """(target_group, degenerate, low_ess, external_exceeds_target, dominant_groups): the conditions of the warnings."""
    if not 0 <= low_ess_fraction <= 1 or not 0 < dominant_external_fraction <= 1:
        raise ValueError("fractions must lie between zero and one")
    some = dominant(mass, dominant_external_fraction)
    some = some.groupBy("target_group").agg(F.array_sort(F.collect_list("source_group")).alias("dominant_groups"))  # at most 1 / fraction groups
    degenerate = (F.col("total_weight") <= 0) | (F.col("positive_cell_count") == 0)
    low: Column = F.col("effective_sample_size") < F.greatest(F.lit(2.0), F.lit(low_ess_fraction) * F.col("n_cells"))
    rows = summary.select("target_group", degenerate.alias("degenerate"), (~degenerate & low).alias("low_ess"), (F.col("external_weight") > F.col("target_weight")).alias("external_exceeds_target"))
    return rows.join(some, "target_group", "left").withColumn("dominant_groups", F.coalesce("dominant_groups", F.array().cast("array<string>")))


def weight_quartiles(weights: DataFrame) -> DataFrame:
    """(target_group, source_group, n, q25, median, q75, min, max, mean, positive): linear interpolation."""
    keys = ["target_group", "cell_group"]
    rows = weights.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("final_weight").alias("min"), F.max("final_weight").alias("max"), F.avg("final_weight").alias("mean"), F.count_if(F.col("final_weight") > 0).alias("positive")
    )
    at = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return rows.join(exact_quantiles(weights, keys, "final_weight", at), keys).withColumnRenamed("cell_group", "source_group")


def messages(flags: dict, summary: dict, mass: dict[str, float]) -> list[str]:
    """The warnings of one target group, as text; formatted on the driver."""
    out = []
    if flags["degenerate"]:
        out.append("Weights are degenerate: no positive finite total mass")
    if flags["low_ess"]:
        out.append(f"Effective sample size is very low ({summary['effective_sample_size']:.3g} of {summary['n_cells']} cells)")
    if flags["external_exceeds_target"]:
        out.append("External groups contribute more total weight than the target group")
    out += [f"External group {g!r} contributes an excessive {mass[g] / 100:.1%} of total weight" for g in flags["dominant_groups"]]
    return out
