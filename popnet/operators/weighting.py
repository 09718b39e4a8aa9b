"""Distances to audited observation weights.

Per (target group, cell): kernel of a distance, group-size factor, mode, canonicalisation.
Totals and maxima of a target group are grouped aggregates (combined before their shuffle)
joined back as one row per group, never a window over all cells of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from popnet.functions.columns import EPSILON, kernel, size_factor
from popnet.operators.checks import InputError
from popnet.operators.quantiles import exact_quantiles

MODES = ("cell-distance", "cell-distance-group-anchored", "group-distance")
RULE = "relative-precision"


class DegenerateWeightsError(InputError):
    """A target group has no positive weight."""


def group_sizes(cells: DataFrame) -> DataFrame:
    """(grp, n)."""
    return cells.groupBy("grp").agg(F.count("*").alias("n"))


def bandwidth(distances: DataFrame, explicit: float | str = "auto", scale: float = 1.0, fallback: float = 1.0) -> DataFrame:
    """One row (bandwidth, positive_count): the exact median of the positive distances times ``scale``; ``fallback`` times it with none."""
    positive = distances.where("distance > 0")
    count = positive.agg(F.count("*").alias("positive_count"))
    if explicit != "auto":
        if scale != 1.0:
            raise ValueError("bandwidth_scale applies only to an automatic bandwidth")
        return count.select(F.lit(float(explicit)).alias("bandwidth"), "positive_count")
    median = exact_quantiles(positive, [], "distance", {"median": 0.5})
    return median.crossJoin(count).select((F.coalesce("median", F.lit(float(fallback))) * F.lit(float(scale))).alias("bandwidth"), "positive_count")


def affinities(group_distance: DataFrame, sizes: DataFrame, h: DataFrame, kernel_name: str = "gaussian", correction: str = "cap-to-target") -> DataFrame:
    """(target_group, source_group, distance, base_affinity, group_size_factor): groups x groups rows."""
    nt, ns = sizes.select(F.col("grp").alias("target_group"), F.col("n").alias("nt")), sizes.select(F.col("grp").alias("source_group"), F.col("n").alias("ns"))
    rows = group_distance.join(nt, "target_group").join(ns, "source_group").crossJoin(h.select("bandwidth"))
    same = F.col("target_group") == F.col("source_group")
    return rows.select(
        "target_group", "source_group", "distance", F.when(same, F.lit(1.0)).otherwise(kernel(kernel_name, F.col("distance"), F.col("bandwidth"))).alias("base_affinity"),
        size_factor(correction, F.col("nt"), F.col("ns"), same).alias("group_size_factor"),
    )


def canonical(weights: DataFrame, raw: str = "raw_weight") -> DataFrame:
    """Adds final_weight: positive weights of at most EPSILON times the target group's total become zero (no renormalisation)."""
    total = weights.groupBy("target_group").agg(F.sum(raw).alias("raw_weight_sum"))
    rows = weights.join(total, "target_group")
    w = F.col(raw)
    return rows.withColumn("final_weight", F.when((w > 0) & (w <= F.lit(EPSILON) * F.col("raw_weight_sum")), 0.0).otherwise(w))


def weights(
    cells: DataFrame, sizes: DataFrame, h: DataFrame, mode: str = "cell-distance-group-anchored", kernel_name: str = "gaussian",
    correction: str = "cap-to-target", cell_distance: DataFrame | None = None, group_distance: DataFrame | None = None,
) -> DataFrame:
    """(target_group, cell, cell_group, distance, base_weight, group_size_factor, raw_weight, raw_weight_sum, final_weight, canonicalized_for_fitting).

    ``cells`` has (cell, grp); ``cell_distance`` is needed by the two cell modes,
    ``group_distance`` by the third.  ``sizes``, ``h`` and group distances are small tables.
    """
    if mode not in MODES:
        raise ValueError(f"unknown weight mode {mode!r}")
    if mode == "group-distance":
        near = group_distance.select("target_group", F.col("source_group").alias("grp"), "distance")
        rows = cells.select("cell", "grp").join(near, "grp")
    else:
        rows = cell_distance.select("cell", "grp", "target_group", "distance")
    nt, ns = sizes.select(F.col("grp").alias("target_group"), F.col("n").alias("nt")), sizes.withColumnRenamed("n", "ns")
    rows = rows.join(nt, "target_group").join(ns, "grp").crossJoin(h.select("bandwidth"))
    same = F.col("grp") == F.col("target_group")
    base = kernel(kernel_name, F.col("distance"), F.col("bandwidth"))
    if mode != "cell-distance":
        base = F.when(same, F.lit(1.0)).otherwise(base)
    rows = rows.select(
        "target_group", "cell", F.col("grp").alias("cell_group"), "distance", base.alias("base_weight"),
        size_factor(correction, F.col("nt"), F.col("ns"), same).alias("group_size_factor"),
    )
    product = F.col("base_weight") * F.col("group_size_factor")
    if mode == "cell-distance":
        tops = rows.groupBy("target_group").agg(F.max(product).alias("top"))
        rows = rows.join(tops, "target_group")
        # the largest become exactly one, whatever rounding does
        product = F.when(F.col("top") <= 0, F.lit(0.0)).when(product == F.col("top"), F.lit(1.0)).otherwise(product * (F.lit(1.0) / F.col("top")))
    rows = canonical(rows.withColumn("raw_weight", product))
    audit = (F.col("final_weight") == 0) & (F.col("base_weight") > 0) & (F.col("group_size_factor") > 0)
    return rows.select(
        "target_group", "cell", "cell_group", "distance", "base_weight", "group_size_factor", "raw_weight", "raw_weight_sum", "final_weight",
        audit.alias("canonicalized_for_fitting"),
    )


def require_positive(found: DataFrame) -> None:
    """Raise DegenerateWeightsError for target groups without positive weight."""
    bad = [r[0] for r in found.groupBy("target_group").agg(F.max("final_weight").alias("top")).where("top <= 0").select("target_group").limit(9).collect()]
    if bad:
        raise DegenerateWeightsError(f"No positive weight for target groups {bad}")


def normalised_centroid_weights(rows: DataFrame, weight: str = "centroid_weight") -> DataFrame:
    """``rows`` (with grp) and normalized_centroid_weight: (w / max) over the group's sum of it."""
    tops = rows.groupBy("grp").agg(F.max(weight).alias("wmax"))
    scaled = rows.join(tops, "grp").withColumn("scaled", F.col(weight) / F.col("wmax"))
    sums = scaled.groupBy("grp").agg(F.sum("scaled").alias("total"))
    return scaled.join(sums, "grp").withColumn("normalized_centroid_weight", F.col("scaled") / F.col("total")).drop("wmax", "scaled", "total")


def ess(total: Column, squares: Column) -> Column:
    """(sum w)^2 / sum w^2; 0 without positive weight."""
    return F.when(squares > 0, total * total / squares).otherwise(F.lit(0.0))


def centroid_weight_diagnostics(rows: DataFrame, weight: str = "centroid_weight") -> DataFrame:
    """(grp, n_cells, weight_sum, min_weight, median_weight, max_weight, effective_sample_size)."""
    tops = rows.groupBy("grp").agg(F.max(weight).alias("wmax"))
    s = F.col(weight) / F.col("wmax")
    sums = rows.join(tops, "grp").groupBy("grp").agg(
        F.count("*").alias("n_cells"), F.sum(weight).alias("weight_sum"), F.min(weight).alias("min_weight"), F.max(weight).alias("max_weight"),
        ess(F.sum(s), F.sum(s * s)).alias("effective_sample_size"),
    )
    return sums.join(exact_quantiles(rows, ["grp"], weight, {"median_weight": 0.5}), "grp")
