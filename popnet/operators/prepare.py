"""Preparation of sparse counts: canonical entries, collapsed genes, normalisation, units.

Counts are coordinates (feature_idx, barcode_idx, x) with ``features`` (feature_idx, name,
id, feature_type) and ``barcodes`` (barcode_idx, barcode).  Zeros stay absent until a sink
needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from popnet.functions.columns import library_log1p
from popnet.operators.checks import InputError, duplicate_keys, missing_from, require_none

GENE_EXPRESSION = "Gene Expression"


def canonical(counts: DataFrame, row: str = "feature_idx", col: str = "barcode_idx") -> DataFrame:
    """Repeated coordinates summed in double precision; zeros dropped."""
    return counts.groupBy(row, col).agg(F.sum(F.col("x").cast("double")).alias("x")).where("x <> 0")


def invalid_counts(counts: DataFrame) -> DataFrame:
    """Entries that are null, not finite or negative."""
    x = F.col("x").cast("double")
    return counts.where(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0))


def gene_expression(features: DataFrame) -> DataFrame:
    """The features that are genes."""
    return features.where(F.col("feature_type") == GENE_EXPRESSION)


def collapse_genes(counts: DataFrame, features: DataFrame, identifier: str = "name", policy: str = "sum") -> tuple[DataFrame, DataFrame]:
    """(genes, entries): genes (gene, gene_ord) in first-seen order, and entries (gene, barcode_idx, x) with repeated genes summed.

    Coordinates of ``counts`` may repeat: they are summed in the same pass, so a task holds one
    table of sums, where ``canonical`` before it makes a task hold two.
    ``policy`` ``error`` raises on repeated identifiers.
    """
    if policy not in ("sum", "error"):
        raise ValueError(f"unknown duplicate gene policy {policy!r}")
    named = gene_expression(features).select("feature_idx", F.col(identifier).alias("gene"))
    if policy == "error":
        require_none(duplicate_keys(named, "gene"), "gene", "Duplicate gene identifiers")
    genes = named.groupBy("gene").agg(F.min("feature_idx").alias("gene_ord"))
    entries = counts.join(named, "feature_idx").groupBy("gene", "barcode_idx").agg(F.sum(F.col("x").cast("double")).alias("x")).where("x <> 0")
    return genes, entries


def library_sizes(entries: DataFrame, cell: str = "cell") -> DataFrame:
    """(cell, library): the sum of all gene counts of a cell, before any gene is left out."""
    return entries.groupBy(cell).agg(F.sum("x").alias("library"))


def normalised(entries: DataFrame, target_sum: float = 10_000.0, cell: str = "cell") -> DataFrame:
    """``entries`` with x as log(1 + x * target_sum / library).

    The sizes are grouped before the join, so a cell's entries are combined before the
    shuffle and its partitioning serves both.
    """
    sizes = library_sizes(entries, cell)
    return entries.join(sizes, cell).withColumn("x", library_log1p(F.col("x"), F.col("library"), target_sum)).drop("library")


def empty_libraries(cells: DataFrame, sizes: DataFrame, cell: str = "cell") -> DataFrame:
    """Cells without any count."""
    return cells.join(sizes.where("library > 0"), cell, "left_anti")


def unit_gene_detection(entries: DataFrame) -> DataFrame:
    """(analysis_unit, gene, n_cells): cells of the unit in which the gene is not zero."""
    return entries.groupBy("analysis_unit", "gene").agg(F.count_if(F.col("x") != 0).alias("n_cells"))


def unit_genes(entries: DataFrame, min_gene_cells: int = 1) -> DataFrame:
    """(analysis_unit, gene) detected in enough cells."""
    return unit_gene_detection(entries).where(F.col("n_cells") >= min_gene_cells).select("analysis_unit", "gene")


def unit_tfs(genes: DataFrame, tfs: DataFrame) -> DataFrame:
    """(analysis_unit, gene): retained genes that are transcription factors; the list is small and its size is planned by statistics."""
    return genes.join(tfs.select("gene"), "gene", "left_semi").select("analysis_unit", "gene")


def unit_sizes(annotations: DataFrame) -> DataFrame:
    """(analysis_unit, n_cells, n_clusters)."""
    return annotations.groupBy("analysis_unit").agg(F.count("*").alias("n_cells"), F.countDistinct("cluster").alias("n_clusters"))


def unit_group_sizes(annotations: DataFrame) -> DataFrame:
    """(analysis_unit, cluster, n_cells)."""
    return annotations.groupBy("analysis_unit", "cluster").agg(F.count("*").alias("n_cells"))


def unit_eligibility(annotations: DataFrame, genes: DataFrame, tfs: DataFrame, min_cells: int = 300) -> DataFrame:
    """(analysis_unit, n_cells, n_genes, n_tfs, exclusion_reason): the reason is null for a unit that is prepared."""
    sizes = unit_sizes(annotations).select("analysis_unit", "n_cells")
    kept = genes.groupBy("analysis_unit").agg(F.count("*").alias("n_genes"))
    factors = unit_tfs(genes, tfs).groupBy("analysis_unit").agg(F.count("*").alias("n_tfs"))
    all_ = sizes.join(kept, "analysis_unit", "left").join(factors, "analysis_unit", "left").fillna(0, ["n_genes", "n_tfs"])
    reason = (
        F.when(F.col("n_cells") < min_cells, "below-min-cells")
        .when(F.col("n_genes") == 0, "no-genes-after-filtering")
        .when(F.col("n_tfs") == 0, "no-transcription-factors-after-filtering")
    )
    return all_.withColumn("exclusion_reason", reason)


def annotated(barcodes: DataFrame, annotations: DataFrame, uncounted: str = "error") -> DataFrame:
    """Barcodes with an annotation; annotations without a barcode are an error, or (``exclude``) left out."""
    if uncounted == "error":
        require_none(missing_from(annotations, barcodes, "cell"), "cell", "Annotated cells are not in the matrix")
    return barcodes.join(annotations, "cell")


def counted(cells: DataFrame, sizes: DataFrame, uncounted: str = "error", cell: str = "cell") -> DataFrame:
    """``cells`` with a count; others are an error, or (``exclude``) left out."""
    if uncounted == "error":
        require_none(empty_libraries(cells.select(cell), sizes, cell), cell, "Annotated cells without counts")
        return cells
    return cells.join(sizes.where("library > 0").select(cell), cell, "left_semi")


def require_units(eligibility: DataFrame) -> None:
    """Raise if no unit is left, with the tally of the reasons."""
    tally = eligibility.groupBy("exclusion_reason").agg(F.count("*").alias("n")).orderBy("exclusion_reason").collect()
    if not any(r["exclusion_reason"] is None for r in tally):
        raise InputError("No analysis unit is eligible; " + ", ".join(f"{r['exclusion_reason']}={r['n']}" for r in tally))
