"""Preparation: sparse counts and annotations to normalised units, published as one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.config import PrepareConfig
from popnet.operators import prepare as ops
from popnet.operators.checks import InputError, missing_from
from popnet.operators.quantiles import exact_quantiles
from popnet.sinks import absolute, published, unit_directory, wide_lines, write_json, write_lines, write_text
from popnet.sources import counts as count_sources, text
from popnet.storage import exists, written


@dataclass(frozen=True)
class PrepareResult:
    """What a preparation published."""

    output_dir: str
    manifest_path: str
    prepared_analysis_units: tuple[str, ...]
    excluded_analysis_units: tuple[str, ...]
    analysis_unit_directories: tuple[str, ...]
    input_cells: int
    annotated_cells: int
    excluded_unannotated_cells: int


@dataclass(frozen=True)
class Units:
    """The relational result, before any text is written."""

    entries: DataFrame  # analysis_unit, cluster, cell, gene, x (normalised)
    cells: DataFrame  # analysis_unit, cluster, cell, barcode_idx
    genes: DataFrame  # analysis_unit, gene, gene_ord
    tfs: DataFrame  # analysis_unit, gene, ord
    eligibility: DataFrame
    libraries: DataFrame


def units(matrix: count_sources.CountMatrix, annotations: DataFrame, tfs: DataFrame, config: PrepareConfig) -> Units:
    """Normalise all annotated cells, then split and filter by unit."""
    genes, entries = ops.collapse_genes(matrix.counts, matrix.features, config.gene_identifier, config.duplicate_gene_policy)
    policy = config.uncounted_cells
    cells = written(ops.annotated(matrix.barcodes, annotations, policy).select("analysis_unit", "cluster", "cell", "barcode_idx"), "unit-cells")  # read for every unit, as are genes and factors
    placed = written(entries.join(cells, "barcode_idx").select("analysis_unit", "cluster", "cell", "gene", "x"), "entries")
    libraries = ops.library_sizes(placed)
    counted = ops.counted(cells, libraries, policy)
    cells = cells if counted is cells else written(counted, "counted-cells")
    kept = written(ops.unit_genes(placed, config.min_gene_cells).join(genes, "gene"), "unit-genes")
    listed = written(kept.join(tfs, "gene").select("analysis_unit", "gene", "ord"), "unit-tfs")
    eligibility = ops.unit_eligibility(annotations, kept, tfs, config.min_cells)
    return Units(ops.normalised(placed, config.target_sum), cells, kept, listed, eligibility, libraries)


def _matrix(spark: SparkSession, path: str) -> count_sources.CountMatrix:
    if path.endswith((".h5", ".hdf5")):
        return count_sources.from_hdf5(spark, path)
    if exists(spark, f"{path}/counts"):
        return count_sources.from_parquet(spark, path)
    return count_sources.from_mex(spark, path, ".gz" if exists(spark, f"{path}/matrix.mtx.gz") else "")


def prepare(spark: SparkSession, config: PrepareConfig) -> PrepareResult:
    """Run a preparation; the output folder appears whole or not at all."""
    with published(spark, config.output_dir) as out:
        annotations = text.read_annotations(spark, config.annotations).cache()
        weights = text.read_centroid_weights(spark, config.centroid_weights) if config.centroid_weights else None
        if weights is not None:
            text.require_coverage(annotations, weights, "centroid weights")
        tfs = text.read_list(spark, config.tf_list, "list of transcription factors")
        matrix = _matrix(spark, config.counts).checked()
        found = units(matrix, annotations, tfs, config)
        eligible = found.eligibility.orderBy("analysis_unit").collect()  # one row per unit
        ops.require_units(found.eligibility)
        entries = written(found.entries, "normalised")
        records, directories, kept, excluded = [], [], [], []
        for number, unit in enumerate(eligible, 1):
            name, record = unit["analysis_unit"], unit.asDict()
            records.append(record)
            if unit["exclusion_reason"]:
                excluded.append(name)
                continue
            directory = unit_directory(number, name)
            record["directory"] = directory
            write_unit(f"{out}/{directory}", found, entries, name, weights)
            directories.append(directory)
            kept.append(name)
        input_cells, n_annotations = matrix.barcodes.count(), annotations.count()
        annotated_cells = matrix.barcodes.join(annotations, "cell", "left_semi").count()
        ends = found.libraries.agg(F.min("library"), F.max("library")).first()
        missing = [r[0] for r in missing_from(tfs, matrix.features.select(F.col(config.gene_identifier).alias("gene")), "gene").orderBy("ord").select("gene").collect()]
        manifest = {
            "schema_version": 1, "parameters": {k: v for k, v in config.to_dict().items() if k not in ("counts", "annotations", "tf_list", "output_dir", "centroid_weights")},
            "matrix": {
                "input_features": matrix.features.count(), "input_cells": input_cells, "gene_expression_features": ops.gene_expression(matrix.features).count(),
                "annotated_cells": annotated_cells, "excluded_unannotated_cells": input_cells - annotated_cells, "excluded_uncounted_cells": n_annotations - found.cells.count(),
                "library_size_before_normalization": {"minimum": ends[0], "median": exact_quantiles(found.libraries, [], "library", {"m": 0.5}).first()[0], "maximum": ends[1]},
            },
            "transcription_factors": {"supplied": tfs.count(), "absent": missing}, "summary": {"prepared_analysis_units": len(kept), "excluded_analysis_units": len(excluded)},
            "analysis_units": records, "inputs": {k: text.fingerprint(spark, getattr(config, k))["sha256"] for k in ("annotations", "tf_list")},
        }
        write_json(spark, manifest, f"{out}/prepare_manifest.json")
    final = absolute(config.output_dir)
    return PrepareResult(
        final, f"{final}/prepare_manifest.json", tuple(kept), tuple(excluded), tuple(f"{final}/{d}" for d in directories), input_cells, annotated_cells, input_cells - annotated_cells
    )


def write_unit(path: str, found: Units, entries: DataFrame, unit: str, weights: DataFrame | None) -> None:
    """The inference inputs of one unit; a gene's dense row exists only while it is written."""
    mine = lambda df: df.where(F.col("analysis_unit") == unit)
    cells = mine(found.cells).orderBy("barcode_idx").collect()  # the names of one unit's cells, which its header holds as well
    if not cells:
        raise InputError(f"Unit {unit!r} has no cells")
    spark = entries.sparkSession
    order = spark.createDataFrame([(r["cell"], i) for i, r in enumerate(cells)], "cell string, cell_ord int")
    genes = mine(found.genes).select("gene", "gene_ord")
    write_lines(wide_lines(mine(entries), genes, order, len(cells)), f"{path}/expression.tsv", "\t".join(["gene", *[r["cell"] for r in cells]]))
    groups = mine(found.cells).select("cell", "cluster", "barcode_idx")
    write_text(groups, f"{path}/groups.tsv", ["cell", "cluster"], ["barcode_idx"])
    write_lines(mine(found.tfs).repartitionByRange("ord").sortWithinPartitions("ord").select(F.col("gene").alias("value")), f"{path}/tf_list.txt")
    if weights is not None:
        write_text(groups.join(weights, "cell"), f"{path}/centroid_weights.tsv", ["cell", "centroid_weight"], ["barcode_idx"])
