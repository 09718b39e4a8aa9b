"""Inference: expression, factors and groups to weighted networks, published as one folder."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet import __version__, report
from popnet.config import InferConfig
from popnet.operators import diagnostics, distance, forest, weighting
from popnet.operators.checks import InputError, missing_from, require_none
from popnet.operators.representation import Representation, display, represent
from popnet.operators.trees import ForestParams
from popnet.sinks import CELL_WEIGHTS, SKIPPED, absolute, published, write_bytes, write_json, write_network, write_text
from popnet.sources import text
from popnet.sources.expression import Expression
from popnet.storage import shared_dir, written
from popnet.streaming.checkpoint import Checkpoint, identity, remaining
from popnet.streaming.groups import GroupResults

#: Models in a checkpointed batch, for each core of the cluster.
PER_CORE = 32
PHASES = ("load", "represent", "distances", "bandwidth", "weights", "models", "artifacts", "publish")
Progress = Callable[[str, dict], None]


@dataclass(frozen=True)
class RunResult:
    """What a run published."""

    output_dir: str
    status: str
    n_edges: int
    total_models: int
    trained_models: int
    skipped_targets: int
    failed_models: int
    resumed_models: int
    warnings: tuple[str, ...]


@dataclass(frozen=True)
class State:
    """Everything up to the weights, as DataFrames."""

    cells: DataFrame  # cell, grp, cell_ord, v
    expression: Expression
    sizes: DataFrame
    representation: Representation
    centroids: DataFrame
    group_distance: DataFrame
    cell_distance: DataFrame | None
    bandwidth: DataFrame
    weights: DataFrame
    tfs: list[str]
    targets: DataFrame
    n_cells: int


def params(config: InferConfig) -> ForestParams:
    """The ensemble's settings."""
    return ForestParams(
        config.tree_method, config.n_estimators, config.max_features, config.min_samples_leaf, config.max_depth, config.min_weight_fraction_leaf, config.bootstrap
    )


def _centred(c: InferConfig) -> bool:
    return c.distance_space == "pca" or c.distance_standardization == "standard"


#: What means nothing with one group, and what it needs instead.  Its cells all have one
#: centroid: weights that compare groups are all the same, and in a space centred on the cells'
#: mean that centroid is zero but for rounding, so that angles to it are noise.
ONE_GROUP: tuple[tuple[Callable[[InferConfig], bool], str], ...] = (
    (lambda c: c.weight_mode != "cell-distance", "the weight mode 'cell-distance'"),
    (lambda c: c.group_size_correction != "none", "no group size correction"),
    (lambda c: c.distance_metric == "cosine" and _centred(c), "the Euclidean distance in a centred space"),
)


def require_meaning(config: InferConfig, n_groups: int) -> None:
    """Refuse what means nothing with the number of groups."""
    needed = [text_ for broken, text_ in ONE_GROUP if n_groups == 1 and broken(config)]
    if needed:
        raise InputError(f"A single group needs {', '.join(needed)}")


def checkpoint_path(spark: SparkSession, final: str) -> str:
    """Where a run's checkpoint is: beside its folder in a local session, else in the folder that the cluster shares."""
    if spark.sparkContext.master.startswith("local") and final.startswith("/"):
        return f"file://{os.path.dirname(final)}/.{os.path.basename(final)}.checkpoint"
    return f"{shared_dir(spark)}/popnet-run-{hashlib.sha256(final.encode()).hexdigest()[:32]}.checkpoint"


def build(spark: SparkSession, config: InferConfig, progress: Progress = lambda phase, info: None) -> State:
    """Read, check and derive the weights."""
    progress("load", {})
    x, given = text.load_inputs(spark, config.expression, config.tf_list, config.groups, config.target_list, config.centroid_weights)
    return derive(spark, x, given, config, progress)


def derive(spark: SparkSession, x: Expression, given: dict[str, DataFrame], config: InferConfig, progress: Progress = lambda phase, info: None) -> State:
    """Everything up to the weights, from checked inputs."""
    cells = x.by_cell().join(given["groups"], "cell")
    if config.centroid_weights:
        cells = cells.join(given["centroid_weights"], "cell")
    cells = written(cells, "cells")
    sizes = written(weighting.group_sizes(cells), "sizes")
    n_groups = sizes.count()
    require_meaning(config, n_groups)
    progress("represent", {"groups": n_groups})
    rep = represent(cells.select("cell", "grp", "v"), config.distance_space, config.n_components, config.distance_standardization == "standard", config.random_seed, config.pca_svd_solver)
    space = written(rep.cells, "representation")
    rep = replace(rep, cells=space)
    progress("distances", {})
    weighted = space.join(cells.select("cell", "centroid_weight"), "cell") if config.centroid_weights else space
    means = written(distance.centroids(weighted, "centroid_weight" if config.centroid_weights else None), "centroids")
    if config.distance_metric == "cosine":
        require_none(distance.zero_norm_rows(space), "cell", "Cosine distance is not defined for all-zero cells")
        require_none(means.groupBy("grp").agg(F.max(F.abs("mu")).alias("top")).where("top = 0"), "grp", "Cosine distance is not defined for all-zero centroids")
    between = written(distance.group_distances(means, config.distance_metric), "group-distances")
    by_cell = None if config.weight_mode == "group-distance" else written(distance.cell_distances(space, means, config.distance_metric), "cell-distances")
    progress("bandwidth", {})
    family = between.where("target_group < source_group") if by_cell is None else by_cell
    h = written(weighting.bandwidth(family, config.bandwidth, config.bandwidth_scale), "bandwidth")
    progress("weights", {})
    w = weighting.weights(space, sizes, h, config.weight_mode, config.kernel, config.group_size_correction, by_cell, between)
    w = w.join(cells.select("cell", "cell_ord"), "cell")
    genes = x.genes().select("gene") if "targets" not in given else given["targets"].select("gene")
    return State(
        cells, x, sizes, rep, means, between, by_cell, h, w, [r["gene"] for r in given["tfs"].orderBy("ord").collect()], genes, cells.count()
    )


def models(state: State) -> DataFrame:
    """(target_group, target) of all requested models: groups x targets rows of names."""
    groups = state.sizes.select(F.col("grp").cast("string").alias("target_group"))
    return state.targets.select(F.col("gene").alias("target")).join(groups, how="cross").select("target_group", "target")


def fit(vectors: DataFrame, shared: forest.SharedFiles, wanted: DataFrame, settings: ForestParams, seed: int, counts: tuple[int, ...] | None = None) -> DataFrame:
    """Results of the ``wanted`` models (target_group, target), with responses from ``vectors`` (gene, y)."""
    # ranges, not hashes: with few targets a hash puts several of them into one task while others have none
    rows = forest.by_target(wanted, vectors).repartitionByRange(max(1, vectors.sparkSession.sparkContext.defaultParallelism * 8), "target")
    return forest.fit_models(rows, shared, settings, seed, counts)


def infer(spark: SparkSession, config: InferConfig, progress: Progress = lambda phase, info: None, resume: bool = False, checkpoint: bool = True) -> RunResult:
    """Run an inference; the folder appears whole.  With failed models it is published as such, then an error is raised."""
    final = absolute(config.output_dir)
    if resume and not checkpoint:
        raise ValueError("resuming needs the checkpoint")
    with published(spark, final) as out:
        began = datetime.now(UTC).isoformat()
        inputs = {k: text.fingerprint(spark, getattr(config, k))["sha256"] for k in ("expression", "tf_list", "groups", "target_list", "centroid_weights") if getattr(config, k)}
        decisive = {k: v for k, v in config.to_dict().items() if k not in ("output_dir", "report", "threads", "parallel_backend", "expression", "tf_list", "groups", "target_list", "centroid_weights")}
        store = Checkpoint(spark, checkpoint_path(spark, final), identity(decisive, inputs)) if checkpoint else None
        if store:
            store.open(resume)  # before any work
        state = build(spark, config, progress)
        weights = store.weights(state.weights) if store else written(state.weights, "weights")
        weighting.require_positive(weights)
        progress("models", {})
        vectors = written(state.expression.vectors(), "genes")
        shared = forest.share(vectors, state.tfs, weights, state.n_cells)
        wanted = models(state)
        total = wanted.count()
        resumed = 0
        if store:
            done = store.results(forest.RESULT)
            resumed = done.count()
            number = store.next_number()
            # batches of models by a hash: each one is written whole before the next one starts
            size = max(1, -(-(total - resumed) // (PER_CORE * spark.sparkContext.defaultParallelism)))
            rest = remaining(wanted, done).withColumn("batch", F.pmod(F.xxhash64("target_group", "target"), F.lit(size)))
            for b in range(size):
                some = rest.where(F.col("batch") == b).drop("batch")
                store.append(number + b, fit(vectors, shared, some, params(config), config.random_seed))
                progress("models", {"batch": b + 1, "batches": size})
            results = store.results(forest.RESULT)
        else:
            results = written(fit(vectors, shared, wanted, params(config), config.random_seed), "results")
        progress("artifacts", {})
        summary = write_artifacts(out, config, state, weights, results, inputs, began, total, resumed)
        progress("publish", {})
    if store:
        store.remove()
    result = RunResult(final, **summary)
    if result.failed_models:
        raise RuntimeError(f"{result.failed_models} models failed; see model_diagnostics.tsv.gz in {final}")
    return result


def write_artifacts(out: str, config: InferConfig, state: State, weights: DataFrame, results: DataFrame, inputs: dict, began: str, total: int, resumed: int) -> dict:
    """All artifacts of a run; returns the summary."""
    n_edges = write_network(forest.edges(results, config.tree_method), f"{out}/network.csv")
    write_text(weights, f"{out}/cell_weights.tsv.gz", CELL_WEIGHTS, ["target_group", "cell_ord"], compress=True)
    n_skipped = write_text(forest.skipped(results), f"{out}/skipped_targets.tsv", SKIPPED, ["target_group", "target"])
    models_ = forest.model_diagnostics(results)
    n_models = write_text(models_, f"{out}/model_diagnostics.tsv.gz", models_.columns, ["target_group", "target"], compress=True)
    if n_models != total:
        raise RuntimeError(f"{n_models} of {total} models have a result")
    mass = diagnostics.weight_mass(weights).cache()
    audit = diagnostics.weight_summary(weights).cache()
    flags = {r["target_group"]: r.asDict() for r in diagnostics.warning_flags(audit, mass).collect()}  # one row per group
    masses: dict[str, dict[str, float]] = {}
    for r in diagnostics.dominant(mass).collect():  # one row a target group, at most
        masses.setdefault(r["target_group"], {})[r["source_group"]] = r["source_mass_percent"]
    texts = {r["target_group"]: diagnostics.messages(flags[r["target_group"]], r.asDict(), masses.get(r["target_group"], {})) for r in audit.collect()}
    spark = weights.sparkSession
    said = spark.createDataFrame([(g, m) for g, m in texts.items()], "target_group string, messages array<string>").select("target_group", F.to_json("messages").alias("warnings_json"))
    joined = audit.join(said, "target_group").join(mass, "target_group").withColumn("canonicalization_rule", F.lit(weighting.RULE))
    columns = [c for c in joined.columns if c != "target_group"]
    write_text(joined, f"{out}/weight_diagnostics.tsv", ["target_group", *columns], ["target_group", "source_group"])
    write_text(state.centroids.select(F.col("grp").alias("group"), F.col("dim").alias("dimension"), F.col("mu").alias("centroid")), f"{out}/centroids.tsv", ["group", "dimension", "centroid"], ["group", "dimension"])
    pairs = state.group_distance.withColumnRenamed("distance", "centroid_distance")
    write_text(pairs, f"{out}/group_distances.tsv", ["target_group", "source_group", "centroid_distance"], ["target_group", "source_group"])
    near = weighting.affinities(state.group_distance, state.sizes, state.bandwidth, config.kernel, config.group_size_correction).withColumnRenamed("distance", "centroid_distance")
    write_text(near, f"{out}/group_affinities.tsv", ["target_group", "source_group", "centroid_distance", "base_affinity", "group_size_factor"], ["target_group", "source_group"])
    own = state.cells.withColumn("centroid_weight", F.lit(1.0)) if not config.centroid_weights else state.cells
    normal = weighting.normalised_centroid_weights(own.select("cell", "cell_ord", "grp", "centroid_weight")).withColumnRenamed("grp", "group")
    write_text(normal, f"{out}/centroid_weights.tsv.gz", ["cell", "group", "centroid_weight", "normalized_centroid_weight"], ["cell_ord"], compress=True)
    per_group = weighting.centroid_weight_diagnostics(own.select("cell", "grp", "centroid_weight")).withColumnRenamed("grp", "group")
    write_text(per_group, f"{out}/centroid_weight_diagnostics.tsv", ["group", "n_cells", "weight_sum", "min_weight", "median_weight", "max_weight", "effective_sample_size"], ["group"])
    shown = state.representation.cells.join(state.cells.select("cell", "cell_ord"), "cell")
    k = min(3, state.representation.effective_components)
    if config.distance_space == "pca":
        flat = shown.select("cell", F.col("grp").alias("group"), "cell_ord", *[F.get("v", F.lit(i)).alias(f"PC{i + 1}") for i in range(k)])
        write_text(flat, f"{out}/cell_embedding.tsv.gz", ["cell", "group", *[f"PC{i + 1}" for i in range(k)]], ["cell_ord"], compress=True)
        ratios = spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(state.representation.ratios)], "component int, ratio double")
        ratios = distance.cumulative(ratios).select("component", F.col("ratio").alias("explained_variance_ratio"), F.col("cumulative").alias("cumulative_explained_variance_ratio"))
        write_text(ratios, f"{out}/pca_explained_variance.tsv", ratios.columns, ["component"])
    near_cells, near_centres, axes = display(state.representation, state.centroids, config.random_seed) if config.report else (None, None, "")
    if axes == "AuxiliaryPC":  # every point of the report can be looked up
        near_cells = written(near_cells, "auxiliary")
        names = [f"AuxiliaryPC{i + 1}" for i in range(len(near_cells.first()["v"]))]
        flat = near_cells.join(state.cells.select("cell", "cell_ord"), "cell").select("cell", F.col("grp").alias("group"), "cell_ord", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
        write_text(flat, f"{out}/cell_embedding.tsv.gz", ["cell", "group", *names], ["cell_ord"], compress=True)
    stats = forest.statistics(results).first()
    summary = {
        "status": "failed" if stats["failed"] else "complete", "n_edges": n_edges, "total_models": total, "trained_models": stats["trained"], "skipped_targets": n_skipped,
        "failed_models": stats["failed"], "resumed_models": resumed, "warnings": tuple(f"Target group {g!r}: {m}" for g, ms in sorted(texts.items()) for m in ms),
    }
    h = state.bandwidth.first()
    write_json(spark, config.to_dict(), f"{out}/parameters.json")
    write_json(
        spark,
        {"software": {"popnet": __version__}, "started": began, "finished": datetime.now(UTC).isoformat(), "inputs": inputs, "bandwidth": h.asDict(),
         "representation": {"components": state.representation.effective_components, "reason": state.representation.reason, "method": state.representation.method, "error_bound": state.representation.error_bound, "variance_outside": state.representation.outside}, "summary": summary}, f"{out}/run_metadata.json",
    )
    if config.report:
        shown = {k: v for k, v in summary.items() if k != "warnings"}
        write_bytes(spark, report.build(near_cells, near_centres, axes, state.sizes, weights, shown).encode(), f"{out}/report.html")
    return summary


class ForestPrefixes:
    """The same models with several numbers of trees from one growth."""

    def __init__(self, spark: SparkSession, state: State, config: InferConfig, counts: tuple[int, ...]) -> None:
        self.spark, self.state, self.config, self.counts = spark, state, config, counts
        self.weights = written(state.weights, "weights")
        self.vectors = written(state.expression.vectors(), "genes")
        self.shared = forest.share(self.vectors, state.tfs, self.weights, state.n_cells)

    def _fit(self, wanted: DataFrame) -> DataFrame:
        return fit(self.vectors, self.shared, wanted, params(self.config), self.config.random_seed, self.counts)

    def results(self) -> DataFrame:
        """A row per (target group, target, number of trees)."""
        return self._fit(models(self.state))

    def iter_batches(self, batches: int = 8) -> Iterator[DataFrame]:
        """The results in parts by a hash of the model."""
        all_ = models(self.state).withColumn("batch", F.pmod(F.xxhash64("target_group", "target"), F.lit(batches)))
        for b in range(batches):
            yield self._fit(all_.where(F.col("batch") == b).drop("batch"))


    def iter_groups(self, ahead: int = 1) -> GroupResults:
        """(target group, results) in the order of the groups' names, ``ahead`` groups being fitted while one is consumed; to be closed."""
        wanted = written(models(self.state), "models")
        names = sorted(r[0] for r in wanted.select("target_group").distinct().collect())
        return GroupResults(self.spark, names, lambda g: self._fit(wanted.where(F.col("target_group") == g)), ahead)


def prepare_inference(
    spark: SparkSession, matrix: np.ndarray, genes: list[str], cells: list[str], groups: list[str], tfs: list[str], targets: list[str] | None = None,
    centroid_weights: list[float] | None = None, **settings: object,
) -> ForestPrefixes:
    """The state of an inference from arrays: ``matrix`` is genes x cells, ``groups`` a group for each cell; ``settings`` are those of InferConfig without its files."""
    x = Expression.of(spark, matrix, genes, cells)
    if len(groups) != len(cells) or (centroid_weights is not None and len(centroid_weights) != len(cells)):
        raise InputError("A group, and a centroid weight where there are any, is needed for each cell")
    listed = lambda names: spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "gene string, ord int")
    given = {"tfs": listed(tfs), "groups": spark.createDataFrame(list(zip(cells, groups, strict=True)), "cell string, grp string")}
    if targets is not None:
        given["targets"] = listed(targets)
    if centroid_weights is not None:
        given["centroid_weights"] = spark.createDataFrame([(c, float(w)) for c, w in zip(cells, centroid_weights, strict=True)], "cell string, centroid_weight double")
        require_none(given["centroid_weights"].where("not (centroid_weight > 0) or centroid_weight = double('Infinity')"), "cell", "Centroid weights that are not positive and finite")
    for what in ("tfs", "targets"):
        if what in given:
            require_none(missing_from(given[what], x.genes(), "gene"), "gene", f"Names of {what} that are not in the matrix")
    files = dict.fromkeys(("expression", "tf_list", "groups", "output_dir"), "(memory)")
    config = InferConfig(**files, **(settings | ({"centroid_weights": "(memory)"} if centroid_weights is not None else {})))
    return ForestPrefixes(spark, derive(spark, x, given, config), config, (config.n_estimators,))


def prepare_forest_prefixes(spark: SparkSession, config: InferConfig, counts: tuple[int, ...]) -> ForestPrefixes:
    """Check the numbers of trees (strictly increasing, ending at n_estimators) and build the state; writes no output folder."""
    if not counts or list(counts) != sorted(set(counts)) or counts[0] < 1 or counts[-1] != config.n_estimators:
        raise ValueError("numbers of trees must be positive, strictly increasing and end at n_estimators")
    return ForestPrefixes(spark, build(spark, config), config, tuple(counts))
