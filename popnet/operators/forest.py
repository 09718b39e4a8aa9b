"""One weighted ensemble per (target group, target): narrow Arrow batches over target rows.

A target's row carries its response vector once, and the target groups that want a model.
Predictors (single precision) and the target groups' weights are shared by all models:
executors write them as binary columns in the shared folder, every executor fetches those
files once (``SparkContext.addFile``), lays them out as one matrix on its own disk and maps
it into memory, so all its workers read the same pages.  Nothing of them passes through the
driver, and a worker's own memory is one model's.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from popnet.operators.screening import CONSTANT, INSUFFICIENT, NO_VARIABLE, ONLY_SELF
from popnet.operators.trees import ForestParams, prefixes, shape_summary, task_seed
from popnet.storage import files, shared_dir

#: Bytes of a file of shared columns, about.
FILE_BYTES = 64 << 20
#: How an edge was found, by method.
EVIDENCE = {"extra-trees": "weighted_extra_trees_feature_importance", "random-forest": "weighted_random_forest_feature_importance"}
NEGATIVE_TOLERANCE = 2.220446049250313e-16
SHAPES = [f"tree_{a}_{b}" for a in ("nodes", "leaves", "depth") for b in ("total", "mean", "p50", "p95", "max")]
RESULT = (
    "target_group string, target string, n_estimators int, status string, random_seed long, n_samples long, n_positive_weight_samples long, weight_sum double, "
    "n_predictors_input long, n_predictors_used long, discarded_predictors array<string>, constant_predictors array<string>, n_edges long, importance_sum double, "
    "fit_seconds double, n_estimators_fitted long, " + ", ".join(f"{s} double" for s in SHAPES) + ", message string, edges array<struct<source:string,score:double>>"
)


@dataclass(frozen=True)
class Shared:
    """What all models of a run share: factors in list order, predictors (cells x factors), weights by target group."""

    tfs: list[str]
    x: np.ndarray
    weights: dict[str, np.ndarray]


@dataclass(frozen=True)
class SharedFiles:
    """The same as files that every executor has: names of the files of predictors (a factor a row) and of weights (a target group a row)."""

    key: str
    tfs: list[str]
    groups: list[str]
    n_cells: int
    x: tuple[str, ...]
    w: tuple[str, ...]

    def opened(self) -> Shared:
        """In a worker: the matrices, mapped into memory from this executor's disk."""
        if self.key not in _OPEN:
            x = _mapped(f"{self.key}-x", self.x, (len(self.tfs), self.n_cells), np.float32)
            w = _mapped(f"{self.key}-w", self.w, (len(self.groups), self.n_cells), np.float64)
            _OPEN.clear()  # a worker fits one run at a time
            _OPEN[self.key] = Shared(self.tfs, x.T, dict(zip(self.groups, w, strict=True)))
        return _OPEN[self.key]


#: What this worker has mapped.
_OPEN: dict[str, Shared] = {}


def _mapped(name: str, parts: tuple[str, ...], shape: tuple[int, int], kind: type) -> np.ndarray:
    """The matrix laid out in a file beside the fetched ones; the first worker makes it, under a name of its own until it is whole."""
    path = f"{SparkFiles.getRootDirectory()}/popnet-{name}.bin"
    if not os.path.exists(path):
        handle, own = tempfile.mkstemp(dir=SparkFiles.getRootDirectory())
        os.close(handle)
        out = np.memmap(own, kind, "w+", shape=(max(1, shape[0]), max(1, shape[1])))
        for part in parts:
            for batch in pq.ParquetFile(SparkFiles.get(part)).iter_batches(batch_size=16):
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    out[at] = np.frombuffer(data.as_buffer(), kind)
        out.flush()
        del out
        os.replace(own, path)
    return np.memmap(path, kind, "r", shape=shape) if min(shape) else np.zeros(shape, kind)


def gene_vectors(expression: DataFrame) -> DataFrame:
    """(gene, y): each gene's values in the order of cell_ord; ``expression`` is the complete (gene, cell_ord, x)."""
    return expression.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_ord", "x"))), lambda s: s["x"]).alias("y"))


def _stored(rows: DataFrame, kind: type, n_bytes: int, folder: str) -> tuple[str, ...]:
    """Write (at, y) as (at, bytes) in files of about FILE_BYTES, have every executor fetch them, and return their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, y in zip(batch.column(0), batch.column(1), strict=True):
                data = y.values.to_numpy(zero_copy_only=False).astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], pa.int32()), pa.array([data], pa.binary())], names=["at", "data"])

    spark = rows.sparkSession
    spread = rows.select(F.col("at").cast("int"), "y").repartition(max(1, -(-n_bytes // FILE_BYTES)), "at")
    spread.mapInArrow(run, "at int, data binary").write.option("compression", "none").parquet(folder)
    found = files(spark, folder, "part-")
    for path in found:
        spark.sparkContext.addFile(path)
    return tuple(os.path.basename(path) for path in found)


def share(vectors: DataFrame, tfs: list[str], weights: DataFrame, n_cells: int) -> SharedFiles:
    """Predictors from ``vectors`` (gene, y) and weights (target_group, cell_ord, final_weight) as files; an action.  Lists of names alone reach the driver."""
    spark, key = vectors.sparkSession, uuid.uuid4().hex
    folder = f"{shared_dir(spark)}/popnet-shared-{key}"
    listed = spark.createDataFrame(list(zip(tfs, range(len(tfs)), strict=True)), "gene string, at int")
    x = _stored(vectors.join(listed, "gene").select("at", "y"), np.float32, 4 * n_cells * len(tfs), f"{folder}/x")
    named = weights.select(F.col("target_group").cast("string").alias("target_group"), "cell_ord", "final_weight")
    groups = sorted(r[0] for r in named.select("target_group").distinct().collect())
    order = spark.createDataFrame(list(zip(groups, range(len(groups)), strict=True)), "target_group string, at int")
    rows = named.groupBy("target_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_ord", "final_weight"))), lambda s: s["final_weight"]).alias("y"))
    w = _stored(rows.join(order, "target_group").select("at", "y"), np.float64, 8 * n_cells * len(groups), f"{folder}/w")
    return SharedFiles(key, tfs, groups, n_cells, x, w)


def _record(group: str, target: str, status: str, seed: int, w: np.ndarray, n_tfs: int, used: int, discarded: list[str], constant: list[str], message: str, count: int) -> dict:
    return {
        "target_group": group, "target": target, "n_estimators": count, "status": status, "random_seed": seed, "n_samples": len(w), "n_positive_weight_samples": int((w > 0).sum()),
        "weight_sum": float(w.sum()), "n_predictors_input": n_tfs, "n_predictors_used": used, "discarded_predictors": discarded, "constant_predictors": constant, "n_edges": 0,
        "importance_sum": 0.0, "fit_seconds": 0.0, "n_estimators_fitted": 0, **dict.fromkeys(SHAPES, 0.0), "message": message, "edges": [],
    }


def fit_model(group: str, target: str, y: np.ndarray, shared: Shared, params: ForestParams, seed: int, counts: tuple[int, ...]) -> list[dict]:
    """One record for each number of trees in ``counts``: the model's status, diagnostics and edges."""
    w = shared.weights[group]
    some = w > 0
    own = task_seed(seed, group, target)
    x = shared.x.T[:, some]  # a factor a row, as it is stored
    low, high = (x.min(axis=1), x.max(axis=1)) if some.any() else (np.zeros(len(shared.tfs)),) * 2
    others = np.array([t != target for t in shared.tfs], bool)
    usable = np.flatnonzero(others & (low != high))
    constant = [shared.tfs[i] for i in np.flatnonzero(others & (low == high))]
    discarded = [t for i, t in enumerate(shared.tfs) if not others[i] or low[i] == high[i]]

    def skipped(status: str, used: int, message: str, const: list[str]) -> list[dict]:
        return [_record(group, target, status, own, w, len(shared.tfs), used, discarded, const, message, c) for c in counts]

    if some.sum() < 2:
        return skipped(INSUFFICIENT, len(usable), "fewer than two cells have a positive weight", constant)
    if y[some].min() == y[some].max():
        return skipped(CONSTANT, len(usable), "the target does not vary among cells of positive weight", constant)
    if not others.any():
        return skipped(ONLY_SELF, 0, "the target is the only transcription factor", [])
    if not len(usable):
        return skipped(NO_VARIABLE, 0, "no other transcription factor varies among cells of positive weight", constant)
    out = []
    began = time.perf_counter()
    try:
        for count, forest in zip(counts, prefixes(x[usable].T, y[some], w[some], params, own, counts), strict=True):
            r = _record(group, target, "trained", own, w, len(shared.tfs), len(usable), discarded, constant, "", count)
            imp = forest.importances
            r |= {"fit_seconds": time.perf_counter() - began, "n_estimators_fitted": count} | shape_summary(forest.shapes)
            if not np.isfinite(imp).all() or (imp < -NEGATIVE_TOLERANCE).any():
                r |= {"status": "invalid_feature_importances", "message": "importances are negative or not finite"}
            else:
                edges = sorted((shared.tfs[i], float(s)) for i, s in zip(usable, imp, strict=True) if s > 0)
                r |= {"edges": [{"source": a, "score": b} for a, b in edges], "n_edges": len(edges), "importance_sum": float(sum(b for _, b in edges))}
                if not edges:
                    r |= {"status": "trained_no_positive_importance", "message": "no predictor has a positive importance"}
            out.append(r)
    except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:  # a model's own failure is recorded, anything else ends the run
        return skipped("fit_failed", len(usable), f"{type(e).__name__}: {e}", constant)
    return out


def by_target(wanted: DataFrame, vectors: DataFrame) -> DataFrame:
    """(target_groups, target, y): each target's response once, with the groups of ``wanted`` (target_group, target)."""
    named = wanted.groupBy("target").agg(F.collect_set(F.col("target_group").cast("string")).alias("target_groups"))
    return named.join(vectors, F.col("target") == F.col("gene")).select("target_groups", "target", "y")


def fit_models(models: DataFrame, shared: Shared | SharedFiles, params: ForestParams, seed: int = 123, counts: tuple[int, ...] | None = None) -> DataFrame:
    """A RESULT row per model and number of trees; ``models`` is (target_group, target, y) or (target_groups, target, y).

    Arrow batches are bounded by their bytes (spark.sql.execution.arrow.maxBytesPerBatch), however long a response is.
    """
    some = counts or (params.n_estimators,)
    if list(some) != sorted(set(some)) or some[0] < 1:
        raise ValueError("numbers of trees must be positive and strictly increasing")
    spark = models.sparkSession
    if "target_groups" not in models.columns:
        models = models.withColumn("target_groups", F.array(F.col("target_group").cast("string")))
    held = spark.sparkContext.broadcast(shared)  # files: their names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            given = held.value.opened() if isinstance(held.value, SharedFiles) else held.value
            for r in frame.itertuples(index=False):
                y = np.asarray(r.y, float)
                for group in sorted(r.target_groups):
                    yield pd.DataFrame(fit_model(group, r.target, y, given, params, seed, some))

    return models.select("target_groups", "target", "y").mapInPandas(run, RESULT)


def edges(results: DataFrame, method: str = "extra-trees") -> DataFrame:
    """(source, target, score, sign, evidence, context): the network."""
    one = results.select("target_group", "target", F.explode("edges").alias("e")).where("e.score > 0")
    return one.select(
        F.col("e.source").alias("source"), "target", F.col("e.score").alias("score"), F.lit("?").alias("sign"),
        F.lit(EVIDENCE[method]).alias("evidence"), F.concat(F.lit("group:"), "target_group").alias("context"),
    )


def skipped(results: DataFrame) -> DataFrame:
    """(target_group, target, reason, detail) of models without edges."""
    reason = F.when(F.col("status") == "trained_no_positive_importance", "no_positive_feature_importance").otherwise(F.col("status"))
    return results.where("status <> 'trained'").select("target_group", "target", reason.alias("reason"), F.col("message").alias("detail"))


def model_diagnostics(results: DataFrame) -> DataFrame:
    """The 31 columns of the diagnostics, lists as JSON text."""
    cols = [c for c in results.columns if c not in ("edges", "n_estimators")]
    named = {"discarded_predictors": "discarded_predictors_json", "constant_predictors": "constant_predictors_json"}
    return results.select(*[F.to_json(c).alias(named[c]) if c in named else F.col(c) for c in cols])


def statistics(results: DataFrame) -> DataFrame:
    """One row: counts by status, edges, and extremes of the fitted forests."""
    trained = F.col("status").isin("trained", "trained_no_positive_importance")
    return results.agg(
        F.count("*").alias("models"), F.count_if(trained).alias("trained"), F.count_if(~trained).alias("skipped"),
        F.count_if(F.col("status").isin("fit_failed", "invalid_feature_importances")).alias("failed"), F.coalesce(F.sum("n_edges"), F.lit(0)).alias("edges"),
        F.max("tree_nodes_max").alias("largest_tree"), F.max("tree_depth_max").alias("deepest_tree"), F.sum("fit_seconds").alias("fit_seconds"),
    )


def parse_json_list(text: str) -> list[str]:
    """A list that ``model_diagnostics`` wrote."""
    return json.loads(text)
