"""Centroids and distances.

Cells are rows (cell, grp, v array<double>).  Centroids are grouped means, combined before
their shuffle.  A cell meets the centroids as a matrix product in Arrow batches: no
explosion into cells x dimensions x groups rows, and no shuffle at all.  The centroid
matrix is broadcast in blocks of groups of at most ``BLOCK_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from popnet.functions.columns import EPSILON

BLOCK_BYTES = 64 << 20
#: Rows of distances in one Arrow batch, at most, or those of one cell.
OUT_ROWS = 1 << 18
TINY, HUGE = np.finfo(float).tiny, np.finfo(float).max


def exploded(cells: DataFrame) -> DataFrame:
    """(cell, grp, dim, z), dim from 1."""
    return cells.select("cell", "grp", F.posexplode("v").alias("dim", "z")).withColumn("dim", F.col("dim") + 1)


def standardised(cells: DataFrame) -> DataFrame:
    """Each dimension less its mean by its population deviation (zero deviation: left at the centre)."""
    stats = exploded(cells).groupBy("dim").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"))
    lists = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("stats"))  # one row: a dimension each
    scaled = F.zip_with("v", "stats", lambda z, t: (z - t["m"]) / F.when(t["s"] == 0, F.lit(1.0)).otherwise(t["s"]))
    return cells.crossJoin(lists).withColumn("v", scaled).drop("stats")


def centroids(cells: DataFrame, weight: str | None = None) -> DataFrame:
    """(grp, dim, mu): means, or means weighted by a non-negative column scaled by its group's largest.

    A mean that leaves the range of doubles is taken from values scaled by their largest.
    """
    if weight is None:
        # the same mean of values scaled down by a power of two, which cannot overflow, stands in where a sum does
        plain, small = F.avg("z"), F.avg(F.col("z") * F.lit(2.0**-64)) * F.lit(2.0**64)
        finite = ~F.isnan(plain) & (F.abs(plain) < float("inf"))
        return exploded(cells).groupBy("grp", "dim").agg(F.when(finite, plain).otherwise(small).alias("mu"))
    tops = cells.groupBy("grp").agg(F.max(weight).alias("wmax"))
    rows = cells.join(tops, "grp").withColumn("w", F.col(weight) / F.col("wmax"))
    rows = rows.select("grp", "w", F.posexplode("v").alias("dim", "z")).withColumn("dim", F.col("dim") + 1)
    return rows.groupBy("grp", "dim").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("mu"))


def centroid_vectors(means: DataFrame) -> DataFrame:
    """(grp, v): a centroid in one row."""
    return means.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mu"))), lambda x: x["mu"]).alias("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / np.where(top == 0, 1, top)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _euclidean(x: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Differences by centroid; scaled ones where squares would leave the range of doubles."""
    d = x.shape[1]
    top = max(np.abs(x).max(initial=0), np.abs(mu).max(initial=0))
    out = np.empty((len(x), len(mu)))
    for j, m in enumerate(mu):
        diff = x - m
        if top <= np.sqrt(HUGE / max(d, 1)) / 2 and (top == 0 or top >= np.sqrt(TINY)):
            out[:, j] = np.sqrt((diff * diff).sum(axis=1))
        else:
            big = np.abs(x / 2 - m / 2).max(axis=1, initial=0.0)  # halves can't overflow
            safe = np.where(big == 0, 1, big)
            out[:, j] = 2 * big * np.sqrt((((x / 2 - m / 2) / safe[:, None]) ** 2).sum(axis=1))
    return out


def pairwise(x: np.ndarray, mu: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to centroids; cosine distances within rounding of zero are zero."""
    if metric == "euclidean":
        return _euclidean(x, mu)
    n = x.shape[1] + 4
    gamma = n * EPSILON / (1 - n * EPSILON)
    out = np.clip(1.0 - _unit(x) @ _unit(mu).T, 0.0, 2.0)
    out[out <= gamma] = 0.0
    return out


def cell_distances(cells: DataFrame, means: DataFrame, metric: str = "cosine", half: bool = False) -> DataFrame:
    """(cell, grp, target_group, distance) of each cell to each centroid, or (``half``) to those whose group's name isn't below its own group's.

    The groups' vectors reach the driver in blocks whose size is checked first; with more
    groups than a block holds, the cells are passed once per block.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = cells.sparkSession
    vectors = centroid_vectors(means)
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-shape["n"] * (shape["d"] or 0) * 8 // BLOCK_BYTES))
    kind = dict(cells.dtypes)
    schema = f"cell {kind['cell']}, grp {kind['grp']}, target_group {kind['grp']}, distance double"
    out: DataFrame | None = None
    for b in range(blocks):
        rows = vectors.where(F.pmod(F.hash("grp"), F.lit(blocks)) == b).orderBy("grp").collect()
        if not rows:
            continue
        held = spark.sparkContext.broadcast(([r["grp"] for r in rows], np.array([r["v"] for r in rows], float)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, mu = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, mu.shape[1])
                step = max(1, OUT_ROWS // len(names))
                for first in range(0, batch.num_rows, step):
                    some = batch.slice(first, step)
                    if half:
                        at, to = np.nonzero([[n >= g for n in names] for g in some.column(1).to_pylist()])
                        found = np.concatenate([pairwise(x[first + i : first + i + 1], mu[to[at == i]], metric).ravel() for i in range(some.num_rows)])
                    else:
                        at, to = np.divmod(np.arange(some.num_rows * len(names)), len(names))
                        found = pairwise(x[first : first + step], mu, metric).ravel()
                    targets = pa.array(names, batch.schema.field(1).type).take(pa.array(to))
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at)), some.column(1).take(pa.array(at)), targets, pa.array(found)], names=["cell", "grp", "target_group", "distance"])

        part = cells.select("cell", "grp", "v").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def group_distances(means: DataFrame, metric: str = "cosine") -> DataFrame:
    """(target_group, source_group, distance): symmetric, zero on the diagonal; a pair is computed once."""
    vectors = centroid_vectors(means).select(F.col("grp").alias("cell"), "grp", "v")
    upper = cell_distances(vectors, means, metric, half=True)
    own = F.col("grp") == F.col("target_group")
    pair = lambda a, b: F.struct(F.col(a).alias("target_group"), F.col(b).alias("source_group"), F.when(own, F.lit(0.0)).otherwise(F.col("distance")).alias("distance"))
    both = F.when(own, F.array(pair("grp", "target_group"))).otherwise(F.array(pair("grp", "target_group"), pair("target_group", "grp")))
    return upper.select(F.inline(both))


def zero_norm_rows(cells: DataFrame) -> DataFrame:
    """Cells whose vector is all zero: cosine distance is not defined for them."""
    return cells.where(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)) == 0).select("cell")


def cumulative(components: DataFrame) -> DataFrame:
    """(component, ratio, cumulative): running sum over at most as many rows as components."""
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return components.withColumn("cumulative", F.sum("ratio").over(w))
