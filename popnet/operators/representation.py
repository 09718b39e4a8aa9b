"""Distance representation: the expression itself, or its principal components.

The centred matrix is taken apart by a tree of QR decompositions: each task reduces its
cells to a triangle, a block at a time, triangles of sixteen tasks are stacked and reduced
again until one is left, and the driver takes that one apart.  Nothing is squared on the
way, and no task holds more than sixteen triangles.

With up to ``FULL`` genes (solver ``full`` or ``auto``) the triangle is that of the matrix
itself.  With more genes, or the solver ``randomized``, a randomised range finder comes
first: a seeded thin matrix is multiplied by the scatter matrix in one narrow pass a round
(power iteration), and the cells' products with its basis are what is reduced.  Each round
gives the residual of the leading components, which bounds their eigenvalues' error; the
solver ``randomized`` takes ``POWER`` rounds, the others go on until the bound is at
``SETTLED`` of the largest eigenvalue.  Scores come from one more narrow pass with the
loadings broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from popnet.operators.checks import InputError
from popnet.storage import released, written

SOLVERS = ("auto", "randomized", "full")
#: Genes whose own triangle is taken; triangles that are stacked in one task.
FULL, FAN = 2048, 16
#: Columns beside the components; rounds of the solver ``randomized``, and of the others at most; the bound at which these end.
SPARE, POWER, ROUNDS, SETTLED = 10, 7, 100, 1e-10


@dataclass(frozen=True)
class Representation:
    """(cell, grp, v) and how it came about."""

    cells: DataFrame
    ratios: tuple[float, ...] = ()
    effective_components: int = 0
    reason: str = ""
    method: str = ""
    #: Bound of the eigenvalues' error, as a share of the largest one.
    error_bound: float = 0.0
    #: Share of the variance outside the components that were looked at.
    outside: float = 0.0
    #: Mean and loadings (dimensions x components); none where the space is the expression itself.
    basis: tuple[np.ndarray, np.ndarray] | None = None


def _block(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _add(table: pa.Table) -> pa.Table:
    """The sum of one row's parts."""
    column = table.column("values").combine_chunks()
    total = column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table({"row": pa.array([table.column("row")[0].as_py()], pa.int32()), "values": pa.array([total], pa.list_(pa.float64()))})


def _total(cells: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all cells of ``part`` (a block of cells to a matrix): a matrix per task, added by row on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_block(batch))
                total = one if total is None else total + one
        for i in range(0, 0 if total is None else len(total), 256):
            some = total[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(some)), pa.int32()), pa.array(list(some), pa.list_(pa.float64()))], names=["row", "values"])

    schema = "row int, values array<double>"
    got = cells.select("v").mapInArrow(run, schema).groupBy("row").applyInArrow(_add, schema).toArrow().sort_by("row")
    return got.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, -1)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns whose largest loading is positive."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _triangle(cells: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The triangle R of the rows that ``part`` makes of all blocks of cells (``width`` columns), by a tree of QR decompositions."""
    schema = "node int, row int, values array<double>"

    def rows(node: int, r: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(np.full(len(r), node), pa.int32()), pa.array(np.arange(len(r)), pa.int32()), pa.array(list(r), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, names=["node", "row", "values"])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.vstack((r, part(_block(batch)))), mode="r")
        if len(r):
            yield rows(TaskContext.get().partitionId(), r)

    def stacked(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("node", "ascending"), ("row", "ascending")])
        flat = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.Table.from_batches([rows(key[0].as_py(), np.linalg.qr(flat.reshape(table.num_rows, width), mode="r"))])

    tree = written(cells.select("v").mapInArrow(reduced, schema), "triangles")
    nodes = (tree.agg(F.max("node")).first()[0] or 0) + 1
    top = tree
    while nodes > 1:
        top = top.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("node").applyInArrow(stacked, schema)
        nodes = -(-nodes // FAN)
    got = top.select("row", "values").toArrow().sort_by("row")
    released(tree)
    return got.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, width)


def principal_components(cells: DataFrame, n_components: int = 50, seed: int = 0, solver: str = "auto") -> Representation:
    """The first min(n_components, genes, cells - 1) principal components of ``cells`` (cell, grp, v), at least one.

    An action.  Without variance all scores and ratios are zero and the reason says so.
    """
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}; one of {SOLVERS}")
    first = cells.select("v").first()
    if first is None:
        raise InputError("no cells")
    shift = np.array(first[0], float)  # values are moved by a cell's, which keeps the sums small
    d = len(shift)
    sums = _total(cells, lambda x: np.stack([np.full(d, float(len(x))), (x - shift).sum(axis=0), ((x - shift) ** 2).sum(axis=0)]))
    n, off = int(sums[0, 0]), sums[1] / sums[0]
    mean, total = shift + off, float((sums[2] - sums[0] * off * off).clip(0).sum())
    k = min(n_components, max(1, min(d, n - 1)))
    reason = "fewer than two cells" if n < 2 else "no variance" if total <= 0 else ""
    bound, outside, method = 0.0, 0.0, ""
    if reason:
        loadings, values = np.zeros((d, k)), np.zeros(k)
    elif solver != "randomized" and d <= FULL:
        method = "triangle of the matrix"
        _, singular, vectors = np.linalg.svd(_triangle(cells, d, lambda x: x - mean), full_matrices=False)
        values, loadings = _leading(singular, vectors, k)
    else:
        rounds = POWER if solver == "randomized" else ROUNDS
        basis, bound, took = _range(cells, mean, k, seed, rounds)
        method = f"range finder, {took} rounds"
        held = cells.sparkSession.sparkContext.broadcast(basis)
        _, singular, vectors = np.linalg.svd(_triangle(cells, basis.shape[1], lambda x: (x - mean) @ held.value), full_matrices=False)
        values, inner = _leading(singular, vectors, k)
        loadings = basis @ inner
        outside = max(0.0, 1.0 - float((singular**2).sum()) / total)
        if solver != "randomized" and bound > SETTLED:
            reason = f"components not settled after {ROUNDS} rounds"
    loadings = _signed(loadings)
    ratios = np.clip(values, 0, None) / total if total > 0 else np.zeros(k)
    return Representation(projected(cells, (mean, loadings)), tuple(ratios.tolist()), k, reason, method, bound, outside, (mean, loadings))


def projected(cells: DataFrame, basis: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(cell, grp, v): the scores of ``cells`` (cell, grp, v) by a mean and loadings, in one narrow pass."""
    held = cells.sparkSession.sparkContext.broadcast(basis)
    kinds = dict(cells.dtypes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, b = held.value
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list((x - m) @ b), pa.list_(pa.float64()))], names=["cell", "grp", "v"])

    return cells.select("cell", "grp", "v").mapInArrow(project, f"cell {kinds['cell']}, grp {kinds['grp']}, v array<double>")


def display(rep: Representation, means: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """(cells, centroids, name): two components at most of every cell and centroid, as (cell, grp, v), and what the components are called.

    In a space of components these are its first ones.  Otherwise auxiliary components of all
    cells are found for the display alone, and cells and centroids are projected by the same
    loadings; distances and weights have nothing to do with them.
    """
    vectors = means.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mu"))), lambda x: x["mu"]).alias("v"))
    centres = vectors.select(F.col("grp").cast("string").alias("cell"), "grp", "v")
    if rep.basis is not None:
        two = lambda rows: rows.select("cell", "grp", F.slice("v", 1, 2).alias("v"))
        return two(rep.cells), two(centres), "PC"
    wide = len(rep.cells.select("v").first()[0])
    found = principal_components(rep.cells, 2, seed, "auto" if wide <= FULL else "randomized")
    return found.cells, projected(centres, found.basis), "AuxiliaryPC"


def _leading(singular: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` eigenvalues and vectors (as columns); where there are fewer, zeros."""
    values, columns = np.zeros(k), np.zeros((vectors.shape[1], k))
    some = min(k, len(singular))
    values[:some], columns[:, :some] = singular[:some] ** 2, vectors[:some].T
    return values, columns


def _range(cells: DataFrame, mean: np.ndarray, k: int, seed: int, rounds: int) -> tuple[np.ndarray, float, int]:
    """A basis (genes x thin) of the leading components' range, the bound of their eigenvalues' error as a share of the largest, and the rounds taken.

    An eigenvalue of a symmetric matrix lies within the residual of an approximate
    eigenvector from its quotient, so the residuals that a round's product gives are a bound.
    """
    wide = min(len(mean), k + SPARE)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), wide)))
    for took in range(1, rounds + 1):
        held = cells.sparkSession.sparkContext.broadcast(basis)
        product = _total(cells, lambda x, held=held: (x - mean).T @ ((x - mean) @ held.value))
        inner = basis.T @ product
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        residual = np.linalg.norm(product @ vectors - basis @ (vectors * values), axis=0)
        bound = float(residual.max() / max(values[0], 1e-300))
        basis, _ = np.linalg.qr(product)
        if bound <= SETTLED:
            break
    return basis, bound, took


def represent(cells: DataFrame, space: str = "pca", n_components: int = 50, standardise: bool = False, seed: int = 0, solver: str = "auto") -> Representation:
    """The representation in which distances are taken."""
    from popnet.operators.distance import standardised

    if space not in ("pca", "expression"):
        raise ValueError(f"unknown distance space {space!r}")
    cells = standardised(cells) if standardise else cells
    return principal_components(cells, n_components, seed, solver) if space == "pca" else Representation(cells)
