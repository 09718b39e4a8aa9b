"""Nearest neighbours by a block matrix join on int8 tiles (operator 1).

The stated queries come in blocks of bounded bytes; each block is broadcast and meets all
candidate rows in tiles.  A vector is int8 codes times a scale plus an error of known
length.  Tile products of codes (exact integers) give an estimate of every distance, and
the two error lengths bound how far off it is.  Pairs whose lower bound is within the
query's current k-th exact distance are recomputed in double precision on the original
vectors and merged into its heap, so the result is exact: recall is 1.

A task keeps k entries a query; those are what is shuffled.  One block's pass is narrow,
so a lost executor repeats its own tasks only.

Defined cases: vectors null, zero or with null or non-finite components take no part, nor
rows with a null id; vectors of another length than the query's are no candidates of it;
ties go to the smaller id; a repeated row (id and vector) counts once; the query's own id
is no candidate; no queries or no candidates give an empty table; further columns, whatever
their names, are ignored; a vector of any length is taken whole (a block holds one query at
least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from popnet.llm.shared import table, written
from popnet.llm.vectors import TILE, Best, matrices, query_blocks, repeats, usable

K = 10


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors): x = codes * scale + rest, where the rest's length is at most the error."""
    scale = np.maximum(np.abs(x).max(axis=1), np.finfo(float).tiny * 256) / 127
    codes = np.rint(x / scale[:, None])
    error = _lengths(x - codes * scale[:, None]) * (1 + 1e-9)
    return codes.astype(np.int8), scale, error


def _lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1)
    return top * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1))


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in double precision; scaled where squares would leave the range."""
    with np.errstate(all="ignore"):
        diff = a - b
        total = np.zeros(len(diff))
        for column in np.ascontiguousarray(diff.T):  # in the order of the components
            total += column * column
        out = np.sqrt(total)
    top = np.abs(diff).max(axis=1, initial=0.0)
    odd = ~np.isfinite(out) | ((top > 0) & (top < 1e-150))
    if odd.any():
        with np.errstate(all="ignore"):
            out[odd] = _lengths(diff[odd])
    return out


def _tile(best: Best, base: int, qids: np.ndarray, q: np.ndarray, qc: tuple, ids: np.ndarray, names: np.ndarray, x: np.ndarray) -> None:
    """One tile: queries (rows base..) against candidates."""
    codes, scale, error = quantised(x)
    qcodes, qscale, qerror = qc
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integer products stay exact
    dots = qcodes.astype(exact) @ codes.astype(exact).T
    with np.errstate(all="ignore"):
        qn, xn = (s * s * (c.astype(float) ** 2).sum(axis=1) for s, c in ((qscale, qcodes), (scale, codes)))
        square = qn[:, None] + xn[None, :] - 2 * (qscale[:, None] * scale[None, :]) * dots
        slack = 1e-12 * (qn[:, None] + xn[None, :])  # rounding of the line above
        low = np.sqrt(np.maximum(square - slack, 0)) * (1 - 1e-12) - (qerror[:, None] + error[None, :])
        high = np.sqrt(np.maximum(square + slack, 0)) * (1 + 1e-12) + (qerror[:, None] + error[None, :])
    low[~np.isfinite(low)] = -np.inf  # out of range: decided exactly
    high[~np.isfinite(high)] = np.inf
    own = qids[:, None] == ids[None, :]
    low[own] = np.inf
    high[own] = np.inf
    n = len(qids)
    cut = best.cut[base : base + n]
    if len(ids) > 4 * best.k:
        high[:, repeats(ids, names)] = np.inf  # the bound asks for k different rows
        cut = np.minimum(cut, np.partition(high, best.k - 1, axis=1)[:, best.k - 1])
    a, b = np.nonzero(low <= cut[:, None])
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        fine = ~own[i, j]
        i, j = i[fine], j[fine]
        best.merge(i + base, exact_distances(q[i], x[j]), ids[j], names[j])


def _search(batches: Iterator[pa.RecordBatch], block: list, k: int) -> Iterator[pa.RecordBatch]:
    """The best of this task's candidates for each query of the block."""
    parts, n = [], 0
    for d, qids, _, q in block:
        for at in range(0, len(qids), TILE):
            parts.append((d, n, qids[at : at + TILE], q[at : at + TILE], quantised(q[at : at + TILE])))
            n += len(qids[at : at + TILE])
    best = Best(n, k, 1, float)
    for batch in batches:
        for d, ids, names, x in matrices(batch):
            for at in range(0, len(ids), TILE):
                for dim, base, qids, q, qc in parts:
                    if dim == d:
                        _tile(best, base, qids, q, qc, ids[at : at + TILE], names[at : at + TILE], x[at : at + TILE])
    yield best.table(np.concatenate([p[2] for p in parts]))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of ``vectors`` to each row of ``queries``, by Euclidean distance."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, nonzero=True)
    found: DataFrame | None = None
    for block in query_blocks(usable(queries, id_col, vector_col, nonzero=True)):
        held = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(lambda it, held=held: _search(it, held.value, k), "query_id long, query_row long, vec_id long, h long, score double")
        w = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id", "h")
        part = part.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        part = part.select("query_id", "rank", "vec_id", "score")
        part = written(part, "nearest")  # a block's rows are found once
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each row whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


#: All distances in DuckDB: a stated query set against all rows.
OP1_SQL = """
WITH fine AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, 
    sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
