"""Vectors in Arrow batches as numpy blocks, and stated query sets cut into bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from popnet.llm.shared import written

#: Bytes of query vectors (as doubles) that one broadcast may hold.
QUERY_BYTES = 16 << 20
#: Candidate vectors in a tile, at most.
TILE = 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(id long, v array<double>, h long): rows with an id and a vector of finite components (some not zero, if ``nonzero``); ``h`` names the vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if nonzero:
        fine &= F.exists("v", lambda x: x != 0)
    return rows.where(fine).withColumn("h", F.xxhash64("v"))


def query_blocks(queries: DataFrame, query_bytes: int = QUERY_BYTES) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The query rows in blocks of at most about ``query_bytes``: lists of (dimension, ids, names of the vectors, matrix of doubles).

    The count and the longest vector decide the number of blocks; blocks are dealt by a
    hash and read one after another, so the driver never holds more than one; for more than
    one, the queries are written first, so that the table is read once.  Repeated query
    rows count once.
    """
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not shape["n"]:
        return
    blocks = max(1, -(-shape["n"] * max(shape["d"], 1) * 8 // query_bytes))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    if blocks > 1:
        dealt = written(dealt, "queries")
    for block in range(blocks):
        got = dealt.where(F.col("block") == block).select("id", "v", "h").distinct().orderBy("id", "v").toArrow()
        if got.num_rows:
            yield [part for batch in got.combine_chunks().to_batches() for part in matrices(batch)]


def matrices(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, ids, names, matrix) for each vector length in a batch (id, v, h)."""
    ids, names = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
    column = batch.column(1)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    out = []
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out.append((d, ids[rows], names[rows], flat[offsets[rows][:, None] + np.arange(d)].reshape(len(rows), d)))
    return out


def repeats(ids: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether each row repeats an earlier one."""
    order = np.lexsort((np.arange(len(ids)), names, ids))
    again = np.zeros(len(ids), bool)
    again[order[1:]] = (ids[order[1:]] == ids[order[:-1]]) & (names[order[1:]] == names[order[:-1]])
    return again


class Best:
    """The ``k`` best candidates of each query, kept as merged sorted heaps; ``sign`` 1 for smallest first, -1 for largest."""

    def __init__(self, n: int, k: int, sign: int, kind: type) -> None:
        self.k, self.sign = k, sign
        self.q = np.empty(0, np.int64)
        self.score = np.empty(0, kind)
        self.ids = np.empty(0, np.int64)
        self.names = np.empty(0, np.int64)
        self.cut = np.full(n, np.inf)  # sign * score of the k-th, or infinite

    def merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, names: np.ndarray) -> None:
        """Add candidates, rows named by id and vector; the same row counts once."""
        if not len(q):
            return
        q, score = np.concatenate((self.q, q)), np.concatenate((self.score, score))
        ids, names = np.concatenate((self.ids, ids)), np.concatenate((self.names, names))
        order = np.lexsort((names, ids, self.sign * score, q))
        q, score, ids, names = q[order], score[order], ids[order], names[order]
        fresh = np.ones(len(q), bool)
        fresh[1:] = (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])
        q, score, ids, names = q[fresh], score[fresh], ids[fresh], names[fresh]
        first = np.searchsorted(q, q, side="left")
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        last = rank == self.k - 1
        self.cut[q[last]] = (self.sign * score[last]).astype(float)
        self.q, self.score, self.ids, self.names = q[keep], score[keep], ids[keep], names[keep]

    def table(self, query_ids: np.ndarray) -> pa.RecordBatch:
        """(query_id, query_row, vec_id, h, score)."""
        cols = [query_ids[self.q], self.q, self.ids, self.names, self.score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "query_row", "vec_id", "h", "score"])
