"""Exact top-k inner products by a three-phase uniform threshold (operator 6).

After Cao and Wang's TPUT (2004).  A vector's components are cut into ``lists`` blocks of
dimensions; a block's partial inner product with a query is that list's local score, and
the product of the two blocks' lengths bounds it.  A list is ordered by its blocks'
lengths, so by that bound, for all queries at once.

1. Every task reads the heads of its lists (``HEAD`` rows of each) and gathers the k
   highest scores of each query among them.  The k-th highest of all tasks is a bound of
   the k-th score; divided by the number of lists, it is a safe cutoff: a row below it in
   every list can't reach the bound.
2. Bounds and cutoffs are broadcast.  A task reads its lists down to the cutoff: rows that
   are below it in every list, for every query of the block, are not multiplied.  The
   others' local scores are summed in single or double precision, whose rounding is bounded
   too, and pairs that reach the bound (that of phase 1 or the task's own k-th score) are
   collected.
3. Collected pairs are resolved exactly, at once, where they are: their products are
   computed in whole numbers and merged into the task's heaps.

All lists of a row lie in its task, so a phase shuffles k entries a query and task at most,
and each pair is multiplied once at most, but for the heads.  Queries come in blocks of
bounded bytes.

Vectors are integers floor(multiplier * x).  A pair is resolved in doubles where its sum is
under 2^52, else in Python integers; a score that doesn't fit 64 bits is held at the nearest
value that does.

Defined cases: vectors null or with null or non-finite components take no part, nor rows
with a null id; vectors of another length than the query's are no candidates of it (an
empty vector has score 0 with other empty ones); ties go to the smaller id; a repeated row
(id and vector) counts once, different vectors under one id are candidates of their own;
the query's own id is no candidate; no queries give an empty table; further columns,
whatever their names, are ignored; a vector of any length is taken whole (a block holds one
query at least).
"""

from __future__ import annotations

import fractions
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from popnet.llm.shared import table, written
from popnet.llm.vectors import TILE, Best, matrices, query_blocks, repeats, usable

K = 10
LISTS = 4
MULTIPLIER = 1024
#: Rows of each list that a task reads for the first bound.
HEAD = 256
_LONG = (-(1 << 63), (1 << 63) - 1)
RESULT = "query_id long, query_row long, vec_id long, h long, score long"


def whole(x: np.ndarray, multiplier: int = MULTIPLIER) -> np.ndarray:
    """floor(multiplier * x) as doubles with whole values; infinite where that leaves the range."""
    with np.errstate(over="ignore"):
        return np.floor(x * multiplier)


def _integers(v: np.ndarray, multiplier: int = MULTIPLIER) -> list[int]:
    return [math.floor(fractions.Fraction(c) * multiplier) for c in v.tolist()]


def _cuts(d: int, lists: int) -> list[tuple[int, int]]:
    edges = [round(d * i / lists) for i in range(lists + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a] or [(0, d)]


def lengths(x: np.ndarray, lists: int) -> np.ndarray:
    """Each block's length (rows by lists), rounded up; infinite where it leaves the range."""
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt((x[:, a:b] ** 2).sum(axis=1)) for a, b in _cuts(x.shape[1], lists)], axis=1) * (1 + 1e-12)


class Rows:
    """Rows of one dimension: ids, names, original vectors, whole vectors and their blocks' lengths."""

    def __init__(self, ids: np.ndarray, names: np.ndarray, v: np.ndarray, lists: int, known: tuple | None = None) -> None:
        self.ids, self.names, self.v, self.lists = ids, names, v, lists
        self.x, self.long = known or (whole(v), None)
        if self.long is None:
            self.long = lengths(self.x, lists)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.ids[at], self.names[at], self.v[at], self.lists, (self.x[at], self.long[at]))

    def joined(self, other: Rows) -> Rows:
        both = lambda a, b: np.concatenate((a, b))
        return Rows(both(self.ids, other.ids), both(self.names, other.names), both(self.v, other.v), self.lists, (both(self.x, other.x), both(self.long, other.long)))


class Block:
    """A block of queries: parts of at most TILE rows of one dimension, and the bounds known so far."""

    def __init__(self, block: list, lists: int) -> None:
        self.parts: list[tuple[int, int, Rows]] = []
        self.n, self.lists = 0, lists
        for d, ids, names, v in block:
            for at in range(0, len(ids), TILE):
                part = Rows(ids[at : at + TILE], names[at : at + TILE], v[at : at + TILE], lists)
                self.parts.append((d, self.n, part))
                self.n += len(part.ids)
        self.ids = np.concatenate([p.ids for _, _, p in self.parts])
        self.bound = np.full(self.n, -np.inf)  # of a score


def sums(q: Rows, x: Rows) -> tuple[np.ndarray, np.ndarray]:
    """(scores, errors) of all pairs: the local scores' sums, and how far off they may be at most."""
    with np.errstate(all="ignore"):
        size = np.linalg.norm(q.long, axis=1)[:, None] * np.linalg.norm(x.long, axis=1)[None, :]
        top = size.max(initial=0.0)
        kind = np.float32 if top < 1e30 and max(np.abs(q.x).max(initial=0), np.abs(x.x).max(initial=0)) < 1e30 else np.float64
        score = (q.x.astype(kind) @ x.x.astype(kind).T).astype(float)
        # rounding of the components, of the products and of their sum
        error = size * (4 * (q.x.shape[1] + 4) * np.finfo(kind).eps)
    odd = ~np.isfinite(score) | ~np.isfinite(error)
    score[odd], error[odd] = 0.0, np.inf
    return score, error


def resolved(q: Rows, x: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact scores of pairs, as 64-bit integers."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    top = lambda m: np.abs(m).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        fits = top(q.x)[i] * top(x.x)[j] * max(1, q.x.shape[1]) < 1 << 52
    out[fits] = np.einsum("ij,ij->i", q.x[i[fits]], x.x[j[fits]]).astype(np.int64)
    for k in np.flatnonzero(~fits).tolist():
        exact = sum(a * b for a, b in zip(_integers(q.v[i[k]]), _integers(x.v[j[k]]), strict=True))
        out[k] = min(max(exact, _LONG[0]), _LONG[1])
    return out


def _merge(best: Best, base: int, q: Rows, x: Rows, i: np.ndarray, j: np.ndarray) -> None:
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        best.merge(a + base, resolved(q, x, a, b), x.ids[b], x.names[b])


def gather(batches: Iterator[pa.RecordBatch], block: Block, k: int, head: int = HEAD) -> Best:
    """Phase 1: the k highest scores of each query among the heads of this task's lists."""
    heads: dict[int, Rows] = {}
    for batch in batches:
        for d, ids, names, v in matrices(batch):
            rows = Rows(ids, names, v, block.lists)
            if d in heads:
                rows = heads[d].joined(rows)
            rows = rows.take(np.flatnonzero(~repeats(rows.ids, rows.names)))
            if len(rows.ids) > head:
                first = [np.argpartition(-rows.long[:, c], head - 1)[:head] for c in range(rows.long.shape[1])]
                rows = rows.take(np.unique(np.concatenate(first)))
            heads[d] = rows
    best = Best(block.n, k, -1, np.int64)
    for d, base, q in block.parts:
        if d in heads:
            x = heads[d]
            score, _ = sums(q, x)
            score[q.ids[:, None] == x.ids[None, :]] = -np.inf
            some = min(k, score.shape[1])
            j = np.argpartition(-score, some - 1, axis=1)[:, :some].ravel()
            i = np.repeat(np.arange(len(q.ids)), some)
            fine = score[i, j] > -np.inf
            _merge(best, base, q, x, i[fine], j[fine])
    return best


def collect(batches: Iterator[pa.RecordBatch], block: Block, k: int, counted: dict | None = None) -> Best:
    """Phases 2 and 3: this task's k highest scores of each query, of the pairs that reach the bound.

    ``counted`` is told the pairs there are, those multiplied and those resolved.
    """
    best = Best(block.n, k, -1, np.int64)
    for batch in batches:
        for d, ids, names, v in matrices(batch):
            for at in range(0, len(ids), TILE):
                tile = Rows(ids[at : at + TILE], names[at : at + TILE], v[at : at + TILE], block.lists)
                for dim, base, q in block.parts:
                    if dim != d:
                        continue
                    bound = np.maximum(block.bound[base : base + len(q.ids)], -best.cut[base : base + len(q.ids)])
                    bound = bound - np.abs(np.where(np.isfinite(bound), bound, 0)) * 1e-15  # heaps' scores as doubles
                    # each list is read down to the cutoff of the query that reads furthest
                    with np.errstate(all="ignore"):
                        reach = np.stack([(bound / q.long.shape[1]) / q.long[:, c] for c in range(q.long.shape[1])], axis=1)
                    reach[(bound <= 0) | np.isnan(bound)] = 0
                    reach[np.isnan(reach)] = 0
                    x = tile.take(np.flatnonzero((tile.long >= reach.min(axis=0)).any(axis=1)))
                    if counted is not None:
                        counted["pairs"] = counted.get("pairs", 0) + len(q.ids) * len(tile.ids)
                        counted["multiplied"] = counted.get("multiplied", 0) + len(q.ids) * len(x.ids)
                    if not len(x.ids):
                        continue
                    score, error = sums(q, x)
                    own = q.ids[:, None] == x.ids[None, :]
                    if len(x.ids) > 4 * k:  # the tile's own bound, of k different rows
                        low = np.where(own | repeats(x.ids, x.names)[None, :], -np.inf, score - error)
                        bound = np.maximum(bound, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
                    i, j = np.nonzero((score + error >= bound[:, None]) & ~own)
                    if counted is not None:
                        counted["resolved"] = counted.get("resolved", 0) + len(i)
                    _merge(best, base, q, x, i, j)
    return best


def _bounds(rows: DataFrame, n: int, k: int) -> np.ndarray:
    """The k-th highest score of each query row of a block, minus infinity with fewer: at most one number a query."""
    w = Window.partitionBy("query_row").orderBy(F.desc("score"))
    got = rows.withColumn("at", F.row_number().over(w)).where(F.col("at") == k).select("query_row", "score").toArrow()
    out = np.full(n, -np.inf)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def top_products(vectors: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each row of ``queries``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, nonzero=False)
    stated = usable(queries, id_col, vector_col, nonzero=False)
    found: DataFrame | None = None
    for raw in query_blocks(stated):
        block = Block(raw, lists)
        held = spark.sparkContext.broadcast(block)
        leads = rows.mapInArrow(lambda it, held=held: iter([gather(it, held.value, k).table(held.value.ids)]), RESULT).distinct()
        block.bound = _bounds(leads, block.n, k)
        held = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(lambda it, held=held: iter([collect(it, held.value, k).table(held.value.ids)]), RESULT).distinct()
        w = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "h")
        part = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        part = written(part, "topk")  # a block's rows are found once
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of each row whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_products(rows, rows.where(F.col("vec_id") % 100 == 0))


#: All products in DuckDB: a stated query set against all rows.
OP6_SQL = """
WITH fine AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_inner_product(q.v, c.v), 0) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
