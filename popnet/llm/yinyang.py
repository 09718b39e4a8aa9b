"""Centroid clustering with Yinyang bounds (operator 11).

Components become whole numbers, floor(``SCALE`` * x) in double precision, so distances,
sums and means are exact.  Centroids are put into groups once, by a few rounds of plain
clustering of the centroids themselves.  A vector's row keeps its cluster, an upper bound of
the distance to its centroid and, for each group, a lower bound of the distance to the
group's other centroids.  When centroids move, bounds move by the largest drift; a vector
whose upper bound stays below all lower bounds keeps its cluster (global filter), else the
upper bound is made exact, and only centroids of groups whose bound it reaches (group
filter), and of these only those that their own drift lets come near, are measured exactly.

A round is one narrow pass that writes the rows with their new bounds; the sums of each
cluster are partial sums of a task, added by Spark.  What the driver holds is the centroids
and their sums: k times the number of components, both parameters.

Defined results: vectors that are null, of another length, or with null or non-finite
components (after scaling, too) take no part; rows that repeat are vectors of their own;
ties in distance go to the smaller number; a null id is kept but starts no centroid while
others are there; with fewer vectors than ``k`` there are as many centroids as vectors; an
empty table gives an empty table.  Numbers of any size are exact; a distance or inertia beyond a long
is null.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.llm.shared import released, table, written

K, DIMENSIONS, SCALE, ROUNDS, GROUPS = 16, 64, 64, 3, 4
#: Rows measured at once.
SLICE = 4096
#: Room for rounding in bounds, which are doubles: far above what a few rounds add up to.
SLACK = 1e-12
#: Sums are passed on in signed digits of this base, so that longs can add them.
BASE = 1 << 31
_STATE = "vec_id long, v array<double>, cluster int, upper double, lower array<double>"


@dataclass(frozen=True)
class Centroids:
    """Whole-number centroids, their groups, and how far they moved in the last update (a little more than that)."""

    rows: list[list[int]]
    group: np.ndarray
    drift: np.ndarray


def scaled(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, times ``scale``."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * float(scale))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = (F.size("v") == dimensions) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("v").isNotNull() & fine)


def seeds(rows: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest hashes, in their order."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    got = rows.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return [[int(x) for x in np.floor(r["v"])] for r in got]


def _small(*parts: np.ndarray) -> bool:
    """Whether squared distances of these are exact in doubles."""
    top = max((float(np.abs(p).max(initial=0)) for p in parts), default=0.0)
    d = max(p.shape[-1] for p in parts)
    return top < (2.0**53 / max(d, 1)) ** 0.5 / 2


def grouped(centroids: list[list[int]], groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each centroid, by plain clustering of the centroids; any grouping is right, near ones filter better."""
    c = np.array(centroids, float)
    groups = max(1, min(groups, len(c)))
    means = c[:: max(1, len(c) // groups)][:groups].copy()
    near = np.zeros(len(c), int)
    for _ in range(rounds):
        with np.errstate(all="ignore"):
            near = np.nan_to_num(((c[:, None] - means[None]) ** 2).sum(axis=2), nan=np.inf).argmin(axis=1)
        for g in range(len(means)):
            if (near == g).any():
                means[g] = c[near == g].mean(axis=0)
    return np.unique(near, return_inverse=True)[1]


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids; exact, as ``_small`` bounds every term."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)


def _exactly(x: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """The cluster of each row in whole numbers of any size."""
    near = np.empty(len(x), int)
    for i, row in enumerate(x):
        own = [int(v) for v in row]
        near[i] = min((sum((a - b) ** 2 for a, b in zip(own, r, strict=True)), j) for j, r in enumerate(rows))[1]
    return near


def _first(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bounds of rows without any."""
    centroids, n, groups = np.array(c.rows, float), len(x), int(c.group.max()) + 1
    if not _small(x, centroids):
        return _exactly(x, c.rows), np.full(n, np.inf), np.zeros((n, groups))  # measured anew in each round
    square = _squares(x, centroids)
    near = square.argmin(axis=1)
    far = np.sqrt(square)
    upper = far[np.arange(n), near] * (1 + SLACK)
    far[np.arange(n), near] = np.inf
    lower = np.stack([far[:, c.group == g].min(axis=1) for g in range(groups)], axis=1) * (1 - SLACK)
    return near, upper, lower


def _next(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after the centroids have moved; ``counts`` gets the distances measured."""
    centroids = np.array(c.rows, float)
    n, groups = lower.shape
    if not np.isfinite(upper).all() or not _small(x, centroids):
        return _first(x, c)
    most = np.array([c.drift[c.group == g].max() for g in range(groups)])
    before, near = lower, near.copy()
    upper = (upper + c.drift[near]) * (1 + SLACK)
    lower = (lower - most) * (1 - np.sign(lower - most) * SLACK)
    open_ = np.flatnonzero(upper >= lower.min(axis=1))  # global filter; a tie may go to a smaller number
    measured = len(open_)
    own = ((x[open_] - centroids[near[open_]]) ** 2).sum(axis=1)
    upper[open_] = np.sqrt(own) * (1 + SLACK)
    still = upper[open_] >= lower[open_].min(axis=1)
    open_, own = open_[still], own[still]
    if len(open_):
        was, bound, tight = near[open_].copy(), lower[open_].copy(), upper[open_]
        hit = bound <= tight[:, None]  # group filter
        fresh = np.where(hit, np.inf, bound)  # bounds of groups that are looked into are made anew
        best, who = own.copy(), was.copy()
        seen = np.full((len(open_), len(centroids)), np.inf)
        for j, centre in enumerate(centroids):
            g = c.group[j]
            mine = np.flatnonzero(hit[:, g] & (was != j))
            reach = (before[open_[mine], g] - c.drift[j]) * (1 - SLACK)  # what its own drift lets it come near
            skip = reach > tight[mine]
            fresh[mine[skip], g] = np.minimum(fresh[mine[skip], g], reach[skip])
            mine = mine[~skip]
            square = ((x[open_[mine]] - centre) ** 2).sum(axis=1)
            measured += len(mine)
            seen[mine, j] = np.sqrt(square) * (1 - SLACK)
            better = (square < best[mine]) | ((square == best[mine]) & (j < who[mine]))
            best[mine[better]], who[mine[better]] = square[better], j
        at = np.arange(len(open_))
        seen[at, was] = np.sqrt(own) * (1 - SLACK)
        seen[at, who] = np.inf  # the own centroid is in no lower bound
        for g in range(groups):
            fresh[:, g] = np.minimum(fresh[:, g], seen[:, c.group == g].min(axis=1))
        near[open_], upper[open_], lower[open_] = who, np.sqrt(best) * (1 + SLACK), fresh
    if counts is not None:
        counts += [measured, n * len(centroids)]
    return near, upper, lower


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _state(ids: pa.Array, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
    return pa.RecordBatch.from_arrays([ids, lists(x), pa.array(near, pa.int32()), pa.array(upper), lists(lower)], names=[c.split()[0] for c in _STATE.split(", ")])


def assigned(rows: DataFrame, c: Centroids, first: bool) -> DataFrame:
    """The rows with their cluster and bounds, from scratch (``rows`` are vectors) or from the state of the round before."""
    held = rows.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            if first:
                x = np.floor(_vectors(batch.column(1), batch.num_rows))
                yield _state(batch.column(0), x, *_first(x, held.value))
            else:
                x, lower = _vectors(batch.column(1), batch.num_rows), _vectors(batch.column(4), batch.num_rows)
                near, upper = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                yield _state(batch.column(0), x, *_next(x, near.astype(int), upper, lower, held.value))

    return rows.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sums of each cluster that isn't empty: partial sums of the tasks, added by Spark digit by digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dimensions), object), np.zeros(k, np.int64)
        for batch in _slices(batches):
            near, x = batch.column(0).to_numpy(), _vectors(batch.column(1), batch.num_rows)
            n += np.bincount(near, minlength=k)
            fast = np.abs(x).max(initial=0) * len(x) < 2.0**53
            for j in np.unique(near):
                some = x[near == j]
                total[j] += [int(s) for s in some.sum(axis=0)] if fast else [sum(map(int, col)) for col in some.T]
        out = [(j, -1, 0, int(n[j])) for j in np.flatnonzero(n)]
        for j in np.flatnonzero(n):
            for d, value in enumerate(total[j]):
                digit, rest, sign = 0, abs(value), -1 if value < 0 else 1
                while rest:
                    out.append((j, d, digit, sign * (rest % BASE)))
                    digit, rest = digit + 1, rest // BASE
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["cluster", "dim", "digit", "s"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, dim int, digit int, s long")
    out: dict[int, list] = {}
    found = parts.groupBy("cluster", "dim", "digit").agg(F.sum("s").alias("s")).collect()  # k times dimensions times a few digits
    for r in found:
        out.setdefault(r["cluster"], [0, [0] * dimensions])
        if r["dim"] < 0:
            out[r["cluster"]][0] = r["s"]
        else:
            out[r["cluster"]][1][r["dim"]] += r["s"] * BASE ** r["digit"]
    return {j: (n, s) for j, (n, s) in out.items()}


def moved(c: Centroids, sums: dict[int, tuple[int, list[int]]]) -> Centroids:
    """Each centroid that isn't empty at floor(sum / count) of its vectors."""
    rows = [[s // sums[j][0] for s in sums[j][1]] if j in sums else r for j, r in enumerate(c.rows)]
    squares = [sum((a - b) ** 2 for a, b in zip(new, old, strict=True)) for new, old in zip(rows, c.rows, strict=True)]
    return Centroids(rows, c.group, np.array([s**0.5 * (1 + SLACK) if s < 1 << 1000 else np.inf for s in squares]))


def _measured(state: DataFrame, c: Centroids) -> DataFrame:
    """(vec_id, cluster, distance): squared, exact, null beyond a long."""
    held = state.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x, near = _vectors(batch.column(1), batch.num_rows), batch.column(2).to_numpy()
            centres = np.array(held.value.rows, float)
            if _small(x, centres):
                far = pa.array(((x - centres[near]) ** 2).sum(axis=1).astype(np.int64))
            else:
                whole = [sum((int(a) - b) ** 2 for a, b in zip(row, held.value.rows[j], strict=True)) for row, j in zip(x, near, strict=True)]
                far = pa.array([d if d < 1 << 63 else None for d in whole], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), far], names=["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, groups: int = GROUPS, dimensions: int = DIMENSIONS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, Centroids | None]:
    """(vec_id, cluster, distance) of each vector after ``rounds`` rounds and a last assignment, and the centroids (None without vectors)."""
    rows = scaled(vectors, id_col, vector_col, dimensions, scale)
    found = seeds(rows, k)
    if not found:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), None
    group = grouped(found, groups)
    c = Centroids(found, group, np.zeros(len(found)))
    state = written(assigned(rows, c, True), "clusters")
    for at in range(rounds):
        c = moved(c, _sums(state, len(found), dimensions))
        last, state = state, assigned(state, c, False)
        if at < rounds - 1:
            state = written(state, "clusters")
            released(last)
    return written(_measured(state, c), "clustered"), c


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster, with the inertia and the digest of its final centroid."""
    found, c = clustered(table(spark, sf_dir, "embeddings"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), (F.count("*") == F.count("distance")).alias("fits")).collect()  # k rows
    long = lambda s, fits: int(s) if fits and s < 1 << 63 else None
    total = long(sum(r["s"] or 0 for r in sums), all(r["fits"] for r in sums))
    rows = [(r["cluster"], long(r["s"] or 0, r["fits"]), total, sha256(",".join(map(str, c.rows[r["cluster"]])).encode()).hexdigest()) for r in sums]
    by_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sql() -> str:
    """The rounds one after another, every vector measured against every centroid."""
    near = """
near{n} AS MATERIALIZED (
  SELECT rowid_, vec_id, v, cluster, distance FROM (
    SELECT k.rowid_, k.vec_id, k.v, c.j AS cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM kept k CROSS JOIN centre{n} c
  ) QUALIFY row_number() OVER (PARTITION BY rowid_ ORDER BY distance, cluster) = 1
)"""
    centre = """
sum{n} AS (
  SELECT cluster, d, sum(v[d]) AS s, count(*) AS c FROM near{m} CROSS JOIN range(1, 65) t(d) GROUP BY cluster, d
), mean{n} AS (
  SELECT cluster, list((s - ((s % c) + c) % c) // c ORDER BY d) AS v FROM sum{n} GROUP BY cluster
), centre{n} AS MATERIALIZED (
  SELECT o.j, coalesce(m.v, o.v) AS v FROM centre{m} o LEFT JOIN mean{n} m ON m.cluster = o.j
)"""
    steps = [near.format(n=0)]
    for n in range(1, ROUNDS + 1):
        steps += [centre.format(n=n, m=n - 1), near.format(n=n)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rowid_, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), seeded AS (
  SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j FROM kept
), centre0 AS MATERIALIZED (SELECT j, v FROM seeded WHERE j < {K}),{",".join(steps)},
final AS (SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance FROM near{ROUNDS})
SELECT f.vec_id, f.cluster, f.distance, CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(f.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM final f JOIN centre{ROUNDS} c ON c.j = f.cluster
"""
