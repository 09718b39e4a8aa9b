"""Centroid clustering against plain exact rounds."""

from hashlib import sha256
from math import floor, isfinite

import numpy as np

from popnet.llm import yinyang

SCHEMA = "vec_id long, embedding array<double>, v string, cluster int, distance long, upper double, lower double"


def brute(rows, k, rounds, d, scale):
    kept = [(i, [floor(float(scale) * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and isfinite(float(scale) * x) for x in v)]
    name = lambda r: (r[0] is None, sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        clusters = {}
        for _, v in kept:
            clusters.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(clusters[j]) for x in zip(*clusters[j], strict=True)] if j in clusters else c for j, c in enumerate(centroids)]
    return sorted([(i, near(v)[1], near(v)[0] if near(v)[0] < 1 << 63 else None) for i, v in kept], key=repr), centroids


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 0.5, 0.5) for i, v in rows], SCHEMA)


def same(spark, rows, k, rounds, d, scale=64):
    found, c = yinyang.clustered(table(spark, rows), k, rounds, 3, d, scale)
    want, centroids = brute(rows, k, rounds, d, scale)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == want and c.rows == centroids


def test_plain_rounds(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(9, 6))
    rows = [(i, (middle[i % 9] + rng.normal(size=6) * 0.1).tolist()) for i in range(900)]
    odd = [
        (None, [0.1] * 6), (None, [0.1] * 6), (5, None), (6, []), (7, [1.0] * 5), (8, [None] + [1.0] * 5), (9, [float("nan")] * 6), (10, [float("inf")] * 6),
        rows[3], rows[3], (11, rows[3][1]), (12, [0.0] * 6), (13, [-0.001] * 6), (14, [0.001] * 6),
    ]
    same(spark, rows + odd, 16, 5, 6)
    same(spark, [(i, [float(i % 3), float(i % 2)]) for i in range(60)], 8, 3, 2, 1)  # ties everywhere


def test_numbers_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 10.0 ** (i % 4 * 12)).tolist()) for i in range(80)]
    same(spark, rows, 5, 3, 3)
    same(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1.0, 1.0]), (4, [1e306, 1e308])], 2, 3, 2)


def test_few_vectors(spark):
    found, c = yinyang.clustered(table(spark, [(1, None)]), 4, 2, 3, 2)
    assert found.collect() == [] and c is None
    same(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], 4, 2, 2)


def test_bounds_spare_distances():
    """Vectors near their centroids keep them without being measured."""
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(16, 8)) * 100
    x = np.floor(middle[np.arange(2000) % 16] + rng.normal(size=(2000, 8)))
    start = yinyang.Centroids(np.floor(middle).astype(int).tolist(), yinyang.grouped(middle.tolist(), 4), np.zeros(16))
    near, upper, lower = yinyang._first(x, start)
    sums = {j: (int((near == j).sum()), [int(s) for s in x[near == j].sum(axis=0)]) for j in range(16)}
    after = yinyang.moved(start, sums)
    counts = np.zeros(2, int)
    again = yinyang._next(x, near, upper, lower, after, counts)[0]
    assert counts[0] < counts[1] / 10 and (again == yinyang._squares(x, np.array(after.rows, float)).argmin(axis=1)).all()


def test_query(spark):
    rows = yinyang.op11_yinyang(spark, "/root/testdata/sf0.001").collect()
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, centroids = brute(given, 16, 3, 64, 64)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in rows) == sorted(want)
    assert {r["inertia"] for r in rows} == {sum(w[2] for w in want)}
    assert {(r["cluster"], r["centroid_sha256"]) for r in rows} == {(j, sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for _, j, _ in want}
