"""Nearest neighbours and exact top-k against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from popnet.llm import ann, topk
from popnet.llm.vectors import Best, query_blocks, usable

SCHEMA = "vec_id long, embedding array<float>, score double, rank int, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, 9, "x") for i, v in rows], SCHEMA)


def fine(v, zero_ok):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero_ok or any(x != 0 for x in v))


def brute(rows, score, best_first, zero_ok, k=10):
    some = {(i, tuple(v)) for i, v in rows if i is not None and fine(v, zero_ok)}
    out = []
    for qid, q in some:
        if qid % 100 == 0:
            found = sorted({(best_first * score(q, c), i, tuple(c)) for i, c in some if i != qid and len(c) == len(q)})
            out += [(qid, n + 1, i, best_first * s) for n, (s, i, _) in enumerate(found[:k])]
    return sorted(out)


def messy(rng, n=1500, d=7):
    base = rng.normal(size=(12, d))
    rows = [(i, np.float32(base[i % 12] + rng.normal(size=d) * 0.05).tolist()) for i in range(n)]
    rows[5] = (5, rows[100][1])  # copies, so ties
    rows[6] = (6, rows[100][1])
    rows[7] = (7, None)
    rows[8] = (8, [0.0] * d)
    rows[9] = (9, [float("nan")] + [1.0] * (d - 1))
    rows[10] = (10, [None] + [1.0] * (d - 1))
    rows[11] = (11, [float("inf")] * d)
    rows[12] = (12, [1.0, 2.0])
    rows[200] = (200, [3.0, 4.0])
    rows[300] = (300, None)
    rows[400] = (400, [0.0] * d)
    return [*rows, (None, [1.0] * d), rows[100], rows[21], (13, []), (14, rows[15][1]), (14, rows[16][1]), (17, [-x for x in rows[18][1]])]


def euclidean(q, c):
    total = 0.0
    for a, b in zip(q, c, strict=True):
        total += (a - b) * (a - b)
    return total**0.5


def product(q, c):
    whole = lambda v: [int(np.floor(1024 * float(x))) for x in v]
    return sum(a * b for a, b in zip(whole(q), whole(c), strict=True))


def collected(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_nearest_equals_brute_force(spark):
    rows = messy(np.random.default_rng(1))
    t = table(spark, rows).repartition(3)
    got = collected(ann.nearest(t, t.where("vec_id % 100 = 0")))
    assert got == brute(rows, euclidean, 1, False)


def test_products_equal_brute_force(spark):
    rows = messy(np.random.default_rng(2))
    t = table(spark, rows).repartition(3)
    assert collected(topk.top_products(t, t.where("vec_id % 100 = 0"))) == brute(rows, product, -1, True)


def test_blocks_of_queries_change_nothing(spark):
    rows = messy(np.random.default_rng(3), 700)
    t = table(spark, rows)
    q = usable(t.where("vec_id % 100 = 0"), "vec_id", "embedding", True)
    assert len(list(query_blocks(q, 100))) > 1 and sum(len(i) for b in query_blocks(q, 100) for _, i, _, _ in b) == 5


def test_few_candidates_and_none(spark):
    t = table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])])
    assert collected(ann.nearest(t, t.where("vec_id = 0"))) == [(0, 1, 2, 0.0), (0, 2, 1, 2**0.5)]
    assert collected(topk.top_products(t, t.where("vec_id = 0"))) == [(0, 1, 2, 1024 * 1024), (0, 2, 1, 0)]
    for f in (ann.nearest, topk.top_products):
        assert f(t, t.where("false")).count() == 0 and f(t.where("false"), t.where("vec_id = 0")).count() == 0
        assert f(t.where("vec_id = 0"), t.where("vec_id = 0")).count() == 0


def test_extreme_components(spark):
    rows = [(0, [3e38, 0.0]), (1, [-3e38, 1e-30]), (2, [1e-40, 1e-40]), (3, [1.0, 1.0]), (100, [1e30, 1e30]), (4, [1e30, 0.5])]
    t = table(spark, rows)
    as_f = [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
    got = collected(ann.nearest(t, t.where("vec_id % 100 = 0")))
    want = brute(as_f, lambda a, b: float(np.hypot(*(np.array(a) - np.array(b)))), 1, False)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    clip = lambda q, c: min(max(product(q, c), -(1 << 63)), (1 << 63) - 1)
    assert collected(topk.top_products(t, t.where("vec_id % 100 = 0"))) == brute(as_f, clip, -1, True)


def blocks_of(rows):
    """Arrow batches as a task gets them."""
    ids, v = [r[0] for r in rows], [r[1] for r in rows]
    for at in range(0, len(rows), 500):
        part = v[at : at + 500]
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 500], pa.int64()), pa.array(part, pa.list_(pa.float64())), pa.array([hash(tuple(x)) for x in part], pa.int64())], names=["id", "v", "h"])


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_products_are_pruned(spread):
    """Each pair is multiplied once at most, fewer where lengths differ, and few are resolved; the first phase reads heads alone."""
    rng = np.random.default_rng(12)
    n = 6000
    v = rng.normal(size=(n, 16)) * np.exp(spread * rng.normal(size=(n, 1)))
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    block = topk.Block([(16, np.arange(0, n, 100), np.arange(0, n, 100), v[::100])], topk.LISTS)
    leads = topk.gather(blocks_of(rows), block, 10)
    block.bound = -leads.cut
    assert np.isfinite(block.bound).all()
    counted = {}
    best = topk.collect(blocks_of(rows), block, 10, counted)
    assert counted["pairs"] == n * 60 and counted["multiplied"] <= counted["pairs"] * (0.8 if spread else 1) and counted["resolved"] < 0.02 * counted["pairs"]
    got = sorted((q * 100, i, s) for q, i, s in zip(best.q.tolist(), best.ids.tolist(), best.score.tolist(), strict=True))
    assert got == sorted((q, i, s) for q, _, i, s in brute(rows, product, -1, True))


def test_large_whole_numbers(spark):
    """Components whose products leave the doubles' exact range, beside ordinary ones."""
    rng = np.random.default_rng(14)
    rows = [(i, np.float32(rng.normal(size=5) * (1e9 if i % 7 == 0 else 1.0)).tolist()) for i in range(400)]
    t = table(spark, rows)
    clip = lambda q, c: min(max(product(q, c), -(1 << 63)), (1 << 63) - 1)
    assert collected(topk.top_products(t, t.where("vec_id % 100 = 0"))) == brute(rows, clip, -1, True)


def test_quantisation_bound():
    x = np.random.default_rng(4).normal(size=(200, 33)) * np.logspace(-200, 200, 200)[:, None]
    codes, scale, error = ann.quantised(x)
    rest = np.abs(x - codes.astype(float) * scale[:, None])
    assert codes.dtype == np.int8 and (rest.max(axis=1) <= error * (1 + 1e-9)).all()


def test_heaps_keep_ties_and_drop_repeats():
    b = Best(2, 2, 1, float)
    b.merge(np.array([0, 0, 0, 1]), np.array([1.0, 1.0, 1.0, 5.0]), np.array([9, 3, 3, 1]), np.array([0, 0, 0, 0]))
    b.merge(np.array([0, 0]), np.array([1.0, 0.5]), np.array([2, 7]), np.array([0, 0]))
    assert b.q.tolist() == [0, 0, 1] and b.ids.tolist() == [7, 2, 1] and b.cut[0] == 1.0 and np.isinf(b.cut[1])
