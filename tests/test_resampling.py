"""Bootstrap intervals against resampled copies, and nested subsets."""

import hashlib
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from popnet.operators.resampling import HEX, MOST, bootstrap, nested


def draws(seed, row, replicate):
    u = int(hashlib.sha256(f"{seed}:{row}:{replicate}".encode()).hexdigest()[:HEX], 16) / 16**HEX
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(MOST)])
    return int((u >= steps).sum())


def test_interval_of_resampled_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(g, f"r{g}{i}", float(np.round(rng.lognormal(), 2))) for g in range(3) for i in range((40, 7, 1)[g])]
    got = {r["g"]: r for r in bootstrap(spark.createDataFrame(rows, "g int, row string, x double").repartition(3), ["g"], "row", "x", replicates=60, level=0.9, seed=4).collect()}
    for g in range(3):
        own = [(row, x) for k, row, x in rows if k == g]
        medians = [np.median(s) for b in range(60) if (s := [x for row, x in own for _ in range(draws(4, row, b))])]
        assert got[g]["estimate"] == pytest.approx(np.median([x for _, x in own]))
        assert [got[g]["low"], got[g]["high"]] == pytest.approx(np.quantile(medians, [0.05, 0.95]))
    counts = [draws(4, "a", b) for b in range(20_000)]
    assert np.mean(counts) == pytest.approx(1, abs=0.03) and np.var(counts) == pytest.approx(1, abs=0.05)


def test_subsets_lie_inside_each_other(spark):
    names = spark.createDataFrame([(f"g{i}",) for i in range(50)] + [("g1",)], "target string")
    by = lambda *sizes, seed=1: {k: {r["target"] for r in nested(names, "target", list(sizes), seed).where(f"size = {k}").collect()} for k in sizes}
    got = by(5, 20, 80)
    assert got[5] < got[20] < got[80] and [len(got[k]) for k in (5, 20, 80)] == [5, 20, 50]
    assert by(5) == {5: got[5]} != by(5, seed=2)
    with pytest.raises(ValueError, match="positive"):
        nested(names, "target", [0])


def test_a_row_is_hashed_twice_at_most_and_by_several_tasks(spark, monkeypatch):
    from popnet.operators import resampling

    seen = []
    monkeypatch.setattr(resampling, "exact_quantiles", lambda df, keys, *a: seen.append(df) or df.select(*keys, F.lit(0.0).alias("q")))
    rows = spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("row"), F.col("id").cast("double").alias("x")).coalesce(1)
    bootstrap(rows, ["g"], "row", "x", replicates=5)
    counted = seen[0]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert [line.count("sha2(") for line in plan.splitlines() if "Filter" in line and "sha2(" in line] == [1]
    assert counted.rdd.getNumPartitions() > 1
