"""Principal components: the triangle's tree, the range finder, its bound and its seed."""

import numpy as np
import pytest

from popnet.operators import representation
from popnet.operators.representation import principal_components


def table(spark, x, parts=4):
    return spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "cell long, grp string, v array<double>").repartition(parts)


def test_unsettled_components_say_so(spark, monkeypatch):
    cells = table(spark, np.random.default_rng(3).normal(size=(40, 30)))
    monkeypatch.setattr(representation, "FULL", 10)
    monkeypatch.setattr(representation, "ROUNDS", 2)
    found = principal_components(cells, 3)
    assert "not settled" in found.reason and found.error_bound > representation.SETTLED
    monkeypatch.setattr(representation, "ROUNDS", 400)
    assert principal_components(cells, 3).reason == ""


def test_tree_of_triangles(spark, monkeypatch):
    """Ill-conditioned cells over many partitions, some of them empty: as one decomposition of all, to the last digits that doubles hold."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 6)) * np.array([1e6, 1e3, 1.0, 1e-1, 1e-2, 1e-4]) + 5.0
    monkeypatch.setattr(representation, "FAN", 2)
    found = principal_components(table(spark, x, 13), 6)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    got = np.sqrt(np.array(found.ratios) * (s**2).sum())
    assert found.method == "triangle of the matrix" and np.allclose(got, s, rtol=1e-6, atol=1e-9 * s[0])


def test_solver_and_seed_take_effect(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 25)) * 4 + rng.normal(size=(80, 25)) * 0.5
    cells = table(spark, x)
    full = principal_components(cells, 3, solver="full")
    one, again, two = (principal_components(cells, 3, seed=s, solver="randomized") for s in (1, 1, 2))
    assert "range finder, 7 rounds" in one.method or one.error_bound <= representation.SETTLED
    assert one.error_bound != two.error_bound and np.allclose(one.ratios, again.ratios, rtol=1e-12)
    eigen = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert full.ratios == pytest.approx(eigen[:3] / eigen.sum(), rel=1e-10)
    assert np.abs(np.array(one.ratios) * eigen.sum() - eigen[:3]).max() <= max(one.error_bound, 1e-12) * eigen[0]  # within the stated bound
    assert 0 < one.outside < 1
    with pytest.raises(ValueError, match="solver"):
        principal_components(cells, 3, solver="arpack")
