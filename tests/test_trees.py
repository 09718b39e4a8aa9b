"""The tree engine and the model operators: invariants, planted regulators, prefixes, screening."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popnet.operators import forest, screening
from popnet.operators.representation import principal_components
from popnet.operators.trees import ForestParams, fit, grow, n_features, prefixes, task_seed


@pytest.fixture(scope="module")
def two_programs():
    """A target that follows the first regulator in the first half of the cells and the second one in the other; the third doesn't vary."""
    rng = np.random.default_rng(2024)
    both = rng.uniform(-1, 1, size=(120, 2))
    half = (np.arange(120) >= 60).astype(int)
    target = 3 * both[np.arange(120), half] + rng.uniform(-0.1, 0.1, size=120)
    return np.column_stack([both, np.full(120, -1.5)]), target


@pytest.mark.parametrize("method", ["extra-trees", "random-forest"])
def test_planted_regulators(two_programs, method):
    x, g = two_programs
    first = np.where(np.arange(120) < 60, 1.0, 0.0)
    p = ForestParams(method, n_estimators=80, max_features=1.0, min_weight_fraction_leaf=0.0)
    one, two = fit(x, g, first, p, 5).importances, fit(x, g, 1 - first, p, 5).importances
    assert one[0] > 0.9 and two[1] > 0.9 and one[2] == two[2] == 0
    assert one.sum() == pytest.approx(1)


@pytest.mark.parametrize("method", ["extra-trees", "random-forest"])
def test_prefixes_equal_independent_fits(two_programs, method):
    x, g = two_programs
    w = np.ones(120)
    parts = list(prefixes(x, g, w, ForestParams(method), 9, (3, 8, 20)))
    for k, part in zip((3, 8, 20), parts, strict=True):
        alone = fit(x, g, w, ForestParams(method, n_estimators=k), 9)
        assert np.array_equal(alone.importances, part.importances) and len(part.shapes) == k


def test_limits_of_growth(two_programs):
    x, g = two_programs
    w = np.ones(120)
    deep = grow(x.astype(np.float32), g, w, ForestParams(max_depth=2, min_weight_fraction_leaf=0.0), np.random.default_rng(1))
    assert deep.depth <= 2 and deep.leaves <= 4 and deep.nodes == 2 * deep.leaves - 1
    wide = grow(x.astype(np.float32), g, w, ForestParams(min_weight_fraction_leaf=0.5), np.random.default_rng(1))
    assert wide.leaves <= 2
    scaled = fit(x, g, w * 1e-3, ForestParams(n_estimators=5), 3).importances
    assert scaled == pytest.approx(fit(x, g, w, ForestParams(n_estimators=5), 3).importances, abs=1e-9)


def test_feature_rules_and_seeds():
    assert [n_features(r, 10) for r in ("sqrt", "log2", 1, 1.0, 0.5, 99)] == [3, 3, 1, 10, 5, 10]
    assert task_seed(1, "A", "G") == task_seed(1, "A", "G") != task_seed(1, "G", "A")


def _models(spark, y, groups=("A",)):
    return spark.createDataFrame([(g, t, v) for g in groups for t, v in y.items()], "target_group string, target string, y array<double>")


def test_statuses_and_edges(spark):
    x = np.array([[0, 7, 3], [1, 7, 1], [2, 7, 4], [3, 7, 2]], np.float32)
    shared = forest.Shared(["L", "K", "R"], x, {"A": np.ones(4), "B": np.array([1.0, 0, 0, 0])})
    y = {"T": [1.0, 4.0, 2.0, 8.0], "C": [2.0] * 4, "L": [0.0, 1.0, 2.0, 3.0]}
    p = ForestParams(n_estimators=20, min_samples_leaf=1, min_weight_fraction_leaf=0.0)
    got = {(r["target_group"], r["target"]): r for r in forest.fit_models(_models(spark, y, ("A", "B")), shared, p).collect()}
    assert got["A", "T"]["status"] == "trained" and {e["source"] for e in got["A", "T"]["edges"]} == {"L", "R"}
    assert got["A", "T"]["constant_predictors"] == ["K"] and got["A", "T"]["importance_sum"] == pytest.approx(1)
    assert got["A", "C"]["status"] == "constant_target" and got["B", "C"]["status"] == "insufficient_positive_weight_samples"
    assert {e["source"] for e in got["A", "L"]["edges"]} == {"R"} and got["A", "L"]["discarded_predictors"] == ["L", "K"]
    only = forest.Shared(["L"], x[:, :1], {"A": np.ones(4)})
    assert forest.fit_models(_models(spark, {"L": y["L"]}), only, p).first()["status"] == "no_predictors_after_self_exclusion"
    const = forest.Shared(["K"], x[:, 1:2], {"A": np.ones(4)})
    assert forest.fit_models(_models(spark, {"T": y["T"]}), const, p).first()["status"] == "no_variable_predictors"


def test_mapped_files_equal_matrices_in_memory(spark, two_programs):
    x, g = two_programs
    names = ["P", "Q", "K"]
    y = {"G": g.tolist(), "H": (g * g).tolist(), "P": x[:, 0].tolist()}
    vectors = spark.createDataFrame([(n, x[:, i].tolist()) for i, n in enumerate(names)] + [(n, v) for n, v in y.items() if n != "P"], "gene string, y array<double>")
    w = spark.createDataFrame([(k, i, 1.0 if (i < 60) == (k == "A") else 0.25) for k in "AB" for i in range(120)], "target_group string, cell_ord int, final_weight double")
    shared = forest.share(vectors, names, w, 120)
    p = ForestParams(n_estimators=4)
    a = forest.fit_models(_models(spark, y, ("A", "B")), shared, p).drop("fit_seconds").orderBy("target_group", "target").collect()
    held = forest.Shared(names, x[:, :3].astype(np.float32), {k: np.array([1.0 if (i < 60) == (k == "A") else 0.25 for i in range(120)]) for k in "AB"})
    b = forest.fit_models(_models(spark, y, ("A", "B")), held, p).drop("fit_seconds").orderBy("target_group", "target").collect()
    wanted = spark.createDataFrame([(k, t) for k in "AB" for t in y], "target_group string, target string")
    c = forest.fit_models(forest.by_target(wanted, vectors), shared, p).drop("fit_seconds").orderBy("target_group", "target").collect()
    assert a == b == c and len(shared.x) > 0 and shared.groups == ["A", "B"]
    stats = forest.statistics(forest.fit_models(_models(spark, y), shared, p)).first()
    assert stats["models"] == 3 and stats["failed"] == 0
    e = forest.edges(forest.fit_models(_models(spark, y), shared, p))
    assert e.where("source = target").isEmpty() and e.columns == ["source", "target", "score", "sign", "evidence", "context"]


def test_screening(spark):
    x = spark.createDataFrame([(g, c, v) for g, vs in {"T1": [1.0, 1.0, 2.0], "T2": [1.0, 2.0, 3.0], "G": [5.0, 5.0, 6.0]}.items() for c, v in zip("abc", vs, strict=True)], "gene string, cell string, x double")
    pos = spark.createDataFrame([("A", "a"), ("A", "b"), ("B", "a"), ("B", "b"), ("B", "c"), ("C", "a")], "target_group string, cell string")
    tfs = spark.createDataFrame([("T1", 0), ("T2", 1)], "gene string, ord int")
    spread = screening.ranges(x, pos)
    const = screening.constant_predictors(spread, tfs)
    assert {tuple(r) for r in const.collect()} == {("A", "T1"), ("C", "T1"), ("C", "T2")}
    targets = spread.select("target_group", F.col("gene").alias("target"))
    pairs = {tuple(r) for r in screening.candidate_pairs(targets, tfs, const).collect()}
    assert ("A", "G", "T2") in pairs and ("A", "G", "T1") not in pairs and ("B", "T1", "T1") not in pairs
    sizes = pos.groupBy("target_group").agg(F.count("*").alias("n_positive"))
    got = {(r["target_group"], r["target"]): r["status"] for r in screening.preflight(spread, targets, tfs, const, sizes).collect()}
    assert got["A", "G"] == "constant_target" and got["A", "T2"] == "no_variable_predictors" and got["B", "G"] == "fit" and got["C", "G"] == "insufficient_positive_weight_samples"


def test_components_keep_distances(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 6)) + 100
    cells = spark.createDataFrame([(f"c{i:02d}", "A", r.tolist()) for i, r in enumerate(x)], "cell string, grp string, v array<double>")
    found = principal_components(cells, 50)
    z = np.array([r["v"] for r in found.cells.orderBy("cell").collect()])
    want = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert np.allclose(np.linalg.norm(z[:, None] - z[None], axis=2), want, atol=1e-9)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert found.effective_components == 6 and found.ratios == pytest.approx(s / s.sum(), abs=1e-10)
    flat = spark.createDataFrame([("a", "A", [1.0, 2.0]), ("b", "A", [1.0, 2.0])], "cell string, grp string, v array<double>")
    assert principal_components(flat, 2).reason == "no variance" and principal_components(flat.limit(1), 2).effective_components == 1


def test_components_of_few_cells_with_many_genes(spark, monkeypatch):
    import popnet.operators.representation as rep

    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 20))
    cells = spark.createDataFrame([(f"c{i}", "A", r.tolist()) for i, r in enumerate(x)], "cell string, grp string, v array<double>")
    a = np.array([r["v"] for r in principal_components(cells, 6).cells.orderBy("cell").collect()])
    monkeypatch.setattr(rep, "FULL", 10)
    b = np.array([r["v"] for r in principal_components(cells, 6).cells.orderBy("cell").collect()])
    assert np.allclose(a, b, atol=1e-9)


def test_components_of_many_cells_and_genes(spark, monkeypatch):
    import popnet.operators.representation as rep

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 40)) * 3 + rng.normal(size=(60, 40)) * 0.1 + 7
    cells = spark.createDataFrame([(f"c{i:02d}", "A", r.tolist()) for i, r in enumerate(x)], "cell string, grp string, v array<double>").repartition(3)
    a = principal_components(cells, 4)
    monkeypatch.setattr(rep, "FULL", 10)
    b = principal_components(cells, 4)
    va, vb = (np.array([r["v"] for r in f.cells.orderBy("cell").collect()]) for f in (a, b))
    assert np.allclose(va, vb, atol=1e-3) and b.ratios == pytest.approx(a.ratios, abs=1e-8)


def test_forests_sort_each_feature_once(two_programs, monkeypatch):
    import popnet.operators.trees as trees

    x, g = two_programs
    calls = []
    plain = np.argsort
    monkeypatch.setattr(trees.np, "argsort", lambda *a, **k: calls.append(1) or plain(*a, **k))
    fit(x, g, np.ones(120), ForestParams("random-forest", n_estimators=12), 5)
    assert len(calls) == x.shape[1]


def test_best_midpoint_is_that_of_all_splits():
    rng = np.random.default_rng(3)
    x, y, w = np.round(rng.normal(size=(60, 3)), 1).astype(np.float32), rng.normal(size=60), rng.random(60) + 0.1
    p = ForestParams("random-forest", max_features=1.0, max_depth=1, min_weight_fraction_leaf=0.2)
    found = grow(x, y, w, p, np.random.default_rng(1)).importances
    best = (0.0, -1)
    for f in range(3):
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            if min(w[left].sum(), w[~left].sum()) >= 0.2 * w.sum() and min(left.sum(), (~left).sum()) >= 2:
                best = max(best, (sum((w * (y - np.average(y, weights=w)))[s].sum() ** 2 / w[s].sum() for s in (left, ~left)), f))
    assert np.flatnonzero(found).tolist() == [best[1]]
