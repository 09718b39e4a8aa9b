"""Hand-computed values of distances, weights and diagnostics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popnet.functions import columns as fn
from popnet.operators import checks, diagnostics, distance, prepare, quantiles, sampling, weighting

EPS = 2.220446049250313e-16


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([("c1", "A", [0.0, 0.0]), ("c2", "A", [2.0, 0.0]), ("c3", "B", [4.0, 0.0]), ("c4", "B", [6.0, 0.0])], "cell string, grp string, v array<double>").cache()


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_centroids(spark, toy):
    got = rows(distance.centroids(toy), "grp", "dim")
    assert got["A", 1]["mu"] == 1 and got["B", 1]["mu"] == 5 and got["A", 2]["mu"] == 0
    w = toy.withColumn("w", F.when(F.col("cell").isin("c2", "c4"), 3.0).otherwise(1.0))
    got = rows(distance.centroids(w, "w"), "grp", "dim")
    assert got["A", 1]["mu"] == 1.5 and got["B", 1]["mu"] == 5.5


def test_centroid_of_largest_doubles(spark):
    top = float(np.finfo(float).max)
    df = spark.createDataFrame([("a", "A", [top]), ("b", "A", [top])], "cell string, grp string, v array<double>")
    assert distance.centroids(df).first()["mu"] == top


def test_distances(spark, toy):
    means = distance.centroids(toy)
    got = rows(distance.cell_distances(toy, means, "euclidean"), "cell", "target_group")
    assert [got[f"c{i}", "A"]["distance"] for i in (1, 2, 3, 4)] == [1, 1, 3, 5]
    assert [got[f"c{i}", "B"]["distance"] for i in (1, 2, 3, 4)] == [5, 3, 1, 1]
    between = rows(distance.group_distances(means, "euclidean"), "target_group", "source_group")
    assert between["A", "B"]["distance"] == between["B", "A"]["distance"] == 4 and between["A", "A"]["distance"] == 0
    assert [r[0] for r in distance.zero_norm_rows(toy).collect()] == ["c1"]


def test_extreme_distances():
    top = float(np.finfo(float).max)
    assert distance.pairwise(np.array([[1e154, 1e154]]), np.array([[0.0, 0.0]]), "euclidean")[0, 0] == pytest.approx(np.sqrt(2) * 1e154)
    assert distance.pairwise(np.array([[1e-300, 0.0]]), np.array([[0.0, 0.0]]), "euclidean")[0, 0] == pytest.approx(1e-300)
    assert np.isfinite(distance.pairwise(np.array([[top]]), np.array([[top / 2]]), "euclidean")).all()
    assert distance.pairwise(np.array([[1.0, 2.0]]), np.array([[-1.0, -2.0]]), "cosine")[0, 0] == 2
    assert distance.pairwise(np.array([[1e-300, 2e-300]]), np.array([[1e300, 2e300]]), "cosine")[0, 0] == 0


def test_standardised(spark, toy):
    got = [r["v"] for r in distance.standardised(toy).orderBy("cell").collect()]
    assert got[0][0] == pytest.approx(-3 / np.sqrt(5)) and all(v[1] == 0 for v in got)


def test_bandwidth(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 3.0, 10.0)], "distance double")
    assert tuple(weighting.bandwidth(df).first()) == (3.0, 3)
    assert weighting.bandwidth(df, scale=0.5).first()[0] == 1.5
    assert tuple(weighting.bandwidth(df.where("distance = 0")).first()) == (1.0, 0)
    with pytest.raises(ValueError):
        weighting.bandwidth(df, 2.0, 0.5)


def test_size_factors(spark):
    c = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "B"), ("4", "C")], "cell string, grp string")
    pairs = [(t, s, 0.0 if t == s else 1.0) for t in "ABC" for s in "ABC"]
    between = spark.createDataFrame(pairs, "target_group string, source_group string, distance double")
    h = weighting.bandwidth(between)
    got = rows(weighting.weights(c, weighting.group_sizes(c), h, "group-distance", group_distance=between), "target_group", "cell")
    assert [got["A", str(i)]["group_size_factor"] for i in (1, 2, 3, 4)] == [1, 0.5, 0.5, 1]
    assert got["A", "1"]["final_weight"] == 1 and got["A", "4"]["final_weight"] == pytest.approx(np.exp(-0.5))


def test_cell_distance_mode_scales_to_one(spark):
    d = spark.createDataFrame([("a1", "A", "A", 0.2), ("a2", "A", "A", 2.0), ("b1", "B", "A", 0.1), ("b2", "B", "A", 1.0)], "cell string, grp string, target_group string, distance double")
    sizes = spark.createDataFrame([("A", 2), ("B", 2)], "grp string, n long")
    h = spark.createDataFrame([(1.0,)], "bandwidth double")
    got = rows(weighting.weights(d, sizes, h, "cell-distance", cell_distance=d), "cell")
    assert got["b1",]["final_weight"] == 1.0
    assert got["a1",]["final_weight"] == pytest.approx(np.exp(-0.02 + 0.005))


def test_canonicalisation(spark):
    df = spark.createDataFrame([("A", w) for w in (1.0, 4 * EPS, EPS, EPS / 2, 0.0)], "target_group string, raw_weight double")
    got = sorted((r["final_weight"] for r in weighting.canonical(df).collect()), reverse=True)
    assert got == [1.0, 4 * EPS, 0.0, 0.0, 0.0]


def test_mass_and_ess(spark):
    data = [("A", "c1", "A", 1.0), ("A", "c2", "A", 1.0), ("A", "c3", "B", 0.25), ("A", "c4", "B", 0.5), ("A", "c5", "C", 0.25)]
    w = spark.createDataFrame(data, "target_group string, cell string, cell_group string, final_weight double")
    w = w.withColumn("raw_weight", F.col("final_weight")).withColumn("raw_weight_sum", F.lit(3.0))
    s = diagnostics.weight_summary(w).first()
    assert s["total_weight"] == 3 and s["external_weight"] == 1 and s["target_mass_percent"] == pytest.approx(200 / 3) and s["median_weight"] == 0.5
    assert s["effective_sample_size"] == pytest.approx(9 / 2.375)
    assert rows(diagnostics.weight_mass(w), "source_group")["B",]["source_weight"] == 0.75


def test_warnings(spark):
    data = [("A", "c1", "A", 0.1), ("A", "c2", "B", 1.0), ("A", "c3", "B", 0.0), ("A", "c4", "B", 0.0), ("A", "c5", "B", 0.0)]
    w = spark.createDataFrame(data, "target_group string, cell string, cell_group string, final_weight double")
    w = w.withColumn("raw_weight", F.col("final_weight")).withColumn("raw_weight_sum", F.lit(1.1))
    mass, summary = diagnostics.weight_mass(w), diagnostics.weight_summary(w)
    flags = diagnostics.warning_flags(summary, mass, 0.8, 0.5).first().asDict()
    assert flags["low_ess"] and flags["external_exceeds_target"] and flags["dominant_groups"] == ["B"]
    said = diagnostics.messages(flags, summary.first().asDict(), {"A": 9.0, "B": 90.9})
    assert len(said) == 3 and "90.9%" in said[2]


def test_centroid_weight_diagnostics(spark):
    df = spark.createDataFrame([("1", "A", 1.0), ("2", "A", 3.0), ("3", "B", 2.0), ("4", "B", 1.0)], "cell string, grp string, centroid_weight double")
    got = rows(weighting.centroid_weight_diagnostics(df), "grp")
    assert got["A",]["effective_sample_size"] == pytest.approx(1.6) and got["A",]["weight_sum"] == 4 and got["A",]["median_weight"] == 2
    norm = rows(weighting.normalised_centroid_weights(df), "cell")
    assert [norm[str(i),]["normalized_centroid_weight"] for i in (1, 2)] == [0.25, 0.75]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = [(str(k), float(x)) for k, n in ((0, 1), (1, 2), (2, 400), (3, 37)) for x in np.round(rng.normal(size=n), 1 if k == 2 else 9)]
    df = spark.createDataFrame([*data, ("9", None)], "k string, x double")
    got = rows(quantiles.exact_quantiles(df, ["k"], "x", {"a": 0.25, "b": 0.5, "c": 0.95}), "k")
    for k in "0123":
        x = [v for kk, v in data if kk == k]
        assert [got[k,][c] for c in "abc"] == pytest.approx(np.percentile(x, [25, 50, 95]), abs=1e-12)
    assert ("9",) not in got
    for x in ([5e-324], [float(np.finfo(float).max)] * 3):
        assert quantiles.exact_quantiles(spark.createDataFrame([(v,) for v in x], "x double"), [], "x", {"m": 0.5}).first()[0] == x[0]
    assert quantiles.exact_quantiles(df.where("false"), [], "x", {"m": 0.5}).first()[0] is None


def test_sampling(spark):
    sizes = spark.createDataFrame([(g, 10) for g in "abcd"], "grp string, n long")
    assert [r["allocated"] for r in sampling.allocation(sizes, 7).orderBy("grp").collect()] == [2, 2, 2, 1]
    assert sampling.sample_size(100_000, 20) == 15_000
    rare = spark.createDataFrame([("rare", 1), ("common-a", 49), ("common-b", 50)], "grp string, n long")
    got = rows(sampling.allocation(rare, 12), "grp")
    assert got["rare",]["allocated"] == 1 and sum(r["allocated"] for r in got.values()) == 12
    cells = spark.createDataFrame([(f"{g}{i}", g) for g, n in (("rare", 1), ("common-a", 49), ("common-b", 50)) for i in range(n)], "cell string, grp string")
    picked = sampling.stratified(cells, sampling.allocation(rare, 12)).collect()
    assert len(picked) == 12 and {r["cell"] for r in picked} == {r["cell"] for r in sampling.stratified(cells.repartition(7), sampling.allocation(rare, 12)).collect()}


def test_preparation_goldens(spark):
    counts = spark.createDataFrame([(0, 0, 250), (0, 0, 250), (1, 0, 1), (2, 1, 0)], "feature_idx int, barcode_idx int, x int")
    assert {(r["feature_idx"], r["x"]) for r in prepare.canonical(counts).collect()} == {(0, 500.0), (1, 1.0)}
    features = spark.createDataFrame([(0, "TF", "e0", "Gene Expression"), (1, "TF", "e1", "Gene Expression"), (2, "G", "e2", "Gene Expression"), (3, "ADT", "e3", "Antibody Capture")], "feature_idx int, name string, id string, feature_type string")
    dup = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0), (2, 0, 1.0), (2, 1, 1.0), (3, 0, 9.0)], "feature_idx int, barcode_idx int, x double")
    genes, entries = prepare.collapse_genes(dup, features)
    assert [r["gene"] for r in genes.orderBy("gene_ord").collect()] == ["TF", "G"]
    got = rows(prepare.normalised(entries, cell="barcode_idx"), "gene", "barcode_idx")
    assert got["TF", 0]["x"] == pytest.approx(np.log1p(7500))
    with pytest.raises(checks.InputError):
        prepare.collapse_genes(dup, features, policy="error")
    assert len(prepare.collapse_genes(dup, features, identifier="id")[0].collect()) == 3


def test_eligibility_reasons(spark):
    a = spark.createDataFrame([(f"c{i}", u, "k") for i, u in enumerate("xxxyyyzw")], "cell string, analysis_unit string, cluster string")
    genes = spark.createDataFrame([("x", "TF1"), ("y", "G")], "analysis_unit string, gene string")
    tfs = spark.createDataFrame([("TF1", 0)], "gene string, ord int")
    got = {k[0]: r["exclusion_reason"] for k, r in rows(prepare.unit_eligibility(a, genes, tfs, 2), "analysis_unit").items()}
    assert got == {"x": None, "y": "no-transcription-factors-after-filtering", "z": "below-min-cells", "w": "below-min-cells"}


def test_text_functions(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("1d",), ("x",), ("",), (None,), ("-2e3",)], "t string")
    assert [r[0] for r in df.select(fn.finite(F.col("t"))).collect()] == [1.5, None, None, None, None, None, None, -2000.0]
    names = spark.createDataFrame([("Unit alpha",), ("rare/type",), ("***",), ("x" * 70,)], "n string")
    assert [r[0] for r in names.select(fn.slug(F.col("n"))).collect()] == ["unit-alpha", "rare-type", "analysis", "x" * 64]
    bad = spark.createDataFrame([("ok",), ("",), (" a",), ("a\n",), (None,)], "n string")
    assert sorted(r["fault"] for r in checks.identifier_violations(bad, "n").collect()) == ["control", "empty", "empty", "untrimmed"]


def test_error_preview_counts_the_rest(spark):
    df = spark.createDataFrame([(f"g{i:02d}",) for i in range(12)], "g string")
    with pytest.raises(checks.InputError, match="'g07' and 4 more"):
        checks.require_none(df, "g", "Bad genes")


def test_order_assertion(spark):
    good = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "k string, at int")
    bad = spark.createDataFrame([("a", 0), ("c", 1), ("b", 2)], "k string, at int")
    assert checks.not_increasing(good, ["k"], "at").isEmpty() and not checks.not_increasing(bad.coalesce(1), ["k"], "at").isEmpty()
