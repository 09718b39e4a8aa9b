"""Files to files: preparation, inference, resume, prefixes, sinks and the command line."""

import gzip
import json

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from popnet import cli, report, sinks
from popnet.config import InferConfig, PrepareConfig
from popnet.operators.checks import InputError
from popnet.plans.infer import infer, prepare_forest_prefixes, prepare_inference
from popnet.operators.ordering import numbered
from popnet.plans.prepare import prepare
from popnet.sources import counts, expression, text
from popnet.streaming.checkpoint import weight_digests

FOUR = {"TF1": [3, 7, 1, 8], "TF2": [2, 0, 5, 4], "G3": [6, 2, 9, 3], "CONST": [5, 5, 5, 5]}
FOUR_WEIGHTS = (2, 1, 1, 4)
SMALL = {"distance_space": "expression", "distance_metric": "euclidean", "n_estimators": 5, "min_samples_leaf": 1, "min_weight_fraction_leaf": 0.0}


@pytest.fixture
def four(tmp_path):
    cells = [f"cell_{i}" for i in range(1, 5)]
    (tmp_path / "x.tsv").write_text("\t".join(["sample_id", *cells]) + "\n" + "".join(f"{g}\t" + "\t".join(map(str, v)) + "\n" for g, v in FOUR.items()))
    (tmp_path / "tf.txt").write_text("TF1\nTF2\n")
    (tmp_path / "groups.tsv").write_text("cell\tcluster\textra\n" + "".join(f"{c}\t{g}\t1\n" for c, g in zip(cells, "AABB", strict=True)))
    (tmp_path / "w.tsv").write_text("cell\tcentroid_weight\n" + "".join(f"{c}\t{w}\n" for c, w in zip(cells, FOUR_WEIGHTS, strict=True)))
    return tmp_path


def config(d, **more):
    return InferConfig(expression=str(d / "x.tsv"), tf_list=str(d / "tf.txt"), groups=str(d / "groups.tsv"), output_dir=str(d / more.pop("out", "run")), **(SMALL | more))


def lines(path):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "rt") as f:
        return [x.rstrip("\n").split("\t") for x in f]


def test_inference_publishes_all_artifacts(spark, four):
    phases = []
    run = infer(spark, config(four, centroid_weights=str(four / "w.tsv")), lambda p, info: phases.append(p))
    assert run.total_models == 8 and run.status == "complete" and run.trained_models + 2 == 8
    out = four / "run"
    names = {p.name for p in out.iterdir()}
    assert {"network.csv", "cell_weights.tsv.gz", "skipped_targets.tsv", "model_diagnostics.tsv.gz", "weight_diagnostics.tsv", "centroids.tsv", "group_distances.tsv", "group_affinities.tsv"} <= names
    assert {"centroid_weights.tsv.gz", "centroid_weight_diagnostics.tsv", "parameters.json", "run_metadata.json", "report.html"} <= names
    centroids = {(a, b): float(c) for a, b, c in lines(out / "centroids.tsv")[1:]}
    assert centroids["A", "1"] == pytest.approx(np.average(FOUR["TF1"][:2], weights=FOUR_WEIGHTS[:2])) and centroids["B", "1"] == pytest.approx(np.average(FOUR["TF1"][2:], weights=FOUR_WEIGHTS[2:]))
    skipped = lines(out / "skipped_targets.tsv")[1:]
    assert [r[:3] for r in skipped] == [["A", "CONST", "constant_target"], ["B", "CONST", "constant_target"]]
    weights = lines(out / "cell_weights.tsv.gz")
    assert weights[0] == sinks.CELL_WEIGHTS and len(weights) == 9 and {r[7] for r in weights[1:]} == {"False"}
    net = [x.split(",") for x in (out / "network.csv").read_text().splitlines()]
    assert net[0] == sinks.NETWORK and net[1:] == sorted(net[1:], key=lambda r: (r[5], r[1], r[0])) and all(r[0] != r[1] for r in net)
    assert len(lines(out / "model_diagnostics.tsv.gz")[0]) == 31
    shown = lines(out / "cell_embedding.tsv.gz")
    assert shown[0] == ["cell", "group", "AuxiliaryPC1", "AuxiliaryPC2"] and len(shown) == 5
    page = (out / "report.html").read_text()
    data = json.loads(page.split('id="data">')[1].split("</script>")[0])
    points = np.array([p[2:] for p in data["centroids"]])
    cells = np.array([[float(v) for v in r[2:]] for r in shown[1:]])
    want = [np.average(cells[:2], axis=0, weights=FOUR_WEIGHTS[:2]), np.average(cells[2:], axis=0, weights=FOUR_WEIGHTS[2:])]
    assert points == pytest.approx(np.array(want)) and len(data["cells"]) == 4  # centroids are projected by the cells' own loadings
    assert phases[0] == "load" and phases[-1] == "publish" and not list(four.glob(".run*"))
    assert json.loads((out / "run_metadata.json").read_text())["summary"]["total_models"] == 8
    with pytest.raises(FileExistsError):
        infer(spark, config(four))


def test_modes_and_space(spark, four):
    assert infer(spark, config(four, weight_mode="group-distance", out="groups", report=False), checkpoint=False).failed_models == 0
    run = infer(spark, config(four, distance_space="pca", weight_mode="cell-distance", out="pca", tree_method="random-forest"), checkpoint=False)
    assert run.n_edges > 0 and (four / "pca" / "pca_explained_variance.tsv").exists() and lines(four / "pca" / "cell_embedding.tsv.gz")[0] == ["cell", "group", "PC1", "PC2", "PC3"]


def test_resume_equals_a_clean_run(spark, four, monkeypatch):
    import popnet.plans.infer as plan

    clean = infer(spark, config(four, out="clean", report=False))
    stop = plan.write_artifacts
    monkeypatch.setattr(plan, "write_artifacts", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        infer(spark, config(four, out="again", report=False))
    monkeypatch.setattr(plan, "write_artifacts", stop)
    assert not (four / "again").exists()
    with pytest.raises(FileExistsError):
        infer(spark, config(four, out="again", report=False))
    with pytest.raises(InputError):
        infer(spark, config(four, out="again", report=False, random_seed=7), resume=True)
    kept = four / ".again.checkpoint" / "weights"
    (part,) = [p for p in kept.iterdir() if p.name.startswith("part-")][:1]
    whole = part.read_bytes()
    one = pq.read_table(part)
    at = one.column_names.index("final_weight")
    pq.write_table(one.set_column(at, "final_weight", pc.multiply(one.column(at), 1 + 1e-15)), part)
    (kept / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(InputError, match="weights have changed"):
        infer(spark, config(four, out="again", report=False), resume=True)
    part.write_bytes(whole)
    with monkeypatch.context() as m:
        m.setattr("popnet.streaming.checkpoint.implementation", lambda: "another version")
        with pytest.raises(InputError, match="implementation"):
            infer(spark, config(four, out="again", report=False), resume=True)
    run = infer(spark, config(four, out="again", report=False), resume=True)
    assert run.resumed_models == 8 and run.n_edges == clean.n_edges
    assert (four / "again" / "network.csv").read_bytes() == (four / "clean" / "network.csv").read_bytes()


def test_prefixes(spark, four):
    with pytest.raises(ValueError):
        prepare_forest_prefixes(spark, config(four), (3, 2))
    made = prepare_forest_prefixes(spark, config(four), (1, 3, 5))
    got = made.results().select("target_group", "target", "n_estimators", "importance_sum").collect()
    assert len(got) == 8 * 3 and sum(b.count() for b in made.iter_batches(3)) == 24


@pytest.mark.parametrize(
    ("name", "content", "message"),
    [
        ("tf.txt", "TF1\nTF1\n", "Repeated"), ("tf.txt", "TF1\nNO\n", "not in the expression"), ("tf.txt", "TF1\n\n", "Invalid"), ("tf.txt", "", "empty"),
        ("groups.tsv", "cell\tcluster\ncell_1\tA\n", "missing"), ("groups.tsv", "cell\tkind\ncell_1\tA\n", "cluster"),
        ("groups.tsv", "cell\tcluster\ncell_1\tA\ncell_1\tA\ncell_2\tA\ncell_3\tB\ncell_4\tB\n", "several groups"),
        ("x.tsv", "g\ta\tb\nTF1\t1\t2\nTF2\t1\tnan\n", "finite"), ("x.tsv", "g\ta\tb\nTF1\t1\n", "fields"), ("x.tsv", "cell\ta\tb\nTF1\t1\t2\n", "cells belong"),
        ("x.tsv", "g\ta\ta\nTF1\t1\t2\n", "repeats"), ("x.tsv", "g\ta\tb\nTF1\t1\t2\nTF1\t1\t2\n", "Duplicate"), ("x.tsv", "g,a,b\nTF1,1,2\n", "comma"),
        ("w.tsv", "cell\tcentroid_weight\ncell_1\t0\n", "positive"), ("w.tsv", "cell\tweight\ncell_1\t1\n", "exactly"),
    ],
)
def test_bad_inputs(spark, four, name, content, message):
    (four / name).write_text(content)
    with pytest.raises(InputError, match=message):
        text.load_inputs(spark, str(four / "x.tsv"), str(four / "tf.txt"), str(four / "groups.tsv"), None, str(four / "w.tsv"))


def test_turned_matrix(spark, four):
    cells = [f"cell_{i}" for i in range(1, 5)]
    rows = zip(cells, *FOUR.values(), strict=True)
    (four / "x.tsv").write_text("\t".join(["name", *FOUR]) + "\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    with pytest.raises(InputError, match="rows"):
        text.load_inputs(spark, str(four / "x.tsv"), str(four / "tf.txt"), str(four / "groups.tsv"))


def test_byte_order_mark_and_line_ends(spark, tmp_path):
    (tmp_path / "x.tsv").write_bytes("﻿g\ta\tb\r\nT\t1\t2\r\nU\t3\t4\r\n".encode())
    got = {(r["gene"], r["cell"]): r["x"] for r in text.read_expression(spark, str(tmp_path / "x.tsv")).collect()}
    assert got == {("T", "a"): 1, ("T", "b"): 2, ("U", "a"): 3, ("U", "b"): 4}


@pytest.fixture
def tenx(tmp_path):
    d = tmp_path / "mex"
    d.mkdir()
    m = {"TF1": (1, 2, 0, 1, 4), "G1": (3, 0, 5, 1, 0), "G2": (0, 2, 1, 0, 0), "ADT1": (8, 9, 7, 5, 4)}
    entries = [(i + 1, j + 1, x) for i, row in enumerate(m.values()) for j, x in enumerate(row) if x]
    (d / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n" + f"4 5 {len(entries)}\n" + "".join(f"{a} {b} {c}\n" for a, b, c in entries))
    (d / "features.tsv").write_text("".join(f"id{i}\t{g}\t{'Antibody Capture' if g == 'ADT1' else 'Gene Expression'}\n" for i, g in enumerate(m)))
    (d / "barcodes.tsv").write_text("".join(f"c{i}\n" for i in range(1, 6)))
    (tmp_path / "a.tsv").write_text("analysis_unit\tcell\tcluster\nUnit alpha\tc3\tk1\nUnit alpha\tc1\tk1\nrare/type\tc4\tk2\nUnit alpha\tc2\tk2\n")
    (tmp_path / "tf.txt").write_text("MISSING\nTF1\n")
    (tmp_path / "w.tsv").write_text("cell\tcentroid_weight\nc1\t0.9\nc2\t1.0\nc3\t0.8\nc4\t0.7\n")
    return tmp_path


def test_preparation(spark, tenx):
    done = prepare(spark, PrepareConfig(counts=str(tenx / "mex"), annotations=str(tenx / "a.tsv"), tf_list=str(tenx / "tf.txt"), output_dir=str(tenx / "out"), centroid_weights=str(tenx / "w.tsv"), min_cells=2))
    assert done.prepared_analysis_units == ("Unit alpha",) and done.excluded_analysis_units == ("rare/type",) and done.excluded_unannotated_cells == 1
    unit = tenx / "out" / "unit-001-unit-alpha"
    x = lines(unit / "expression.tsv")
    assert x[0] == ["gene", "c1", "c2", "c3"] and [r[0] for r in x[1:]] == ["TF1", "G1", "G2"]
    assert [float(r[1]) for r in x[1:]] == pytest.approx(np.log1p(np.array([1, 3, 0]) * 2500))
    assert (unit / "tf_list.txt").read_text() == "TF1\n" and lines(unit / "centroid_weights.tsv")[1:] == [["c1", "0.9"], ["c2", "1.0"], ["c3", "0.8"]]
    manifest = json.loads((tenx / "out" / "prepare_manifest.json").read_text())
    assert manifest["transcription_factors"]["absent"] == ["MISSING"] and manifest["matrix"]["library_size_before_normalization"]["median"] == 4
    run = InferConfig(expression=str(unit / "expression.tsv"), tf_list=str(unit / "tf_list.txt"), groups=str(unit / "groups.tsv"), output_dir=str(tenx / "net"), report=False, **SMALL)
    assert infer(spark, run).total_models == 6


def test_no_eligible_unit(spark, tenx):
    with pytest.raises(InputError, match="below-min-cells=2"):
        prepare(spark, PrepareConfig(counts=str(tenx / "mex"), annotations=str(tenx / "a.tsv"), tf_list=str(tenx / "tf.txt"), output_dir=str(tenx / "out"), min_cells=9))
    assert not (tenx / "out").exists()


def test_count_checks(spark):
    f = spark.createDataFrame([(0, "a", "a", "Gene Expression")], "feature_idx int, name string, id string, feature_type string")
    b = spark.createDataFrame([(0, "x")], "barcode_idx int, cell string")
    for row in [(0, 0, -1.0), (0, 0, float("nan")), (3, 0, 1.0)]:
        with pytest.raises(InputError):
            counts.CountMatrix(spark.createDataFrame([row], counts.COUNTS), f, b).checked()


@pytest.mark.parametrize(
    "bad",
    [
        {"weight_mode": "x"}, {"n_estimators": 0}, {"bandwidth": -1.0}, {"bandwidth": 1.0, "bandwidth_scale": 2.0}, {"max_features": 0}, {"max_features": 1.5}, {"max_features": "all"},
        {"min_weight_fraction_leaf": 0.6}, {"random_seed": 2**32}, {"max_depth": 0}, {"kernel": "box"},
    ],
)
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        InferConfig(expression="a", tf_list="b", groups="c", output_dir="d", **bad)


def test_settings_types():
    for bad in ({"n_estimators": 1.0}, {"report": 1}, {"bootstrap": 1}, {"max_features": None}):
        with pytest.raises(TypeError):
            InferConfig(expression="a", tf_list="b", groups="c", output_dir="d", **bad)


def test_command_line(four, capsys):
    args = cli.parser().parse_args(["infer", "--expression", "a", "--tf-list", "b", "--groups", "c", "--output-dir", "d", "--max-features", "1", "--no-report"])
    assert args.max_features == 1 and type(args.max_features) is int and args.report is False
    assert cli.max_features("1.0") == 1.0 and type(cli.max_features("1.0")) is float
    assert cli.main(["infer", "--expression", "a", "--tf-list", "b", "--groups", "c", "--output-dir", str(four), "--n-estimators", "0"]) == 2
    assert "n_estimators" in capsys.readouterr().err


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.1, True), ("a", 1e-7, False)], "k string, x double, f boolean")
    for i in (1, 2):
        sinks.write_text(df, str(tmp_path / f"{i}.gz"), ["k", "x", "f"], ["k"], compress=True)
    assert (tmp_path / "1.gz").read_bytes() == (tmp_path / "2.gz").read_bytes()
    assert lines(tmp_path / "1.gz") == [["k", "x", "f"], ["a", "1e-07", "False"], ["b", "0.1", "True"]]
    with pytest.raises(FileExistsError):
        sinks.write_text(df, str(tmp_path / "1.gz"), ["k"], ["k"])
    with pytest.raises(ValueError):
        sinks.write_json(spark, {"x": float("nan")}, str(tmp_path / "x.json"))
    assert sinks.unit_directory(1, "Ünit α/β") == "unit-001-unit"


def test_report_escapes():
    value = {"x": "</script><b>& \u2028\u2029"}
    text_ = report.embedded(value)
    assert "</script>" not in text_ and "\u2028" not in text_ and "\u2029" not in text_ and json.loads(text_) == value


def test_one_group_in_a_centred_space(spark, four):
    """Angles to a centroid that is zero but for rounding are refused; distances, and angles in an uncentred space, are not."""
    (four / "groups.tsv").write_text("cell\tcluster\n" + "".join(f"cell_{i}\tA\n" for i in range(1, 5)))
    one = {"weight_mode": "cell-distance"}
    for n, bad in enumerate(({"distance_space": "pca", "n_components": 2}, {"distance_standardization": "standard"})):
        with pytest.raises(InputError, match="Euclidean distance in a centred space"):
            infer(spark, config(four, out=f"bad{n}", **(one | bad | {"distance_metric": "cosine"})))
        assert not (four / f"bad{n}").exists()
    assert infer(spark, config(four, out="near", **one | {"distance_space": "pca", "n_components": 2})).status == "complete"
    assert infer(spark, config(four, out="angle", **one | {"distance_metric": "cosine"})).status == "complete"


def test_only_a_local_session_has_local_intermediates(spark, monkeypatch, tmp_path):
    from types import SimpleNamespace

    from popnet import storage
    from popnet.plans.infer import checkpoint_path

    held = {}
    conf = SimpleNamespace(get=lambda k, d=None: held.get(k, d), set=held.__setitem__)
    there = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://there:7077", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(there)
    held[storage.CHECKPOINT_KEY] = "hdfs://there/shared/"
    assert checkpoint_path(there, "/out/run").startswith("hdfs://there/shared/popnet-run-") and checkpoint_path(spark, "/out/run") == "file:///out/.run.checkpoint"


def test_a_matrix_that_is_cut_off(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 2 3\n1 1 4\n2 2 1\n")
    (tmp_path / "features.tsv").write_text("i1\tn1\tGene Expression\ni2\tn2\tGene Expression\n")
    (tmp_path / "barcodes.tsv").write_text("b1\nb2\n")
    with pytest.raises(InputError, match="3 entries, but there are 2"):
        counts.from_mex(spark, str(tmp_path))


def test_parts_end_to_end(spark, tmp_path):
    """Parts of many partitions joined are the sorted table; a folder of parts holds the same lines."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") / 7).alias("x"), F.when(F.col("id") % 3 == 0, 'a"\tb').alias("s")).repartition(7)
    want = ["k\tx\ts"] + ["\t".join((str(k), repr(x), "" if s is None else '"a""\tb"')) for k, x, s in sorted(map(tuple, df.collect()))]
    for name, compress in (("plain.tsv", False), ("packed.tsv.gz", True)):
        assert sinks.write_text(df, str(tmp_path / name), ["k", "x", "s"], ["k"], compress=compress) == 5000
        assert (gzip.decompress((tmp_path / name).read_bytes()) if compress else (tmp_path / name).read_bytes()).decode() == "\n".join(want) + "\n"
    assert sinks.write_text(df, str(tmp_path / "parts"), ["k", "x", "s"], ["k"], parts=True) == 5000
    files = sorted(f for f in (tmp_path / "parts").iterdir() if f.name.startswith("part-"))
    assert len(files) > 1 and (tmp_path / "parts" / "_header").read_text() + "".join(f.read_text() for f in files) == "\n".join(want) + "\n"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sinks.write_text(df.limit(0), str(tmp_path / "none.tsv"), ["k", "x", "s"], ["k"]) == 0 and (tmp_path / "none.tsv").read_text() == want[0] + "\n"


def test_publication_by_pointer(spark, tmp_path):
    final = str(tmp_path / "run")
    with pytest.raises(RuntimeError), sinks.published(spark, final, pointer=True) as out:
        sinks.write_json(spark, {"a": 1}, f"{out}/x.json")
        raise RuntimeError
    assert not [p for p in (tmp_path / "run").iterdir() if p.is_dir() or p.name == sinks.POINTER]  # a run that fails leaves nothing to be seen
    with pytest.raises(FileExistsError), sinks.published(spark, final, pointer=True) as late:
        sinks.write_json(spark, {"a": "late"}, f"{late}/x.json")
        with sinks.published(spark, final, pointer=True) as first:  # another run is faster
            sinks.write_json(spark, {"a": "first"}, f"{first}/x.json")
    assert json.loads(open(sinks.resolved(spark, final) + "/x.json").read()) == {"a": "first"} and len([p for p in (tmp_path / "run").iterdir() if p.is_dir()]) == 1
    with pytest.raises(FileExistsError), sinks.published(spark, final, pointer=True):
        pass
    assert sinks.resolved(spark, str(tmp_path)) == str(tmp_path)


@pytest.mark.parametrize(
    ("content", "message"),
    [
        (b"g\ta\tb\nT\t1\t2\n\xff\t1\t2\nU\t1\n", "UTF-8"), (b"g\ta\tb\nT\t1\t2\n\nU\t1\t2\n", "Empty lines"), (b'g\ta\tb\nT\t"1\t2\n', "quotes"), (b'g\ta\tb\nT\t"1"x\t2\n', "quotes"),
        (b"g\ta\tb\nT\t1\t2\nU\t1\t2\t3\nV\t1\n", "without 3 fields: 'U' and 1 more"), (b"g\ta\tb\n \t1\t2\n", "Invalid gene"), (b"g\ta\tb\nT\t1\t2d\n", "finite numbers: 'T/b/2d'"),
        (b"g\ta\tb\nT\t1\tInfinity\nU\t\t1\n", "'T/b/Infinity' and 1 more"), (b"g\ta\tb\n", "no gene rows"), (b"g\ta\tb\ng\ta\tb\n", "finite"), (b'g\ta\t"b\n', "header"), (b"", "empty"),
    ],
)
def test_one_scan_finds_faults(spark, tmp_path, content, message):
    (tmp_path / "x.tsv").write_bytes(content)
    with pytest.raises(InputError, match=message):
        expression.read(spark, str(tmp_path / "x.tsv"))


def test_pieces_and_turning(spark, tmp_path):
    n_cells, n_genes = 2 * expression.PIECE + 3, 5
    x = np.random.default_rng(1).normal(size=(n_genes, n_cells))
    head = "gene\t" + "\t".join(f"c{i}" for i in range(n_cells))
    names = ["plain", '"a ""quoted"" name"', '"with\ttab"', "ünder", 'in"side']
    (tmp_path / "x.tsv").write_text(head + "\r\n" + "".join(f"{g}\t" + "\t".join(map(repr, map(float, r))) + "\r\n" for g, r in zip(names, x, strict=True)), newline="")
    got = expression.read(spark, str(tmp_path / "x.tsv"))
    genes = {r["gene"]: r["y"] for r in got.vectors().collect()}
    assert got.n_genes == 5 and set(genes) == {"plain", 'a "quoted" name', "with\ttab", "ünder", 'in"side'} and genes["ünder"] == x[3].tolist()
    rows = sorted(got.by_cell().collect(), key=lambda r: r["cell_ord"])
    assert [r["cell"] for r in rows] == [f"c{i}" for i in range(n_cells)] and [r["v"] for r in rows] == x.T.tolist()
    assert got.rows.count() == 3 * n_genes and got.long().count() == x.size


def test_numbers_of_rows(spark):
    rows = spark.createDataFrame([(g, i) for i in range(300) for g in ("a", None, "b")[: 1 + i % 3]], "g string, i int").repartition(5)
    got = numbered(rows, ["i"], ["g"], "at", "n").collect()
    want = {}
    for g, i in sorted(map(tuple, rows.collect()), key=lambda r: (r[0] or "", r[1])):
        want.setdefault(g, []).append(i)
    assert sorted((r["g"] or "", r["i"], r["at"], r["n"]) for r in got) == sorted((g or "", i, at, len(v)) for g, v in want.items() for at, i in enumerate(v))


def test_weight_digests_do_not_depend_on_order(spark):
    rows = [(g, f"c{i}", i, i / 7 if i % 5 else 0.0) for g in "ab" for i in range(200)]
    schema = "target_group string, cell string, cell_ord int, final_weight double"
    one = sorted(weight_digests(spark.createDataFrame(rows, schema).repartition(5)).collect())
    assert one == sorted(weight_digests(spark.createDataFrame(rows[::-1], schema).repartition(2)).collect())
    assert one[0]["rows"] == 200 and one[0]["digest"] == one[1]["digest"]
    swapped = [(g, c, i, rows[1 - i][3] if i < 2 and g == "a" else w) for g, c, i, w in rows]  # two cells' weights change places
    two = sorted(weight_digests(spark.createDataFrame(swapped, schema)).collect())
    assert two[0] != one[0] and two[1] == one[1]
    repeated = sorted(weight_digests(spark.createDataFrame([*rows, rows[0], rows[0]], schema)).collect())
    assert repeated[0] != one[0]


def test_arrays_give_what_files_give(spark, four):
    files = prepare_forest_prefixes(spark, config(four), (5,))
    cells = [f"cell_{i}" for i in range(1, 5)]
    arrays = prepare_inference(spark, np.array(list(FOUR.values())), list(FOUR), cells, list("AABB"), ["TF1", "TF2"], **SMALL)
    rows = lambda made: sorted(map(str, made.results().select("target_group", "target", "status", "edges").collect()))
    assert rows(files) == rows(arrays) and len(rows(arrays)) == 8
    with arrays.iter_groups() as groups:
        got = [(g, r.count()) for g, r in groups]
    assert got == [("A", 4), ("B", 4)]
    with pytest.raises(InputError, match="not in the matrix"):
        prepare_inference(spark, np.ones((1, 4)), ["G"], cells, list("AABB"), ["TF1"], **SMALL)
    with pytest.raises(InputError, match="finite"):
        prepare_inference(spark, np.full((1, 4), np.nan), ["G"], cells, list("AABB"), ["G"], **SMALL)


def test_matrix_of_rows(spark):
    rows = [(f"g{i}", f"c{j:02d}", i + j / 10) for i in range(3) for j in range(12)]
    got = expression.Expression.of_rows(spark.createDataFrame(rows, "gene string, cell string, x double").repartition(4))
    assert got.n_genes == 3 and got.names == tuple(f"c{j:02d}" for j in range(12))
    assert {r["gene"]: r["y"] for r in got.vectors().collect()} == {f"g{i}": [i + j / 10 for j in range(12)] for i in range(3)}
    assert sorted((r["gene"], r["cell"], r["x"]) for r in got.long().collect()) == sorted(rows)
    with pytest.raises(InputError, match="35 values"):
        expression.Expression.of_rows(spark.createDataFrame(rows[1:], "gene string, cell string, x double"))
