"""Lines of many cells: what is held at once, and what a plan holds."""

import gzip
import tracemalloc

import numpy as np

from popnet.sinks import dense_line
from popnet.sources import counts, expression


def test_a_dense_line_is_made_in_stretches():
    n = 400_000
    at, x = np.arange(n, dtype=np.int32)[::-1], np.arange(n, dtype=float)[::-1] / 7
    tracemalloc.start()
    line = dense_line("G", n, at, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert line.split("\t") == ["G", *map(repr, (np.arange(n) / 7).tolist())]
    assert peak < 2.5 * len(line) + 16 * n + (4 << 20)  # two copies of the line and the arrays, not a string a value
    none = np.zeros(0)
    assert dense_line("G", 3, none.astype(np.int32), none) == "G\t0.0\t0.0\t0.0" and dense_line("G", 0, none.astype(np.int32), none) == "G"
    assert dense_line("a\tb", 2, np.array([1, 1], np.int32), np.array([1.0, 2.0])) == '"a\tb"\t0.0\t2.0'


def test_names_of_cells_are_no_part_of_a_plan(spark, tmp_path):
    names = [f"cell-{i}-x" for i in range(600)]  # three pieces
    path = tmp_path / "e.tsv"
    path.write_text("\n".join(["\t".join(["gene", *names]), *["\t".join([g, *[str(i * k) for i in range(600)]]) for k, g in enumerate(("A", "B"), 1)]]) + "\n")
    x = expression.read(spark, str(path))
    rows = {(r["gene"], r["cell"]): (r["x"], r["cell_ord"]) for r in x.long().collect()}
    assert rows == {(g, c): (float(i * k), i) for k, g in enumerate(("A", "B"), 1) for i, c in enumerate(names)}
    assert [tuple(r) for r in x.cells().orderBy("cell_ord").collect()] == list(zip(names, range(600), strict=True))
    for df in (x.long(), x.by_cell()):
        assert "cell-7-x" not in df._jdf.queryExecution().toString()


def test_triplets_are_parsed_once(spark, tmp_path):
    texts = {"features.tsv": "i\tA\tGene Expression\nj\tB\tGene Expression\n", "barcodes.tsv": "c\nd\n", "matrix.mtx": "%%MatrixMarket matrix coordinate integer general\n2 2 3\n1 1 5\n2 1 1\n2 2 4\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
    m = counts.from_mex(spark, str(tmp_path), ".gz").checked()
    assert not any(f.endswith(".gz") for t in (m.counts, m.features, m.barcodes) for f in t.inputFiles())
    assert sorted(map(tuple, m.counts.collect())) == [(0, 0, 5.0), (1, 0, 1.0), (1, 1, 4.0)]
