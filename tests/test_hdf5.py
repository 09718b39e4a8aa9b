"""The HDF5 source with a stand-in for h5py that keeps the same datasets in a NumPy archive."""

import os
import sys

import numpy as np
import pytest

from popnet.operators.checks import InputError
from popnet.sources import counts

STAND_IN = """
import numpy as np
class File(dict):
    def __init__(self, path, mode):
        for k, v in np.load(path, allow_pickle=True).items():
            self[k] = v
    def __getitem__(self, key):
        return _Group(self, key) if not self.__contains__(key) else dict.__getitem__(self, key)
    def __enter__(self): return self
    def __exit__(self, *a): pass
class _Group:
    def __init__(self, f, at): self.f, self.at = f, at
    def __getitem__(self, key): return self.f[f"{self.at}/{key}"]
"""


@pytest.fixture
def h5(spark, tmp_path, monkeypatch):
    """A matrix of 5 features and 9 barcodes: an empty column, one that is longer than a part, a repeated entry; ``path`` is the archive."""
    home = tmp_path / "lib"
    home.mkdir()
    (home / "h5py.py").write_text(STAND_IN)
    spark.sparkContext.addPyFile(str(home / "h5py.py"))
    monkeypatch.syspath_prepend(str(home))
    rng = np.random.default_rng(1)
    columns = [[], [0, 1, 2, 3, 4], [2], [], [], [0, 0, 3], [4], [1, 2], [3]]
    data = {
        "matrix/shape": np.array([5, 9]), "matrix/indptr": np.cumsum([0, *map(len, columns)]), "matrix/indices": np.array(sum(columns, [])), "matrix/data": rng.integers(1, 9, 13).astype(np.uint16),
        "matrix/barcodes": np.array([f"c{i}".encode() for i in range(9)]), "matrix/features/name": np.array([f"n{i}".encode() for i in range(5)]),
        "matrix/features/id": np.array([f"i{i}".encode() for i in range(5)]), "matrix/features/feature_type": np.array([b"Gene Expression"] * 4 + [b"Other"]),
    }
    yield data, lambda: (np.savez(tmp_path / "m.h5.npz", **data), str(tmp_path / "m.h5.npz"))[1]
    sys.modules.pop("h5py", None)


def triplets(data, folder):
    os.makedirs(folder)
    entries = [(i + 1, j + 1, int(x)) for j in range(9) for i, x in zip(*[data[f"matrix/{k}"][data["matrix/indptr"][j] : data["matrix/indptr"][j + 1]] for k in ("indices", "data")], strict=True)]
    with open(f"{folder}/matrix.mtx", "w") as f:
        f.write(f"%%MatrixMarket matrix coordinate integer general\n5 9 {len(entries)}\n" + "".join(f"{a} {b} {c}\n" for a, b, c in entries))
    kinds = ["Gene Expression"] * 4 + ["Other"]
    open(f"{folder}/features.tsv", "w").write("".join(f"i{i}\tn{i}\t{kinds[i]}\n" for i in range(5)))
    open(f"{folder}/barcodes.tsv", "w").write("".join(f"c{i}\n" for i in range(9)))


@pytest.mark.parametrize("entries", [1, 2, 4, 1 << 22])
def test_same_tables_as_triplets(spark, h5, tmp_path, entries):
    data, path = h5
    triplets(data, str(tmp_path / "mex"))
    one, two = counts.from_hdf5(spark, path(), entries).checked(), counts.from_mex(spark, str(tmp_path / "mex"))
    for a, b in zip((one.counts, one.features, one.barcodes), (two.counts, two.features, two.barcodes), strict=True):
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_parts_have_equal_numbers_of_entries():
    pointers = np.array([0, 0, 1000, 1001, 1001, 1010])
    parts = counts.entry_parts(pointers, 1010, 100)
    assert [(p.end - p.start) for p in parts] == [100] * 10 + [10] and [p.column for p in parts] == [1] * 10 + [2]
    assert counts.entry_parts(np.array([0, 0]), 0, 100) == []


@pytest.mark.parametrize(("key", "value", "message"), [("indptr", [0, 3, 2, 6, 6, 6, 9, 10, 12, 13], "pointers"), ("indptr", [0, 1], "length"), ("indices", [9] * 13, "outside"), ("indices", [1], "length")])
def test_broken_matrices(spark, h5, key, value, message):
    data, path = h5
    data[f"matrix/{key}"] = np.array(value)
    with pytest.raises(Exception, match=message):
        counts.from_hdf5(spark, path()).counts.collect()


def test_without_the_library(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(InputError, match="h5py"):
        counts.from_hdf5(spark, "m.h5")
