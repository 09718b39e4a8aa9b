"""Sparse count matrices: coordinate tables, matrix-market triplets, and HDF5 where h5py is there.

A count source is three tables: counts (feature_idx, barcode_idx, x), features
(feature_idx, name, id, feature_type) and barcodes (barcode_idx, cell).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from popnet.operators.checks import InputError, duplicate_keys, require_none
from popnet.operators.prepare import invalid_counts
from popnet.storage import written

COUNTS = "feature_idx int, barcode_idx int, x double"


@dataclass(frozen=True)
class CountMatrix:
    """The three tables."""

    counts: DataFrame
    features: DataFrame
    barcodes: DataFrame

    def checked(self) -> CountMatrix:
        """Raise on invalid counts, indices outside the matrix and repeated barcodes."""
        require_none(invalid_counts(self.counts).select(F.col("x").cast("string").alias("x")), "x", "Counts that are negative or not finite")
        for c, t in (("feature_idx", self.features), ("barcode_idx", self.barcodes)):
            require_none(self.counts.join(t.select(c), c, "left_anti").select(c), c, f"Entries outside the matrix: {c}")
        require_none(duplicate_keys(self.barcodes, "cell"), "cell", "Repeated barcodes")
        return self


def from_parquet(spark: SparkSession, path: str) -> CountMatrix:
    """``path`` with counts, features and barcodes as Parquet."""
    return CountMatrix(*[spark.read.parquet(f"{path}/{t}") for t in ("counts", "features", "barcodes")])


def from_mex(spark: SparkSession, path: str, suffix: str = "") -> CountMatrix:
    """``path`` with matrix.mtx, features.tsv and barcodes.tsv (``suffix`` such as ``.gz``): triplets from 1; an action.

    A compressed file is one task's, so each one is parsed once and stored, the entries spread by their columns: checks and all that follows
    read the stored tables, and no later task is the matrix's only one.
    """
    lines = spark.read.text(f"{path}/matrix.mtx{suffix}").where(~F.col("value").startswith("%"))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    shape = next(iter(parts.limit(1).collect()), None)
    if shape is None:
        raise InputError("The matrix has no size line")
    rows = parts.withColumn("at", F.monotonically_increasing_id()).where("at > 0")
    entries = rows.select((F.get("p", F.lit(0)).cast("int") - 1).alias("feature_idx"), (F.get("p", F.lit(1)).cast("int") - 1).alias("barcode_idx"), F.get("p", F.lit(2)).cast("double").alias("x"))
    counts = written(entries.repartition("barcode_idx"), "triplets")

    def numbered(name: str) -> DataFrame:
        lines = spark.read.text(f"{path}/{name}.tsv{suffix}").coalesce(1)
        return written(lines.select(F.monotonically_increasing_id().cast("int").alias("at"), F.split("value", "\t").alias("f")), name)

    feature = numbered("features")
    features = feature.select(F.col("at").alias("feature_idx"), F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(0)).alias("id"), F.coalesce(F.get("f", F.lit(2)), F.lit("Gene Expression")).alias("feature_type"))
    cells = numbered("barcodes").select(F.col("at").alias("barcode_idx"), F.get("f", F.lit(0)).alias("cell"))
    stated = [int(x) for x in shape["p"][:3]]
    for what, table, n in zip(("features", "barcodes", "entries"), (features, cells, counts), stated, strict=True):
        if (found := table.count()) != n:
            raise InputError(f"The matrix states {n} {what}, but there are {found}")
    return CountMatrix(counts, features, cells)


#: Stored entries of one partition of an HDF5 matrix, and of one Arrow batch, about.
PART_ENTRIES, BATCH_ENTRIES = 1 << 22, 1 << 18
TABLES = {"counts": COUNTS, "features": "feature_idx int, name string, id string, feature_type string", "barcodes": "barcode_idx int, cell string"}


class _Part(InputPartition):
    def __init__(self, start: int, end: int, column: int = 0) -> None:
        self.start, self.end, self.column = start, end, column


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise InputError("HDF5 matrices need h5py, which is not installed; give coordinates as Parquet or matrix-market files") from e
    return h5py


def entry_parts(pointers: np.ndarray, entries: int, most: int) -> list[_Part]:
    """Parts of at most ``most`` stored entries each, with the column that a part's first entry is in: a long column is cut, short ones go together."""
    if not len(pointers) or pointers[0] != 0 or pointers[-1] != entries or (pointers[1:] < pointers[:-1]).any():
        raise InputError("The matrix's column pointers do not rise from zero to the number of entries")
    starts = np.arange(0, entries, most)
    columns = np.searchsorted(pointers, starts, side="right") - 1
    return [_Part(int(a), int(min(a + most, entries)), int(c)) for a, c in zip(starts, columns, strict=True)]


class _Reader(DataSourceReader):
    """One table of a feature-barcode matrix as Arrow batches; every partition opens the file itself."""

    def __init__(self, options: dict) -> None:
        self.path, self.table, self.most = options["path"], options.get("table", "counts"), int(options.get("entries", PART_ENTRIES))

    def partitions(self) -> list[InputPartition]:
        with _h5py().File(self.path, "r") as f:
            m = f["matrix"]
            if self.table == "counts":
                if len(m["indices"]) != len(m["data"]) or len(m["indptr"]) != int(m["shape"][1]) + 1:
                    raise InputError("The matrix's parts differ in length")
                return entry_parts(np.asarray(m["indptr"][:], np.int64), len(m["data"]), self.most)
            n = len(m["barcodes"] if self.table == "barcodes" else m["features/id"])
        return [_Part(a, min(n, a + self.most)) for a in range(0, n, self.most)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        with _h5py().File(self.path, "r") as f:
            m = f["matrix"]
            for a in range(partition.start, partition.end, BATCH_ENTRIES):
                b = min(partition.end, a + BATCH_ENTRIES)
                yield self._counts(m, a, b, partition.column) if self.table == "counts" else self._names(m, a, b)

    def _counts(self, m, a: int, b: int, column: int) -> pa.RecordBatch:
        """Entries a to b; their columns come from the pointers behind ``column``."""
        shape = m["shape"]
        pointers = np.asarray(m["indptr"][column : int(shape[1]) + 1], np.int64)
        features = np.asarray(m["indices"][a:b], np.int64)
        if len(features) and (features.min() < 0 or features.max() >= int(shape[0])):
            raise InputError("Entries outside the matrix: feature_idx")
        columns = column + np.searchsorted(pointers, np.arange(a, b), side="right") - 1
        values = np.asarray(m["data"][a:b], np.float64)
        return pa.RecordBatch.from_arrays([pa.array(features, pa.int32()), pa.array(columns, pa.int32()), pa.array(values)], names=["feature_idx", "barcode_idx", "x"])

    def _names(self, m, a: int, b: int) -> pa.RecordBatch:
        text = lambda key: pa.array([v.decode() if isinstance(v, bytes) else str(v) for v in m[key][a:b]], pa.string())
        at = pa.array(np.arange(a, b), pa.int32())
        if self.table == "barcodes":
            return pa.RecordBatch.from_arrays([at, text("barcodes")], names=["barcode_idx", "cell"])
        return pa.RecordBatch.from_arrays([at, text("features/name"), text("features/id"), text("features/feature_type")], names=["feature_idx", "name", "id", "feature_type"])


class SparseHdf5(DataSource):
    """``spark.read.format("sparse_hdf5").option("table", "counts").load(path)``: a table of a feature-barcode matrix (counts, features or barcodes)."""

    @classmethod
    def name(cls) -> str:
        return "sparse_hdf5"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "counts")]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def from_hdf5(spark: SparkSession, path: str, entries: int = PART_ENTRIES) -> CountMatrix:
    """A feature-barcode HDF5 matrix, read by executors in parts of equal numbers of stored entries.  Needs h5py on driver and executors, and a path that both can open."""
    _h5py()
    spark.dataSource.register(SparseHdf5)
    return CountMatrix(*[spark.read.format("sparse_hdf5").option("table", t).option("entries", entries).load(path) for t in TABLES])
