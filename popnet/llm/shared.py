"""What the operators of this subpackage share.

Intermediate tables are written as Parquet under the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see it, so a lost executor costs
a recomputation of its own tasks only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from popnet.storage import delete_path, released, shared_dir, written

__all__ = ["bounded", "delete_path", "released", "shared_dir", "table", "tidied", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a worker handles at once.
SLICE = 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], at: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Each batch in views of at most ``most`` bytes in its column ``at``, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        total = sizes.cumsum()
        first = 0
        while first < batch.num_rows:
            before = int(total[first - 1]) if first else 0
            to = max(first + 1, int(total.searchsorted(before + most, side="right")))
            yield batch.slice(first, to - first)
            first = to


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, after which the worker gives unused memory back: it stays alive for tasks of other kinds."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
