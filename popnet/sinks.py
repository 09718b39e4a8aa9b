"""Sinks: ordered text artifacts written by executors, JSON, and whole folders published at once.

A text artifact's rows are range partitioned by its order and sorted inside partitions;
executors format them and Spark's text writer stores the parts, in any store and with its own
commit of tasks.  The parts' files stand in the order of their partitions, so end to end they
are the sorted table; gzip members end to end are a valid gzip file, too.  What the
driver does is copy bytes: it never sees a row.  ``parts`` keeps the folder of parts instead.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from popnet.operators.checks import InputError, not_increasing, require_none
from popnet.storage import delete_path, shared_dir

# The columns of the artifacts.
NETWORK = ["source", "target", "score", "sign", "evidence", "context"]
CELL_WEIGHTS = ["target_group", "cell", "cell_group", "distance", "base_weight", "group_size_factor", "final_weight", "canonicalized_for_fitting"]
SKIPPED = ["target_group", "target", "reason", "detail"]

#: Bytes that are copied at once, and values of a dense line that are made at once.
BUFFER, STRETCH = 4 << 20, 1 << 14


def cell_text(value: object) -> str:
    """A value as the text artifacts write it: shortest round-trip numbers, ``True``/``False``, nothing for null."""
    return "" if value is None else repr(value) if isinstance(value, float) else str(value)


def _field(text: str, sep: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in (sep, '"', "\n", "\r")) else text


def lines(df: DataFrame, columns: list[str], order: list[str], sep: str = "\t") -> DataFrame:
    """(value): each row's line, in parts that follow each other in ``order``."""
    kept = df.select(*columns, *[c for c in order if c not in columns])
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[_field(cell_text(v), sep) for v in column.to_pylist()] for column in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(map(sep.join, zip(*texts, strict=True)), pa.string())], names=["value"])

    return ranged.mapInArrow(run, "value string")


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def absolute(path: str) -> str:
    """A path that doesn't depend on the working folder."""
    return path.rstrip("/") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else os.path.abspath(path)


def uri(path: str) -> str:
    """A path with its scheme; one without is local."""
    full = absolute(path)
    return "file://" + full if full.startswith("/") else full


def _new(spark: SparkSession, path: str):
    """An output stream of the JVM for a file that must not be there yet."""
    fs, target = _fs(spark, uri(path))
    if fs.exists(target):
        raise FileExistsError(f"Output path exists and is not overwritten: {path}")
    fs.setWriteChecksum(False)
    return fs.create(target, False)


def write_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """A small new file, in any store."""
    out = _new(spark, path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def joined(spark: SparkSession, folder: str, head: bytes, path: str) -> None:
    """A new file of ``head`` and the parts in ``folder``, in their order; bytes are copied inside the driver's JVM."""
    fs, top = _fs(spark, folder)
    parts = sorted((str(s.getPath().getName()), s.getPath()) for s in fs.listStatus(top) if str(s.getPath().getName()).startswith("part-"))
    out = _new(spark, path)
    try:
        out.write(bytearray(head))
        for _, part in sorted(parts, key=lambda p: int(p[0].split("-")[1])):
            stream = fs.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, BUFFER, False)
            finally:
                stream.close()
    finally:
        out.close()


def write_lines(values: DataFrame, path: str, head: str | None = None, compress: bool = False, parts: bool = False) -> int:
    """Write (value) as one new file behind the line ``head``, or (``parts``) as a new folder of parts and a header part; returns the rows."""
    spark = values.sparkSession
    folder = uri(path) if parts else f"{shared_dir(spark)}/popnet-text-{uuid.uuid4().hex}"
    fs, target = _fs(spark, folder)
    if fs.exists(target):
        raise FileExistsError(f"Output path exists and is not overwritten: {path}")
    seen = Observation("lines")
    values.observe(seen, F.count("*").alias("rows")).write.option("compression", "gzip" if compress else "none").option("lineSep", "\n").text(folder)
    first = b"" if head is None else (head + "\n").encode()
    first = gzip.compress(first, 6, mtime=0) if compress and first else first
    if parts:
        write_bytes(spark, first, f"{folder}/_header{'.gz' if compress else ''}")
    else:
        try:
            joined(spark, folder, first, path)
        finally:
            delete_path(spark, folder)
    return seen.get["rows"]


def write_text(df: DataFrame, path: str, columns: list[str], order: list[str], sep: str = "\t", compress: bool = False, parts: bool = False) -> int:
    """Write ``columns`` sorted by ``order`` as one new file (or folder of parts) with a header; returns the rows."""
    return write_lines(lines(df, columns, order, sep), path, sep.join(columns), compress, parts)


def write_network(edges: DataFrame, path: str) -> int:
    """The network as CSV by context, target and source; scores must be positive and finite, keys unique."""
    require_none(edges.where("not (score > 0) or score = double('Infinity')"), "source", "Edges without a positive finite score")
    keys = ["context", "target", "source"]
    repeated = edges.groupBy(*keys).count().where("count > 1").select(F.concat_ws("/", *keys).alias("key"))
    require_none(repeated, "key", "Repeated edges")
    return write_text(edges, path, NETWORK, keys, sep=",")


def assert_sorted(df: DataFrame, keys: list[str], order: str) -> None:
    """Raise if ``keys`` don't strictly increase along ``order``."""
    bad = not_increasing(df, keys, order).select(F.concat_ws("/", *keys).alias("key"))
    require_none(bad, "key", "Keys out of order")


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A new file with ``value`` as JSON text: keys in order, one to a line; numbers that JSON has no form for are an error."""
    write_bytes(spark, (json.dumps(value, indent=2, sort_keys=True, allow_nan=False, ensure_ascii=False) + "\n").encode(), path)


def unit_directory(number: int, name: str) -> str:
    """``unit-001-name`` with the name's letters and digits in ASCII."""
    ascii_ = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    slug = re.sub("[^a-z0-9]+", "-", ascii_).strip("-")[:64].rstrip("-") or "analysis"
    return f"unit-{number:03d}-{slug}"


def _numbers(listed: pa.ListScalar, kind: type) -> np.ndarray:
    return np.zeros(0, kind) if listed.values is None else listed.values.to_numpy(zero_copy_only=False)


def dense_line(gene: str, n: int, at: np.ndarray, x: np.ndarray) -> str:
    """The line of ``gene`` with ``x`` at the places ``at`` of ``n``; only STRETCH values at a time are objects of their own."""
    order = np.argsort(at, kind="stable")
    at, x = at[order], x[order]
    out = [_field(gene, "\t")]
    for start in range(0, n, STRETCH):
        own = slice(*np.searchsorted(at, (start, start + STRETCH)))
        texts = ["0.0"] * (min(n, start + STRETCH) - start)
        for i, v in zip((at[own] - start).tolist(), x[own].tolist(), strict=True):
            texts[i] = repr(v)
        out.append("\t".join(texts))
    return "\t".join(out)


def dense(sparse: DataFrame) -> DataFrame:
    """(key, value): the line of each row of ``sparse`` (key, gene, n, at, x): its gene and ``n`` values, tab separated, those that aren't listed zero.

    Rows keep their partitions and order; a dense line exists only while it is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, gene, n, at, x in zip(*batch.columns, strict=True):
                line = dense_line(gene.as_py(), n.as_py(), _numbers(at, np.int32), _numbers(x, np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.string()), pa.array([line], pa.string())], names=["key", "value"])

    return sparse.select("key", "gene", F.col("n").cast("int"), F.col("at").cast("array<int>"), F.col("x").cast("array<double>")).mapInArrow(run, "key string, value string")


def wide_lines(entries: DataFrame, genes: DataFrame, cells: DataFrame, n_cells: int) -> DataFrame:
    """(value) by gene_ord: the dense lines of ``genes`` (gene, gene_ord) over ``cells`` (cell, cell_ord), from ``entries`` (gene, cell, x)."""
    kept = entries.join(genes.select("gene"), "gene", "left_semi").join(cells.select("cell", "cell_ord"), "cell")
    sparse = kept.groupBy("gene").agg(F.collect_list("cell_ord").alias("at"), F.collect_list("x").alias("x"))
    rows = genes.join(sparse, "gene", "left").repartitionByRange("gene_ord").sortWithinPartitions("gene_ord")
    return dense(rows.select(F.lit("").alias("key"), "gene", F.lit(n_cells).alias("n"), "at", "x")).select("value")


POINTER = "_published"


def claim(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file that only one of several writers can: FileExistsError for the others."""
    full = uri(path)
    if full.startswith("file:"):  # Hadoop's local file system looks first and writes then
        with open(full.removeprefix("file://"), "xb") as f:
            f.write(data)
        return
    fs, target = _fs(spark, full)
    try:
        out = fs.create(target, False)  # atomic in a store that has the call
    except Exception as e:
        if fs.exists(target):
            raise FileExistsError(f"Output path exists and is not overwritten: {path}") from e
        raise
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def resolved(spark: SparkSession, final: str) -> str:
    """The folder with a run's files: ``final`` itself, or the one that its pointer names."""
    fs, pointer = _fs(spark, f"{uri(final)}/{POINTER}")
    if not fs.exists(pointer):
        return final
    stream = fs.open(pointer)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{final.rstrip('/')}/{name}"


@contextmanager
def published(spark: SparkSession, final: str, pointer: bool | None = None) -> Iterator[str]:
    """A folder that becomes ``final`` as a whole when the block ends well, never over an existing one.

    Local paths: a hidden folder beside ``final`` takes its name.  Other stores (or
    ``pointer``) have no such rename: files go to a folder of their own below ``final``, and
    what publishes them is one pointer that only one run can create; ``resolved`` follows it.
    A run that fails or loses the race removes its own folder, and nothing else is seen.
    """
    full = uri(final)
    pointer = not full.startswith("file:") if pointer is None else pointer
    fs, target = _fs(spark, full)
    there = f"{full}/{POINTER}" if pointer else full
    if fs.exists(_fs(spark, there)[1]) or (pointer and fs.exists(target) and any(not str(s.getPath().getName()).startswith(("run-", "_")) for s in fs.listStatus(target))):
        raise FileExistsError(f"Output path exists and is not overwritten: {final}")
    name = f"run-{uuid.uuid4().hex}"
    staging = f"{full}/{name}" if pointer else f"{os.path.dirname(full)}/.{os.path.basename(full)}.staging-{name}"
    fs.mkdirs(_fs(spark, staging)[1])
    done = False
    try:
        yield staging
        if pointer:
            claim(spark, there, name.encode())
        else:
            if os.path.lexists(full.removeprefix("file://")):
                raise FileExistsError(f"Output path appeared meanwhile: {final}")
            os.rename(staging.removeprefix("file://"), full.removeprefix("file://"))
        done = True
    finally:
        if not done:
            delete_path(spark, staging)


def require_rows(n: int, what: str) -> None:
    """Raise for an artifact without rows."""
    if not n:
        raise InputError(f"No rows for {what}")
