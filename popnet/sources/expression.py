"""Expression matrices as text: one scan that checks, parses and stores.

A line is a gene, a field a cell.  Lines are cut and parsed in one pass that writes them as
Parquet; every rule is a metric observed beside that write (``DataFrame.observe``), so a
file of any size is read once, by tasks that hold a line each.  Repeated genes are found on
the stored names alone.  A gene's values are stored in pieces of ``PIECE`` cells: rows stay
small whatever the number of cells, and the matrix is turned (cells in rows) by pieces.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from popnet.functions.columns import finite, identifier_fault
from popnet.operators.checks import InputError, duplicate_keys, require_none
from popnet.operators.ordering import numbered
from popnet.storage import released, written

#: First headers that name another kind of table.
RESERVED = frozenset("cell cells sample samples timepoint timepoints perturbation perturbations cluster pseudotime".split())
#: Cells of a stored piece.
PIECE = 256
ROWS = "gene string, gene_ord long, first int, y array<double>"
#: What can be wrong with a line, in the order of the checks, and what the error says.
FAULTS = {
    "bytes": "Lines that are not valid UTF-8", "empty": "Empty lines", "quotes": "Lines with unbalanced quotes", "fields": "Rows without {n} fields",
    "gene": "Invalid gene identifiers", "number": "Values that are no finite numbers",
}


def header(spark: SparkSession, path: str) -> list[str]:
    """The fields of a file's first line."""
    line = spark.read.text(path).first()
    if line is None or line[0] is None:
        raise InputError(f"{path} is empty")
    try:
        return next(csv.reader(io.StringIO(line[0].removeprefix("﻿")), delimiter="\t", strict=True), [])
    except csv.Error as e:
        raise InputError(f"{path} has no readable header: {e}") from e


def check_header(fields: list[str], what: str) -> None:
    """Non-empty, trimmed, unique fields without control characters, two at least."""
    if len(fields) < 2:
        hint = "; it looks comma separated" if fields and "," in fields[0] else ""
        raise InputError(f"{what} needs at least two tab-separated columns{hint}")
    if any(not f or f != f.strip() or any(c in f for c in "\0\r\n") for f in fields):
        raise InputError(f"{what} has empty or untrimmed column names, or such with control characters")
    seen: set[str] = set()
    twice = sorted({f for f in fields if f in seen or seen.add(f)})
    if twice:
        raise InputError(f"{what} repeats columns: {', '.join(twice[:8])}")


@dataclass(frozen=True)
class Expression:
    """A stored matrix: pieces of gene rows, and the names of its cells in order."""

    rows: DataFrame  # ROWS
    names: tuple[str, ...]
    n_genes: int

    @classmethod
    def of(cls, spark: SparkSession, matrix: np.ndarray, genes: list[str], cells: list[str]) -> Expression:
        """A matrix (genes x cells) that the driver has; an action."""
        x = np.asarray(matrix, np.float64)
        if x.shape != (len(genes), len(cells)) or not x.size:
            raise InputError("The matrix needs a row for each gene and a column for each cell, and one of each at least")
        check_header([" ".join(["gene", *cells]).replace(" ", "-"), *cells], "The matrix")  # a first name that no cell has
        if not np.isfinite(x).all():
            raise InputError("The matrix has values that are not finite")
        pieces = [(g, i, at, x[i, at : at + PIECE].tolist()) for i, g in enumerate(genes) for at in range(0, len(cells), PIECE)]
        rows = written(spark.createDataFrame(pieces, ROWS), "expression")
        require_none(duplicate_keys(rows.where("first = 0"), "gene"), "gene", "Duplicate genes")
        return cls(rows, tuple(cells), len(genes))

    @classmethod
    def of_rows(cls, values: DataFrame) -> Expression:
        """A complete matrix as (gene, cell, x), genes and cells in the order of their names; an action.  Names of cells reach the driver, values don't."""
        values = written(values.select(F.col("gene").cast("string").alias("gene"), F.col("cell").cast("string").alias("cell"), F.col("x").cast("double").alias("x")), "values")
        genes = written(numbered(values.select("gene").distinct(), ["gene"], into="gene_ord"), "genes")
        cells = written(numbered(values.select("cell").distinct(), ["cell"], into="cell_ord"), "cells")
        found = values.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))).alias("bad")).first()
        names, n_genes = [r["cell"] for r in cells.orderBy("cell_ord").select("cell").toLocalIterator()], genes.count()
        if not found["n"] or found["bad"] or found["n"] != n_genes * len(names):
            raise InputError(f"A complete matrix has a finite value for each gene and cell: {found['n']} values, {found['bad']} not finite, {n_genes} genes, {len(names)} cells")
        placed = values.join(cells, "cell").join(genes, "gene").withColumn("first", (F.col("cell_ord") - F.col("cell_ord") % PIECE).cast("int"))
        y = F.transform(F.array_sort(F.collect_list(F.struct("cell_ord", "x"))), lambda s: s["x"])
        return cls(written(placed.groupBy("gene", "gene_ord", "first").agg(y.alias("y")), "expression"), tuple(names), n_genes)

    @cached_property
    def named(self) -> DataFrame:
        """(first, names): the cells' names by pieces, as a table; an action.  In a plan they would be planned, folded and printed with every query."""
        pieces = [(at, list(self.names[at : at + PIECE])) for at in range(0, len(self.names), PIECE)]
        return written(self.rows.sparkSession.createDataFrame(pieces, "first int, names array<string>"), "cell-names")

    def cells(self) -> DataFrame:
        """(cell, cell_ord)."""
        return self.named.select("first", F.posexplode("names").alias("at", "cell")).select("cell", (F.col("first") + F.col("at")).alias("cell_ord"))

    def genes(self) -> DataFrame:
        """(gene, gene_ord)."""
        return self.rows.where("first = 0").select("gene", "gene_ord")

    def long(self) -> DataFrame:
        """(gene, cell, x, gene_ord, cell_ord), a row a value."""
        pieces = self.rows.join(self.named, "first")
        each = pieces.select("gene", "gene_ord", "first", F.posexplode(F.arrays_zip(F.col("names").alias("cell"), F.col("y").alias("x"))).alias("at", "v"))
        return each.select("gene", F.col("v.cell").alias("cell"), F.col("v.x").alias("x"), "gene_ord", (F.col("first") + F.col("at")).alias("cell_ord"))

    def vectors(self) -> DataFrame:
        """(gene, y): a gene's values over all cells, in order."""
        return vectors(self.rows)

    def by_cell(self) -> DataFrame:
        """(cell, cell_ord, v): a cell's values over all genes, in order."""
        return turned(self.rows).join(self.cells(), "cell_ord").select("cell", "cell_ord", "v")


def vectors(rows: DataFrame) -> DataFrame:
    """(gene, y) from pieces."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("first", "y"))), lambda p: p["y"])
    return rows.groupBy("gene").agg(F.flatten(pieces).alias("y"))


def turned(rows: DataFrame) -> DataFrame:
    """(cell_ord, v): the matrix with cells in rows; the same cells' pieces of all genes meet, so whole pieces are shuffled, not values."""

    def turn(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by("gene_ord")
        x = pieces.column("y").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(pieces.num_rows, -1).T
        flat = pa.array(np.ascontiguousarray(x).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)
        return pa.table({"cell_ord": pa.array(key[0].as_py() + np.arange(len(x)), pa.int32()), "v": lists})

    return rows.groupBy("first").applyInArrow(turn, "cell_ord int, v array<double>")


def _fields(line: Column) -> tuple[Column, Column]:
    """A line's fields, and whether its quotes are balanced; a quoted field may hold tabs and doubled quotes."""
    plain = F.split(line, "\t", -1)
    found = F.regexp_extract_all(line, F.lit('(?:^|\t)("(?:[^"]|"")*"(?=\t|$)|(?!")[^\t]*)'), F.lit(0))
    # every match but the first begins with the tab before it
    texts = F.transform(found, lambda p, i: F.when(i == 0, p).otherwise(F.substr(p, F.lit(2))))
    fine = F.array_join(texts, "\t") == line
    open_ = lambda p: F.when(p.startswith('"'), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p)
    quoted = F.contains(line, F.lit('"'))
    return F.when(quoted, F.transform(texts, open_)).otherwise(plain), ~quoted | fine


def _parsed(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(line, at, f, fine, y): the lines behind the header, cut and read as numbers (null: none); ``at`` is in the file's order."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("at")).where("at > 0")
    fields, fine = _fields(F.col("line"))
    cut = lines.select("line", "at", fields.alias("f"), fine.alias("fine"))
    return cut.withColumn("y", F.transform(F.slice("f", 2, max(1, n - 1)), finite))


def _fault(n: int) -> Column:
    """What is wrong with a line, or null."""
    first = F.get("f", F.lit(0))
    return (
        F.when(~F.is_valid_utf8("line"), "bytes").when(F.col("line") == "", "empty").when(~F.col("fine"), "quotes").when(F.size("f") != n, "fields")
        .when(identifier_fault(first).isNotNull(), "gene").when(F.exists("y", lambda x: x.isNull()), "number")
    )


def _said() -> Column:
    """What an error says of a line's fault: its gene, and for a number the cell's place and the text too."""
    at = F.array_position(F.transform("y", lambda x: x.isNull()), True).cast("int")
    gene = F.when(F.col("fault") == "bytes", "?").otherwise(F.coalesce(F.substr(F.get("f", F.lit(0)), F.lit(1), F.lit(80)), F.lit("")))
    return F.struct(gene.alias("gene"), at.alias("at"), F.get("f", at).alias("text"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gene, gene_ord, y) to ROWS, a line at a time: its pieces are views of it."""
    for batch in batches:
        for gene, at, y in zip(*batch.columns, strict=True):
            values = y.values
            first = np.arange(0, len(values), PIECE)
            pieces = pa.ListArray.from_arrays(pa.array([*first, len(values)], pa.int32()), values)
            same = lambda v, kind: pa.array([v.as_py()] * len(first), kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([same(gene, pa.string()), same(at, pa.int64()), pa.array(first, pa.int32()), pieces], names=["gene", "gene_ord", "first", "y"])


def read(spark: SparkSession, path: str) -> Expression:
    """Read, check and store a genes x cells table of tab-separated values; an action, one scan."""
    names = header(spark, path)
    check_header(names, "The expression matrix")
    if names[0].strip().lower() in RESERVED:
        raise InputError(f"The first column is called {names[0]!r}: cells belong in columns and genes in rows")
    n = len(names)
    seen = Observation("expression")
    marked = _parsed(spark, path, n).withColumn("fault", _fault(n))
    bad = F.col("fault").isNotNull()
    first = F.min(F.when(bad, F.struct("at", "fault", _said().alias("said"))))
    marked = marked.observe(seen, F.count("*").alias("genes"), F.count_if(bad).alias("faulty"), first.alias("first"), *[F.count_if(F.col("fault") == k).alias(k) for k in FAULTS])
    # a faulty line is stored as nothing: the error comes when the scan is over
    stored = marked.where(~bad).select(F.get("f", F.lit(0)).alias("gene"), F.col("at").alias("gene_ord"), "y").mapInArrow(_cut, ROWS)
    rows = written(stored, "expression")
    try:
        got = seen.get
        if got["faulty"]:
            what = got["first"]["fault"]
            more = f" and {got[what] - 1} more lines" if got[what] > 1 else ""
            said = got["first"]["said"]
            text = "/".join([said["gene"], names[said["at"]], said["text"]]) if what == "number" else said["gene"]
            raise InputError(f"{FAULTS[what].format(n=n)}: {text!r}{more}")
        if not got["genes"]:
            raise InputError("The expression matrix has a header but no gene rows")
        require_none(duplicate_keys(rows.where("first = 0"), "gene"), "gene", "Duplicate genes")
    except InputError:
        released(rows)
        raise
    return Expression(rows, tuple(names[1:]), got["genes"])
