"""Validation operators: each returns the rows that break a rule; ``require_none`` raises on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from popnet.functions.columns import finite, identifier_fault
from popnet.storage import written

#: Offending values that an error message names.
PREVIEW = 8


class InputError(ValueError):
    """An input breaks its contract."""


def require_none(found: DataFrame, column: str, message: str, preview: int = PREVIEW) -> None:
    """Raise InputError with the first offending values if ``found`` has rows.  An action over at most ``preview + 1`` rows."""
    some = [r[0] for r in found.select(F.col(column).cast("string")).orderBy(column).limit(preview + 1).collect()]
    if some:
        rest = f" and {found.count() - preview} more" if len(some) > preview else ""
        raise InputError(f"{message}: {', '.join(map(repr, some[:preview]))}{rest}")


def identifier_violations(df: DataFrame, name: str) -> DataFrame:
    """(name, fault): empty, untrimmed or control-character identifiers."""
    return df.select(F.col(name).alias("name"), identifier_fault(F.col(name)).alias("fault")).where("fault is not null")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_from(listed: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Rows of ``listed`` whose key is unknown."""
    return listed.join(known.select(on), on, "left_anti")


def not_finite(df: DataFrame, value: str) -> DataFrame:
    """Rows whose text is no finite number."""
    return df.where(finite(F.col(value)).isNull())


def coverage(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(key, side): keys that only one side has; ``side`` names the one that has it."""
    a = left.select(F.col(on).alias("key")).distinct().withColumn("l", F.lit(True))
    b = right.select(F.col(on).alias("key")).distinct().withColumn("r", F.lit(True))
    one = a.join(b, "key", "full_outer").where("l is null or r is null")
    return one.select("key", F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def orientation(genes: DataFrame, cells: DataFrame, group_cells: DataFrame, tfs: DataFrame) -> DataFrame:
    """One row (groups_are_genes, tfs_are_cells): a matrix given cells by genes shows in them."""
    g, c = genes.select(F.col("name")).distinct(), cells.select(F.col("name")).distinct()
    k, t = group_cells.select(F.col("name")).distinct(), tfs.select(F.col("name")).distinct()
    count = lambda df, alias: df.agg(F.count("*").alias(alias))
    one = (
        count(g.exceptAll(k), "a").crossJoin(count(k.exceptAll(g), "b")).crossJoin(count(t.exceptAll(c), "d")).crossJoin(count(t.exceptAll(g), "e"))
    )
    return one.select(((F.col("a") == 0) & (F.col("b") == 0)).alias("groups_are_genes"), ((F.col("d") == 0) & (F.col("e") > 0)).alias("tfs_are_cells"))


def not_rectangular(lines: DataFrame, fields: Column, expected: int) -> DataFrame:
    """Rows whose number of fields isn't ``expected``."""
    return lines.where(F.size(fields) != expected)


def not_increasing(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order) of rows whose key repeats the one before it or lies behind a larger ``order``.

    Rows are range partitioned by key and compared with the row before inside a partition;
    the first row of a partition is compared with the last one of the partition before, so
    no window runs over all rows.
    """
    ranged = df.select(*keys, F.col(order).alias("__order")).repartitionByRange(*keys, "__order").withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "sorted")
    key = F.struct(*keys)
    ends = ranged.groupBy("__part").agg(F.max_by("__order", F.struct(*keys, "__order")).alias("__last"), F.max(key).alias("__key"))
    by_part = Window.orderBy("__part")  # one row per partition
    before = ends.select("__part", F.lag("__last").over(by_part).alias("__prev"), F.lag("__key").over(by_part).alias("__prev_key"))
    inside = Window.partitionBy("__part").orderBy(*keys, "__order")
    rows = ranged.join(before, "__part")
    last = F.when(F.row_number().over(inside) == 1, F.col("__prev")).otherwise(F.lag("__order").over(inside))
    last_key = F.when(F.row_number().over(inside) == 1, F.col("__prev_key")).otherwise(F.lag(key).over(inside))
    rows = rows.select(*keys, F.col("__order").alias(order), (last > F.col("__order")).alias("__behind"), (last_key == key).alias("__same"))
    return rows.where("__behind or __same").select(*keys, order)
