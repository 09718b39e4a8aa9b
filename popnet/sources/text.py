"""Text inputs: expression matrices, gene lists, groups, weights and annotations.

Lines are read by Spark's text source, which takes off a byte order mark and knows all
three line ends.  A line's number in its file is its order; it comes from the file as one
split only where the order is semantic (lists), else from the data's own positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.functions.columns import finite
from popnet.operators.checks import InputError, coverage, duplicate_keys, identifier_violations, missing_from, orientation, require_none
from popnet.sources import expression as expression_source
from popnet.sources.expression import Expression, check_header, header

def fingerprint(spark: SparkSession, path: str) -> dict:
    """SHA-256 and size of a file's exact bytes, streamed inside the JVM from any store; a size that changes meanwhile is an error."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(target).getLen()
    stream = fs.open(target)
    try:
        digest = jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
    if fs.getFileStatus(target).getLen() != size:
        raise InputError(f"{path} changed while it was read")
    return {"path": path, "bytes": size, "sha256": digest}


def _valid_utf8(spark: SparkSession, path: str) -> None:
    """Raise for a line whose bytes are no UTF-8; lines keep their bytes until they are decoded."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).select(F.lit(path).alias("path")).limit(1)
    require_none(bad, "path", "Not valid UTF-8")


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """(gene, cell, x, gene_ord, cell_ord) from a genes x cells table of tab-separated values, checked."""
    return expression_source.read(spark, path).long()


def read_list(spark: SparkSession, path: str, what: str = "gene list") -> DataFrame:
    """(gene, ord): one identifier a line; no blank lines, repeats or tabs.  Lists are small: the order comes from one partition."""
    lines = spark.read.text(path, wholetext=False).coalesce(1).select(F.col("value").alias("gene"), F.monotonically_increasing_id().alias("ord"))
    if lines.isEmpty():
        raise InputError(f"The {what} is empty")
    require_none(identifier_violations(lines, "gene"), "name", f"Invalid identifiers in the {what}")
    require_none(lines.where(F.col("gene").contains("\t")), "gene", f"Tabs in the {what}")
    require_none(duplicate_keys(lines, "gene"), "gene", f"Repeated identifiers in the {what}")
    return lines


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(cell, grp): the first column and the column ``cluster``; others are ignored."""
    names = header(spark, path)
    check_header(names, "The groups table")
    if "cluster" not in names[1:]:
        raise InputError("The groups table has no column 'cluster' behind its first one")
    rows = _table(spark, path).select(F.col(f"`{names[0]}`").alias("cell"), F.col("cluster").alias("grp"))
    for c in ("cell", "grp"):
        require_none(identifier_violations(rows, c), "name", f"Invalid values of {c} in the groups table")
    require_none(duplicate_keys(rows, "cell"), "cell", "Cells with several groups")
    return rows


def read_centroid_weights(spark: SparkSession, path: str) -> DataFrame:
    """(cell, centroid_weight): exactly these columns; positive finite weights."""
    if header(spark, path) != ["cell", "centroid_weight"]:
        raise InputError("Centroid weights have exactly the columns cell and centroid_weight")
    rows = _table(spark, path)
    require_none(duplicate_keys(rows, "cell"), "cell", "Cells with several centroid weights")
    out = rows.select("cell", finite(F.col("centroid_weight")).alias("centroid_weight"))
    require_none(out.where("centroid_weight is null or centroid_weight <= 0"), "cell", "Centroid weights that are not positive and finite")
    return out


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(cell, analysis_unit, cluster): exactly these columns, in any order."""
    if sorted(header(spark, path)) != ["analysis_unit", "cell", "cluster"]:
        raise InputError("Annotations have exactly the columns cell, analysis_unit and cluster")
    rows = _table(spark, path).select("cell", "analysis_unit", "cluster")
    for c in rows.columns:
        require_none(identifier_violations(rows, c), "name", f"Invalid values of {c} in the annotations")
    require_none(duplicate_keys(rows, "cell"), "cell", "Cells annotated more than once")
    return rows


def require_coverage(cells: DataFrame, table_: DataFrame, what: str) -> None:
    """Every cell once in the table and no other; raise with the missing and unexpected ones."""
    gaps = coverage(cells.select("cell"), table_.select("cell"), "cell")
    require_none(gaps.where("side = 'left'"), "key", f"Cells missing from the {what}")
    require_none(gaps.where("side = 'right'"), "key", f"Unexpected cells in the {what}")


def load_inputs(spark: SparkSession, expression: str, tf_list: str, groups: str, target_list: str | None = None, centroid_weights: str | None = None) -> tuple[Expression, dict[str, DataFrame]]:
    """Read and check all inputs together: the expression, and tfs, groups, and targets and weights where given."""
    for path in filter(None, (tf_list, groups, target_list, centroid_weights)):
        _valid_utf8(spark, path)
    x = expression_source.read(spark, expression)
    genes, cells = x.genes().select("gene"), x.cells().select("cell")
    found = {"tfs": read_list(spark, tf_list, "list of transcription factors"), "groups": read_groups(spark, groups)}
    turned = orientation(
        genes.select(F.col("gene").alias("name")), cells.select(F.col("cell").alias("name")), found["groups"].select(F.col("cell").alias("name")), found["tfs"].select(F.col("gene").alias("name"))
    ).first()
    if turned["groups_are_genes"] or turned["tfs_are_cells"]:
        raise InputError("The expression matrix seems to have cells in rows and genes in columns")
    require_none(missing_from(found["tfs"], genes, "gene"), "gene", "Transcription factors that are not in the expression matrix")
    require_coverage(cells, found["groups"], "groups table")
    if target_list:
        found["targets"] = read_list(spark, target_list, "target list")
        require_none(missing_from(found["targets"], genes, "gene"), "gene", "Targets that are not in the expression matrix")
    if centroid_weights:
        found["centroid_weights"] = read_centroid_weights(spark, centroid_weights)
        require_coverage(cells, found["centroid_weights"], "centroid weights")
    return x, found
