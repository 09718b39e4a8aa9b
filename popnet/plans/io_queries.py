"""Queries that write the given tables in the domain's file formats and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from popnet.config import InferConfig, PrepareConfig
from popnet.operators import distance
from popnet.operators.ordering import numbered
from popnet.plans.infer import infer
from popnet.plans.prepare import prepare
from popnet.plans.queries import EMBEDDING_TFS, GROUPS, C, W, anchored, cells, entries, query, r, tfs, unit_cells
from popnet.sinks import CELL_WEIGHTS, dense, write_lines, write_text
from popnet.sources import counts, expression
from popnet.storage import shared_dir, written


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/popnet-{name}-{uuid.uuid4().hex}"


def expression_file(s: SparkSession, d: str) -> str:
    """``embeddings`` as a text matrix of dimensions x cells in the shared folder."""
    x = cells(s, d)
    order = numbered(x.select("cell"), ["cell"], into="cell_ord", size="n")
    placed = distance.exploded(x).join(order, "cell").select(F.format_string("d%02d", "dim").alias("gene"), "n", "cell_ord", "z")
    sparse = placed.where("z <> 0").groupBy("gene", "n").agg(F.collect_list("cell_ord").alias("at"), F.collect_list("z").alias("x"))
    ranged = sparse.withColumn("key", F.lit("")).repartitionByRange("gene").sortWithinPartitions("gene")
    names = [str(row[0]) for row in order.orderBy("cell_ord").select("cell").toLocalIterator()]  # the header's names
    path = f"{_folder(s, 'matrix')}/expression.tsv"
    write_lines(dense(ranged).select("value"), path, "\t".join(["gene", *names]))
    return path


@query("expression_text", "SELECT printf('d%02d', d) AS gene, CAST(vec_id AS VARCHAR) AS cell, CAST(embedding[d] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(d)")
def _(s, d):
    return expression.read(s, expression_file(s, d)).long().select("gene", "cell", "x")


@query("expression_by_cell", "SELECT CAST(vec_id AS VARCHAR) AS cell, CAST(ord AS INTEGER) AS cell_ord, CAST(dim AS BIGINT) AS dim, CAST(embedding[dim] AS DOUBLE) AS x FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS ord FROM embeddings), range(1, 65) t(dim)")
def _(s, d):
    """The matrix turned by pieces."""
    turned = expression.read(s, expression_file(s, d)).by_cell()
    return turned.select("cell", "cell_ord", F.posexplode("v").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long") + 1)


@query("weights_text", W + " SELECT target_group, cell, grp AS cell_group, round(d, 6) AS distance, round(w, 6) AS final_weight FROM w")
def _(s, d):
    """The weights as compressed text and back."""
    path = f"{_folder(s, 'weights')}/cell_weights.tsv.gz"
    write_text(anchored(s, d), path, CELL_WEIGHTS, ["target_group", "cell"], compress=True)
    kinds = ", ".join(f"{c} {'string' if c in ('target_group', 'cell_group', 'canonicalized_for_fitting') else 'long' if c == 'cell' else 'double'}" for c in CELL_WEIGHTS)
    back = s.read.schema(kinds).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)
    return back.select("target_group", "cell", "cell_group", r("distance"), r("final_weight"))


def _triplets(s: SparkSession, d: str) -> str:
    """The counts of brands by customers as a folder of matrix-market triplets."""
    x = written(entries(s, d), "counts")
    genes = written(numbered(x.select("gene").distinct(), ["gene"], into="i"), "features")
    columns = written(numbered(x.select("cell").distinct(), ["cell"], into="j"), "barcodes")
    folder = _folder(s, "triplets")
    by = lambda rows, c, value: rows.repartitionByRange(c).sortWithinPartitions(c).select(value.alias("value"))
    write_lines(by(genes, "i", F.concat_ws("\t", F.concat(F.lit("id-"), "gene"), "gene", F.lit("Gene Expression"))), f"{folder}/features.tsv.gz", compress=True)
    write_lines(by(columns, "j", F.col("cell").cast("string")), f"{folder}/barcodes.tsv.gz", compress=True)
    placed = x.join(genes, "gene").join(columns, "cell").select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.col("x").cast("long").alias("x"))
    head = f"%%MatrixMarket matrix coordinate integer general\n%\n{genes.count()} {columns.count()} {x.count()}"
    ranged = placed.repartitionByRange("j", "i").sortWithinPartitions("j", "i")
    write_lines(ranged.select(F.concat_ws(" ", "i", "j", "x").alias("value")), f"{folder}/matrix.mtx.gz", head, compress=True)
    return folder


@query("triplets_text", "SELECT p_brand AS gene, CAST(o_custkey AS VARCHAR) AS cell, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING sum(l_quantity) <> 0")
def _(s, d):
    m = counts.from_mex(s, _triplets(s, d), ".gz").checked()
    return m.counts.join(m.features, "feature_idx").join(m.barcodes, "barcode_idx").select(F.col("name").alias("gene"), "cell", "x")


@query("prepared_units", f"""WITH {C}, l AS (SELECT cell, sum(x) AS y FROM c GROUP BY cell), p AS (SELECT analysis_unit, gene, cell, x * (10000.0e0 / y) AS x FROM u JOIN l USING (cell)),
  k AS (SELECT analysis_unit, gene FROM p GROUP BY ALL HAVING count(*) >= 3), z AS (SELECT analysis_unit FROM ua GROUP BY ALL HAVING count(*) >= 5)
  SELECT analysis_unit, gene, CAST(cell AS VARCHAR) AS cell, round(ln(1 + x), 6) AS x FROM p JOIN k USING (analysis_unit, gene) JOIN z USING (analysis_unit)""")
def _(s, d):
    """A whole preparation: triplets, annotations and a list as files, published units read back."""
    folder = _folder(s, "prepare")
    write_text(unit_cells(s, d), f"{folder}/annotations.tsv", ["cell", "analysis_unit", "cluster"], ["cell"])
    write_lines(tfs(s).repartitionByRange(1, "ord").sortWithinPartitions("ord").select(F.col("gene").alias("value")), f"{folder}/tf_list.txt")
    config = PrepareConfig(
        counts=_triplets(s, d), annotations=f"{folder}/annotations.tsv", tf_list=f"{folder}/tf_list.txt", output_dir=f"{folder}/out", min_cells=5, min_gene_cells=3,
        uncounted_cells="exclude",  # customers whose orders have no lines: a unit's customers, but without counts
    )
    done = prepare(s, config)
    out = None
    for unit, path in zip(done.prepared_analysis_units, done.analysis_unit_directories, strict=True):
        one = expression.read(s, f"{path}/expression.tsv").long().where("x <> 0").select(F.lit(unit).alias("analysis_unit"), "gene", "cell", r("x"))
        out = one if out is None else out.unionByName(one)
    return out


@query("run_artifacts", W + GROUPS + """, k AS (SELECT count(DISTINCT label) AS g, count(*) AS n FROM embeddings)
  SELECT 'cell_weights.tsv.gz' AS artifact, CAST(count(*) AS BIGINT) AS n_rows, round(sum(w), 4) AS total FROM w UNION ALL SELECT 'weight_diagnostics.tsv', CAST(any_value(g * g) AS BIGINT), round(sum(w), 4) FROM w, k
  UNION ALL SELECT 'centroids.tsv', CAST(count(*) AS BIGINT), round(sum(mu), 4) FROM mu UNION ALL SELECT 'group_distances.tsv', CAST(count(*) AS BIGINT), round(sum(d), 4) FROM gd
  UNION ALL SELECT 'centroid_weights.tsv.gz', CAST(n AS BIGINT), CAST(g AS DOUBLE) FROM k
  UNION ALL SELECT 'model_diagnostics.tsv.gz', CAST(any_value(g) * 64 AS BIGINT), CAST(64 * count(*) FILTER (WHERE w > 0) AS DOUBLE) FROM w, k""")
def _(s, d):
    """A whole inference over files: rows and a total of each published table that doesn't depend on the trees."""
    folder = _folder(s, "run")
    groups = cells(s, d).select("cell", F.col("grp").alias("cluster"))
    write_text(groups, f"{folder}/groups.tsv", ["cell", "cluster"], ["cell"])
    listed = s.createDataFrame([(f"d{int(t[1:]):02d}", i) for i, t in enumerate(EMBEDDING_TFS)], "value string, ord int")
    write_lines(listed.repartitionByRange(1, "ord").sortWithinPartitions("ord").select("value"), f"{folder}/tf_list.txt")
    config = InferConfig(
        expression=expression_file(s, d), tf_list=f"{folder}/tf_list.txt", groups=f"{folder}/groups.tsv", output_dir=f"{folder}/out", distance_space="expression", n_estimators=2,
        group_size_correction="cap-to-target", report=False,
    )
    infer(s, config, checkpoint=False)
    totals = {
        "cell_weights.tsv.gz": "final_weight", "weight_diagnostics.tsv": "source_weight", "centroids.tsv": "centroid", "group_distances.tsv": "centroid_distance",
        "centroid_weights.tsv.gz": "normalized_centroid_weight", "model_diagnostics.tsv.gz": "n_positive_weight_samples",
    }
    out = None
    for name, column in totals.items():
        rows = s.read.option("sep", "\t").option("header", True).csv(f"{folder}/out/{name}")
        one = rows.agg(F.count("*").alias("n_rows"), F.round(F.sum(F.col(column).cast("double")), 4).alias("total")).select(F.lit(name).alias("artifact"), "n_rows", "total")
        out = one if out is None else out.unionByName(one)
    return out
