"""The queries of ``__spark_entry__``: each operator on the given tables, with SQL that checks it.

The tables stand for the domain's inputs: ``embeddings`` are cells (vec_id) of groups
(label) in a space of dimensions; ``lineitem``, ``orders`` and ``part`` are sparse counts
(cell: customer, feature: brand, count: quantity), ``customer``, ``nation`` and ``region``
their annotations (analysis unit: region, cluster: market segment); ``events`` are small
counts (cell: user, feature: event type).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from popnet.functions import columns as fn
from popnet.operators import checks, diagnostics, distance, forest, prepare, quantiles, representation, resampling, sampling, screening, weighting
from popnet.operators.ordering import numbered
from popnet.operators.trees import ForestParams
from popnet.plans.infer import fit
from popnet.sinks import dense
from popnet.storage import written
from popnet.streaming.checkpoint import completed_counts, remaining

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Transcription factors of the count mapping; the last one is no brand.
TFS = ["Brand#11", "Brand#23", "Brand#35", "Brand#47", "Brand#99"]
EMBEDDING_TFS = [f"d{i}" for i in (1, 5, 9, 13, 17, 21)]
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def r(c: str, alias: str | None = None) -> F.Column:
    """A double rounded for comparison: sums differ in their last digits from engine to engine."""
    return F.round(F.col(c), DIGITS).alias(alias or c)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- the mappings


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(cell, grp, v)."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("cell"), F.col("label").cast("string").alias("grp"), F.col("embedding").cast("array<double>").alias("v"))


def with_weight(spark: SparkSession, d: str) -> DataFrame:
    """(cell, grp, v, centroid_weight): weights from 0.5 to 1.5 by the cell's number."""
    return cells(spark, d).withColumn("centroid_weight", F.lit(0.5) + (F.col("cell") % 11) / F.lit(10.0))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(feature, cell, x), with repeated coordinates."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return rows.select(F.col("p_brand").alias("gene"), F.col("o_custkey").alias("cell"), F.col("l_quantity").cast("double").alias("x"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(gene, cell, x), canonical."""
    return prepare.canonical(counts(spark, d), "gene", "cell")


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """(cell, analysis_unit, cluster) of all customers."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    g = table(spark, d, "region").select("r_regionkey", "r_name")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return rows.select(F.col("c_custkey").alias("cell"), F.col("r_name").alias("analysis_unit"), F.col("c_mktsegment").alias("cluster"))


def unit_entries(spark: SparkSession, d: str) -> DataFrame:
    """(analysis_unit, cluster, cell, gene, x) of annotated cells with counts."""
    return entries(spark, d).join(annotations(spark, d), "cell")


def ordering(spark: SparkSession, d: str) -> DataFrame:
    """(cell): customers that order."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("cell")).distinct()


def unit_cells(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of the customers that order."""
    return annotations(spark, d).join(ordering(spark, d), "cell", "left_semi")


def tfs(spark: SparkSession) -> DataFrame:
    """(gene, ord)."""
    return spark.createDataFrame(list(zip(TFS, range(len(TFS)), strict=True)), "gene string, ord int")


def brands(spark: SparkSession, d: str) -> DataFrame:
    """(gene): all brands."""
    return table(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct()


def expression(spark: SparkSession, d: str) -> DataFrame:
    """(gene, cell, grp, x): the embeddings' dimensions d1, d2, ... as genes."""
    rows = distance.exploded(cells(spark, d))
    return rows.select(F.concat(F.lit("d"), "dim").alias("gene"), "cell", "grp", F.col("z").alias("x"))


def embedding_tfs(spark: SparkSession) -> DataFrame:
    """(gene, ord)."""
    return spark.createDataFrame(list(zip(EMBEDDING_TFS, range(len(EMBEDDING_TFS)), strict=True)), "gene string, ord int")


def anchored(spark: SparkSession, d: str, mode: str = "cell-distance-group-anchored", kernel: str = "gaussian", metric: str = "cosine", correction: str = "cap-to-target") -> DataFrame:
    """Weights of the embeddings' cells."""
    c = cells(spark, d)
    means = written(distance.centroids(c), "centroids")
    sizes = weighting.group_sizes(c)
    between = distance.group_distances(means, metric)
    # distances are read three times below: one pass of the matrix products, then the table
    by_cell = None if mode == "group-distance" else written(distance.cell_distances(c, means, metric), "distances")
    h = written(weighting.bandwidth(between.where("target_group < source_group") if by_cell is None else by_cell), "bandwidth")
    return weighting.weights(c, sizes, h, mode, kernel, correction, by_cell, between)


def stored_weights(spark: SparkSession, d: str) -> DataFrame:
    """The anchored weights as a table, for audits that read them several times."""
    return written(anchored(spark, d), "weights")


# ---- the same in SQL

E = """e AS (SELECT vec_id AS cell, CAST(label AS VARCHAR) AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT cell, grp, unnest(v) AS z, generate_subscripts(v, 1) AS dim FROM e)"""
MEANS = E + ", mu AS (SELECT grp, dim, avg(z) AS mu FROM x GROUP BY grp, dim)"
COSINE = MEANS + """, cs AS (SELECT cell, x.grp AS grp, mu.grp AS target_group, 1.0e0 - sum(z * mu) / (sqrt(sum(z * z)) * sqrt(sum(mu * mu))) AS d
  FROM x JOIN mu USING (dim) GROUP BY ALL), cd AS (SELECT cell, grp, target_group, CASE WHEN d <= 1e-13 THEN 0.0e0 ELSE least(d, 2.0e0) END AS d FROM cs)"""
EUCLID = MEANS + """, cd AS (SELECT cell, x.grp AS grp, mu.grp AS target_group, sqrt(sum((z - mu) * (z - mu))) AS d FROM x JOIN mu USING (dim) GROUP BY ALL)"""
SIZES = ", sz AS (SELECT grp, count(*) AS n FROM e GROUP BY grp)"
GROUPS = """, gd AS (SELECT a.grp AS target_group, b.grp AS source_group, CASE WHEN a.grp = b.grp THEN 0.0e0 ELSE
  1.0e0 - sum(a.mu * b.mu) / (sqrt(sum(a.mu * a.mu)) * sqrt(sum(b.mu * b.mu))) END AS d FROM mu a JOIN mu b USING (dim) GROUP BY a.grp, b.grp)"""
BAND = ", h AS (SELECT quantile_cont(d, 0.5) AS h, count(*) AS n FROM cd WHERE d > 0)"
GBAND = ", h AS (SELECT quantile_cont(d, 0.5) AS h, count(*) AS n FROM gd WHERE target_group < source_group AND d > 0)"


def weight_sql(mode: str, kernel: str) -> str:
    """CTEs that end in ``w``."""
    k = "exp(-0.5e0 * (d / h) * (d / h))" if kernel == "gaussian" else "exp(-(d / h))"
    if mode == "group-distance":
        head = MEANS + GROUPS + GBAND + SIZES + ", dd AS (SELECT e.cell, e.grp, gd.target_group, gd.d FROM e JOIN gd ON gd.source_group = e.grp)"
    else:
        head = COSINE + BAND + SIZES + ", dd AS (SELECT * FROM cd)"
    base = k if mode == "cell-distance" else f"CASE WHEN dd.grp = target_group THEN 1.0e0 ELSE {k} END"
    norm = "f.b * f.f / max(f.b * f.f) OVER (PARTITION BY target_group)" if mode == "cell-distance" else "f.b * f.f"
    return head + f""", f AS (SELECT cell, dd.grp AS grp, target_group, d, {base} AS b, CASE WHEN dd.grp = target_group THEN 1.0e0 ELSE least(1.0e0, CAST(t.n AS DOUBLE) / s.n) END AS f
  FROM dd CROSS JOIN h JOIN sz t ON t.grp = target_group JOIN sz s ON s.grp = dd.grp),
raw AS (SELECT *, {norm} AS raw FROM f),
w AS (SELECT *, CASE WHEN raw > 0 AND raw <= 2.220446049250313e-16 * sum(raw) OVER (PARTITION BY target_group) THEN 0.0e0 ELSE raw END AS w FROM raw)"""


C = """c0 AS (SELECT p_brand AS gene, o_custkey AS cell, CAST(l_quantity AS DOUBLE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
c AS (SELECT gene, cell, sum(x) AS x FROM c0 GROUP BY gene, cell HAVING sum(x) <> 0),
a AS (SELECT c_custkey AS cell, r_name AS analysis_unit, c_mktsegment AS cluster FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT * FROM c JOIN a USING (cell)), oc AS (SELECT DISTINCT o_custkey AS cell FROM orders), ua AS (SELECT * FROM a WHERE cell IN (SELECT cell FROM oc))"""
T = f"tf AS (SELECT unnest({TFS}) AS gene, generate_subscripts({TFS}, 1) - 1 AS ord)"
XT = f"xt AS (SELECT unnest({EMBEDDING_TFS}) AS gene)"
G = ", g AS (SELECT 'd' || dim AS gene, cell, grp, z AS x FROM x)"


# ---- scans and validation


@query("scan_unpivot", f"WITH {E} SELECT CAST(cell AS BIGINT) AS cell, grp, CAST(dim AS BIGINT) AS dim, round(z, 6) AS z FROM x")
def _(s, d):
    return distance.exploded(cells(s, d)).select("cell", "grp", F.col("dim").cast("long").alias("dim"), r("z"))


@query("coo_scan", f"WITH {C} SELECT gene, cell, CAST(count(*) AS BIGINT) AS n FROM c0 GROUP BY gene, cell")
def _(s, d):
    return counts(s, d).groupBy("gene", "cell").agg(F.count("*").alias("n"))


@query("groups_project", "SELECT vec_id AS cell, CAST(label AS VARCHAR) AS grp FROM embeddings")
def _(s, d):
    return cells(s, d).select("cell", "grp")


@query("identifier_violations", """SELECT name, CASE WHEN name IS NULL OR trim(name) = '' THEN 'empty' ELSE 'untrimmed' END AS fault FROM
  (SELECT CASE WHEN c_custkey % 7 = 0 THEN ' ' || c_name WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name FROM customer)
  WHERE name IS NULL OR trim(name) = '' OR name LIKE ' %'""")
def _(s, d):
    k = F.col("c_custkey")
    names = table(s, d, "customer").select(F.when(k % 7 == 0, F.concat(F.lit(" "), "c_name")).when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("name"))
    return checks.identifier_violations(names, "name")


@query("finite_filter", """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'NaN' WHEN event_id % 17 = 0 THEN 'Infinity' WHEN event_id % 19 = 0 THEN 'x' ELSE '1d' END AS text FROM events
  WHERE event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0""")
def _(s, d):
    k = F.col("event_id")
    text = F.when(k % 13 == 0, "NaN").when(k % 17 == 0, "Infinity").when(k % 19 == 0, "x").when(k % 23 == 0, "1d").otherwise(F.col("value").cast("string"))
    return checks.not_finite(table(s, d, "events").select("event_id", text.alias("text")), "text")


@query("duplicate_keys", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(s, d):
    return checks.duplicate_keys(table(s, d, "orders"), "o_custkey")


@query("tf_missing_antijoin", f"WITH {T} SELECT gene FROM tf WHERE gene NOT IN (SELECT p_brand FROM part)")
def _(s, d):
    return checks.missing_from(tfs(s), brands(s, d), "gene").select("gene")


@query("orientation_check", f"""WITH {T}, b AS (SELECT DISTINCT p_brand AS name FROM part), cu AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS name FROM customer),
  k AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS name FROM orders)
  SELECT (SELECT count(*) FROM (SELECT name FROM b EXCEPT SELECT name FROM k)) = 0 AND (SELECT count(*) FROM (SELECT name FROM k EXCEPT SELECT name FROM b)) = 0 AS groups_are_genes,
  (SELECT count(*) FROM (SELECT gene FROM tf EXCEPT SELECT name FROM cu)) = 0 AND (SELECT count(*) FROM (SELECT gene FROM tf EXCEPT SELECT name FROM b)) > 0 AS tfs_are_cells""")
def _(s, d):
    names = lambda df, c: df.select(F.col(c).cast("string").alias("name"))
    return checks.orientation(names(brands(s, d), "gene"), names(table(s, d, "customer"), "c_custkey"), names(table(s, d, "orders"), "o_custkey"), names(tfs(s), "gene"))


@query("feature_type_filter", "SELECT event_id AS feature_idx, user_id AS barcode_idx FROM events WHERE event_type = 'purchase'")
def _(s, d):
    e = table(s, d, "events").withColumn("feature_type", F.when(F.col("event_type") == "purchase", prepare.GENE_EXPRESSION).otherwise(F.col("event_type")))
    return prepare.gene_expression(e).select(F.col("event_id").alias("feature_idx"), F.col("user_id").alias("barcode_idx"))


@query("distinct_groups", "SELECT CAST(label AS VARCHAR) AS grp, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY label")
def _(s, d):
    return weighting.group_sizes(cells(s, d)).select("grp", "n")


@query("sha256_ids", "SELECT vec_id AS cell, sha256(CAST(vec_id AS VARCHAR)) AS sha, substring(sha256(CAST(vec_id AS VARCHAR)), 1, 16) AS hash FROM embeddings")
def _(s, d):
    return cells(s, d).select("cell", F.sha2(F.col("cell").cast("string"), 256).alias("sha"), fn.name_hash(F.col("cell")).alias("hash"))


@query("count_validation", "SELECT event_id FROM events WHERE value IS NULL OR value - 50 < 0")
def _(s, d):
    return prepare.invalid_counts(table(s, d, "events").select("event_id", (F.col("value") - 50).alias("x"))).select("event_id")


@query("ordered_keys", "SELECT event_id, user_id FROM (SELECT *, lag(event_id) OVER (ORDER BY user_id, event_id) AS before FROM events) WHERE before > event_id")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.col("event_id").alias("at"))
    return checks.not_increasing(e, ["user_id", "event_id"], "at").select("event_id", "user_id")


# ---- joins


@query("group_coverage_full_outer", """SELECT coalesce(c.k, o.k) AS key, CASE WHEN c.k IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) c
  FULL JOIN (SELECT DISTINCT user_id AS k FROM events) o ON c.k = o.k WHERE c.k IS NULL OR o.k IS NULL""")
def _(s, d):
    return checks.coverage(table(s, d, "customer").select(F.col("c_custkey").alias("cell")), table(s, d, "events").select(F.col("user_id").alias("cell")).distinct(), "cell")


@query("annotation_join_counts", f"""WITH {C} SELECT CAST((SELECT count(*) FROM oc JOIN a USING (cell)) AS BIGINT) AS annotated,
  CAST((SELECT count(*) FROM a WHERE cell NOT IN (SELECT cell FROM oc)) AS BIGINT) AS without_counts, CAST((SELECT count(*) FROM oc WHERE cell NOT IN (SELECT cell FROM a)) AS BIGINT) AS excluded""")
def _(s, d):
    a, o = annotations(s, d).select("cell", F.lit(True).alias("annotated")), ordering(s, d).withColumn("ordered", F.lit(True))
    both = a.join(o, "cell", "full_outer")
    return both.agg(
        F.count_if(F.col("annotated") & F.col("ordered")).alias("annotated"), F.count_if(F.col("ordered").isNull()).alias("without_counts"), F.count_if(F.col("annotated").isNull()).alias("excluded")
    )


@query("tf_semi", f"WITH {T} SELECT gene, CAST(ord AS INTEGER) AS ord FROM tf WHERE gene IN (SELECT p_brand FROM part)")
def _(s, d):
    return tfs(s).join(brands(s, d), "gene", "left_semi").select("gene", "ord")


@query("tf_anti", f"WITH {T} SELECT gene, CAST(ord AS INTEGER) AS ord FROM tf WHERE gene NOT IN (SELECT p_brand FROM part)")
def _(s, d):
    return checks.missing_from(tfs(s), brands(s, d), "gene").select("gene", "ord")


@query("unit_tf_intersection", f"WITH {C}, {T} SELECT DISTINCT analysis_unit, gene FROM u WHERE gene IN (SELECT gene FROM tf)")
def _(s, d):
    return prepare.unit_tfs(prepare.unit_genes(unit_entries(s, d)), tfs(s))


@query("target_semijoin", f"WITH {E}{G} SELECT gene, cell, round(x, 6) AS x FROM g WHERE gene IN ('d2', 'd3', 'd5')")
def _(s, d):
    wanted = s.createDataFrame([("d2",), ("d3",), ("d5",)], "gene string")
    return expression(s, d).join(F.broadcast(wanted), "gene", "left_semi").select("gene", "cell", r("x"))


@query("candidate_pairs", f"""WITH {E}{G}, {XT}, t AS (SELECT DISTINCT grp AS target_group, gene AS target FROM g),
  k AS (SELECT grp AS target_group, gene FROM g WHERE gene IN (SELECT gene FROM xt) GROUP BY grp, gene HAVING min(CAST(x AS FLOAT)) = max(CAST(x AS FLOAT)))
  SELECT target_group, target, xt.gene AS source FROM t CROSS JOIN xt WHERE target <> xt.gene AND NOT EXISTS (SELECT 1 FROM k WHERE k.target_group = t.target_group AND k.gene = xt.gene)""")
def _(s, d):
    x = expression(s, d)
    positive = cells(s, d).select(F.col("grp").alias("target_group"), "cell")
    spread = screening.ranges(x.select("gene", "cell", "x"), positive)
    constants = screening.constant_predictors(spread, embedding_tfs(s))
    targets = spread.select("target_group", F.col("gene").alias("target"))
    return screening.candidate_pairs(targets, embedding_tfs(s), constants)


MODELS = f"""WITH {E}, m AS (SELECT DISTINCT grp AS target_group, 'd' || dim AS target, dim FROM x), done AS (SELECT target_group, target FROM m WHERE dim % 3 = 0)"""


def _requested(s, d):
    m = distance.exploded(cells(s, d)).select(F.col("grp").alias("target_group"), F.concat(F.lit("d"), "dim").alias("target"), "dim").distinct()
    return m.drop("dim"), m.where("dim % 3 = 0").drop("dim")


@query("resume_antijoin", MODELS + " SELECT target_group, target FROM m WHERE (target_group, target) NOT IN (SELECT target_group, target FROM done)")
def _(s, d):
    return remaining(*_requested(s, d))


@query("resume_counts", MODELS + " SELECT target_group, CAST(count(*) AS BIGINT) AS completed FROM done GROUP BY target_group")
def _(s, d):
    return completed_counts(_requested(s, d)[1])


# ---- preparation


@query("coo_canonicalize", f"WITH {C} SELECT gene, cell, round(x, 6) AS x FROM c")
def _(s, d):
    return entries(s, d).select("gene", "cell", r("x"))


@query("gene_collapse_sum", """WITH f AS (SELECT p_partkey AS feature_idx, p_brand AS name FROM part), q AS (SELECT l_partkey AS feature_idx, l_orderkey AS barcode_idx, sum(CAST(l_quantity AS DOUBLE)) AS x
  FROM lineitem GROUP BY ALL HAVING sum(l_quantity) <> 0), g AS (SELECT name AS gene, min(feature_idx) AS gene_ord FROM f GROUP BY name)
  SELECT gene, gene_ord, barcode_idx, round(sum(x), 6) AS x FROM q JOIN f USING (feature_idx) JOIN g ON gene = name GROUP BY gene, gene_ord, barcode_idx""")
def _(s, d):
    q = table(s, d, "lineitem").select(F.col("l_partkey").alias("feature_idx"), F.col("l_orderkey").alias("barcode_idx"), F.col("l_quantity").alias("x"))
    f = table(s, d, "part").select(F.col("p_partkey").alias("feature_idx"), F.col("p_brand").alias("name"), F.lit(prepare.GENE_EXPRESSION).alias("feature_type"))
    genes, rows = prepare.collapse_genes(q, f)
    return rows.join(F.broadcast(genes), "gene").select("gene", "gene_ord", "barcode_idx", r("x"))


@query("library_size", f"WITH {C} SELECT cell, round(sum(x), 6) AS library FROM c GROUP BY cell")
def _(s, d):
    return prepare.library_sizes(entries(s, d)).select("cell", r("library"))


@query("library_summary", f"WITH {C}, l AS (SELECT sum(x) AS y FROM c GROUP BY cell) SELECT round(min(y), 6) AS minimum, round(quantile_cont(y, 0.5), 6) AS median, round(max(y), 6) AS maximum FROM l")
def _(s, d):
    sizes = prepare.library_sizes(entries(s, d))
    ends = sizes.agg(F.min("library").alias("minimum"), F.max("library").alias("maximum"))
    return quantiles.exact_quantiles(sizes, [], "library", {"median": 0.5}).crossJoin(ends).select(r("minimum"), r("median"), r("maximum"))


@query("library_size_log1p", f"WITH {C}, l AS (SELECT cell, sum(x) AS y FROM c GROUP BY cell) SELECT gene, cell, round(ln(1 + x * (10000.0e0 / y)), 6) AS x FROM c JOIN l USING (cell)")
def _(s, d):
    return prepare.normalised(entries(s, d)).select("gene", "cell", r("x"))


@query("gene_detection", f"WITH {C} SELECT analysis_unit, gene, CAST(count(*) AS BIGINT) AS n_cells FROM u GROUP BY ALL")
def _(s, d):
    return prepare.unit_gene_detection(unit_entries(s, d))


@query("unit_eligibility", f"""WITH {C}, {T}, k AS (SELECT analysis_unit, gene FROM u GROUP BY ALL HAVING count(*) >= 30),
  n AS (SELECT analysis_unit, count(*) AS n_cells FROM ua GROUP BY ALL), g AS (SELECT analysis_unit, count(*) AS n_genes, count(*) FILTER (WHERE gene IN (SELECT gene FROM tf)) AS n_tfs FROM k GROUP BY ALL)
  SELECT analysis_unit, CAST(n_cells AS BIGINT) AS n_cells, CAST(coalesce(n_genes, 0) AS BIGINT) AS n_genes, CAST(coalesce(n_tfs, 0) AS BIGINT) AS n_tfs,
  CASE WHEN n_cells < 300 THEN 'below-min-cells' WHEN coalesce(n_genes, 0) = 0 THEN 'no-genes-after-filtering' WHEN coalesce(n_tfs, 0) = 0 THEN 'no-transcription-factors-after-filtering' END AS exclusion_reason
  FROM n LEFT JOIN g USING (analysis_unit)""")
def _(s, d):
    return prepare.unit_eligibility(unit_cells(s, d), prepare.unit_genes(unit_entries(s, d), 30), tfs(s), 300)


@query("unit_group_sizes", f"WITH {C} SELECT analysis_unit, cluster, CAST(count(*) AS BIGINT) AS n_cells FROM ua GROUP BY ALL")
def _(s, d):
    return prepare.unit_group_sizes(unit_cells(s, d))


@query("unit_slug", """SELECT c_name AS name, CASE WHEN slug = '' THEN 'analysis' ELSE slug END AS slug FROM
  (SELECT c_name, rtrim(substring(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64), '-') AS slug FROM customer)""")
def _(s, d):
    return table(s, d, "customer").select(F.col("c_name").alias("name"), fn.slug(F.col("c_name")).alias("slug"))


def _wide(s: SparkSession, d: str) -> DataFrame:
    """(key, gene, fields, filled) of the dense lines of every unit, in one job."""
    rows = written(unit_entries(s, d).select(F.col("analysis_unit").alias("key"), "gene", "cell", "x"), "unit-entries")
    order = numbered(rows.select("key", "cell").distinct(), ["cell"], ["key"], "cell_ord", "n")
    sparse = rows.join(order, ["key", "cell"]).groupBy("key", "gene", "n").agg(F.collect_list("cell_ord").alias("at"), F.collect_list("x").alias("x"))
    cut = dense(sparse).select("key", F.split("value", "\t").alias("f"))
    values = F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(1)))
    return cut.select("key", F.get("f", F.lit(0)).alias("gene"), F.size(values).cast("long").alias("fields"), F.size(F.filter(values, lambda v: v != "0.0")).cast("long").alias("filled"))


@query("wide_rows", f"WITH {C}, n AS (SELECT DISTINCT cell FROM u WHERE analysis_unit = 'ASIA') SELECT gene, CAST((SELECT count(*) FROM n) AS BIGINT) AS fields, CAST(count(*) AS BIGINT) AS filled FROM u WHERE analysis_unit = 'ASIA' GROUP BY gene")
def _(s, d):
    return _wide(s, d).where("key = 'ASIA'").drop("key")


@query("wide_rows_by_unit", f"WITH {C}, n AS (SELECT analysis_unit, count(DISTINCT cell) AS cells FROM u GROUP BY ALL) SELECT analysis_unit, gene, CAST(any_value(cells) AS BIGINT) AS fields, CAST(count(*) AS BIGINT) AS filled FROM u JOIN n USING (analysis_unit) GROUP BY analysis_unit, gene")
def _(s, d):
    return _wide(s, d).withColumnRenamed("key", "analysis_unit")


# ---- distances


@query("standardize", f"""WITH {E}, t AS (SELECT dim, avg(z) AS m, stddev_pop(z) AS s FROM x GROUP BY dim)
  SELECT cell, CAST(dim AS BIGINT) AS dim, round((z - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM x JOIN t USING (dim)""")
def _(s, d):
    return distance.exploded(distance.standardised(cells(s, d))).select("cell", F.col("dim").cast("long").alias("dim"), r("z"))


@query("centroids", f"WITH {MEANS} SELECT grp, CAST(dim AS BIGINT) AS dim, round(mu, 6) AS mu FROM mu")
def _(s, d):
    return distance.centroids(cells(s, d)).select("grp", F.col("dim").cast("long").alias("dim"), r("mu"))


@query("weighted_centroids", f"""WITH {E}, y AS (SELECT *, 0.5e0 + (cell % 11) / 10.0e0 AS w FROM x) SELECT grp, CAST(dim AS BIGINT) AS dim, round(sum(w * z) / sum(w), 6) AS mu FROM y GROUP BY grp, dim""")
def _(s, d):
    return distance.centroids(with_weight(s, d), "centroid_weight").select("grp", F.col("dim").cast("long").alias("dim"), r("mu"))


CW = E + ", y AS (SELECT cell, grp, 0.5e0 + (cell % 11) / 10.0e0 AS w FROM e)"


@query("normalized_centroid_weights", f"WITH {CW} SELECT cell, grp, round(w, 6) AS centroid_weight, round(w / sum(w) OVER (PARTITION BY grp), 9) AS normalized_centroid_weight FROM y")
def _(s, d):
    rows = weighting.normalised_centroid_weights(with_weight(s, d))
    return rows.select("cell", "grp", r("centroid_weight"), F.round("normalized_centroid_weight", 9).alias("normalized_centroid_weight"))


@query("centroid_weight_diag", f"""WITH {CW} SELECT grp, CAST(count(*) AS BIGINT) AS n_cells, round(sum(w), 6) AS weight_sum, round(min(w), 6) AS min_weight, round(quantile_cont(w, 0.5), 6) AS median_weight,
  round(max(w), 6) AS max_weight, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_sample_size FROM y GROUP BY grp""")
def _(s, d):
    rows = weighting.centroid_weight_diagnostics(with_weight(s, d))
    return rows.select("grp", "n_cells", *[r(c) for c in ("weight_sum", "min_weight", "median_weight", "max_weight", "effective_sample_size")])


@query("cell_centroid_euclidean", f"WITH {EUCLID} SELECT cell, grp, target_group, round(d, 6) AS distance FROM cd")
def _(s, d):
    c = cells(s, d)
    return distance.cell_distances(c, distance.centroids(c), "euclidean").select("cell", "grp", "target_group", r("distance"))


@query("cell_centroid_cosine", f"WITH {COSINE} SELECT cell, grp, target_group, round(d, 6) AS distance FROM cd")
def _(s, d):
    c = cells(s, d)
    return distance.cell_distances(c, distance.centroids(c), "cosine").select("cell", "grp", "target_group", r("distance"))


@query("stable_euclidean", f"WITH {EUCLID} SELECT cell, target_group, round(d, 6) AS distance FROM cd")
def _(s, d):
    # coordinates of 1e-200 have squares of zero: the scaled path must give the distances all the same
    c = cells(s, d).withColumn("v", F.transform("v", lambda x: x * 1e-200))
    found = distance.cell_distances(c, distance.centroids(c), "euclidean")
    return found.select("cell", "target_group", F.round(F.col("distance") * 1e200, 6).alias("distance"))


@query("group_distances", f"WITH {MEANS}{GROUPS} SELECT target_group, source_group, round(d, 6) AS distance FROM gd")
def _(s, d):
    return distance.group_distances(distance.centroids(cells(s, d))).select("target_group", "source_group", r("distance"))


@query("zero_norm_rows", "SELECT vec_id AS cell FROM embeddings WHERE vec_id % 50 = 0")
def _(s, d):
    zeroed = cells(s, d).withColumn("v", F.when(F.col("cell") % 50 == 0, F.transform("v", lambda x: x * 0)).otherwise(F.col("v")))
    return distance.zero_norm_rows(zeroed)


@query("cumulative_ratio", "SELECT CAST(label AS BIGINT) AS component, round(n, 6) AS ratio, round(sum(n) OVER (ORDER BY label), 6) AS cumulative FROM (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS n FROM embeddings GROUP BY label)")
def _(s, d):
    e = table(s, d, "embeddings")
    total = e.agg(F.count("*").alias("all"))
    share = e.groupBy(F.col("label").cast("long").alias("component")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("component", (F.col("n") / F.col("all")).alias("ratio"))
    return distance.cumulative(share).select("component", r("ratio"), r("cumulative"))


# ---- weights


@query("bandwidth", f"WITH {COSINE}{BAND} SELECT round(h, 6) AS bandwidth, CAST(n AS BIGINT) AS positive_count FROM h")
def _(s, d):
    c = cells(s, d)
    return weighting.bandwidth(distance.cell_distances(c, distance.centroids(c))).select(r("bandwidth"), "positive_count")


@query("bandwidth_group", f"WITH {MEANS}{GROUPS}{GBAND} SELECT round(h * 0.5, 6) AS bandwidth, CAST(n AS BIGINT) AS positive_count FROM h")
def _(s, d):
    between = distance.group_distances(distance.centroids(cells(s, d)))
    return weighting.bandwidth(between.where("target_group < source_group"), scale=0.5).select(r("bandwidth"), "positive_count")


for _kernel in ("gaussian", "exponential"):
    _formula = "exp(-0.5e0 * d / h * d / h)" if _kernel == "gaussian" else "exp(-(d / h))"

    @query(f"kernel_{_kernel}", f"WITH {EUCLID}{BAND} SELECT cell, target_group, round({_formula}, 6) AS affinity FROM cd CROSS JOIN h")
    def _(s, d, kernel=_kernel):
        c = cells(s, d)
        by_cell = distance.cell_distances(c, distance.centroids(c), "euclidean")
        h = weighting.bandwidth(by_cell)
        rows = by_cell.crossJoin(F.broadcast(h))
        return rows.select("cell", "target_group", F.round(fn.kernel(kernel, F.col("distance"), F.col("bandwidth")), DIGITS).alias("affinity"))


@query("size_factor", f"WITH {E}{SIZES} SELECT t.grp AS target_group, s.grp AS source_group, round(CASE WHEN t.grp = s.grp THEN 1.0e0 ELSE least(1.0e0, CAST(t.n AS DOUBLE) / s.n) END, 6) AS factor FROM sz t CROSS JOIN sz s")
def _(s, d):
    z = weighting.group_sizes(cells(s, d))
    pairs = z.select(F.col("grp").alias("target_group"), F.col("n").alias("nt")).crossJoin(F.broadcast(z.select(F.col("grp").alias("source_group"), F.col("n").alias("ns"))))
    factor = fn.size_factor("cap-to-target", F.col("nt"), F.col("ns"), F.col("target_group") == F.col("source_group"))
    return pairs.select("target_group", "source_group", F.round(factor, DIGITS).alias("factor"))


@query("group_sizes", f"WITH {E}{SIZES} SELECT grp, CAST(n AS BIGINT) AS n FROM sz")
def _(s, d):
    return weighting.group_sizes(cells(s, d))


for _name, _mode, _k in (
    ("weights_cell_distance", "cell-distance", "gaussian"), ("weights_anchored", "cell-distance-group-anchored", "gaussian"),
    ("weights_group_distance", "group-distance", "gaussian"), ("weights_anchored_exponential", "cell-distance-group-anchored", "exponential"),
):

    @query(_name, f"WITH {weight_sql(_mode, _k)} SELECT target_group, cell, grp AS cell_group, round(d, 6) AS distance, round(b, 6) AS base_weight, round(f, 6) AS group_size_factor, round(w, 6) AS final_weight FROM w")
    def _(s, d, mode=_mode, kernel=_k):
        w = anchored(s, d, mode, kernel)
        return w.select("target_group", "cell", "cell_group", *[r(c) for c in ("distance", "base_weight", "group_size_factor", "final_weight")])


@query("canonicalize", """WITH b AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS target_group, l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_quantity * 1e-18 ELSE CAST(l_quantity AS DOUBLE) END AS w FROM lineitem),
  t AS (SELECT target_group, sum(w) AS s FROM b GROUP BY ALL)
  SELECT target_group, CAST(count(*) FILTER (WHERE w > 0 AND w <= 2.220446049250313e-16 * s) AS BIGINT) AS zeroed, CAST(count(*) FILTER (WHERE w > 2.220446049250313e-16 * s) AS BIGINT) AS kept FROM b JOIN t USING (target_group) GROUP BY ALL""")
def _(s, d):
    li = table(s, d, "lineitem")
    w = F.when(F.col("l_linenumber") == 1, F.col("l_quantity") * F.lit(1e-18)).otherwise(F.col("l_quantity").cast("double"))
    rows = weighting.canonical(li.select((F.col("l_suppkey") % 5).cast("string").alias("target_group"), w.alias("raw_weight")))
    return rows.groupBy("target_group").agg(F.count_if((F.col("raw_weight") > 0) & (F.col("final_weight") == 0)).alias("zeroed"), F.count_if(F.col("final_weight") > 0).alias("kept"))


@query("group_affinities", f"""WITH {MEANS}{GROUPS}{GBAND}{SIZES} SELECT target_group, source_group, round(d, 6) AS distance, round(CASE WHEN target_group = source_group THEN 1.0e0 ELSE exp(-0.5e0 * (d / h) * (d / h)) END, 6) AS base_affinity,
  round(CASE WHEN target_group = source_group THEN 1.0e0 ELSE least(1.0e0, CAST(t.n AS DOUBLE) / s.n) END, 6) AS group_size_factor FROM gd CROSS JOIN h JOIN sz t ON t.grp = target_group JOIN sz s ON s.grp = source_group""")
def _(s, d):
    c = cells(s, d)
    between = distance.group_distances(distance.centroids(c))
    rows = weighting.affinities(between, weighting.group_sizes(c), weighting.bandwidth(between.where("target_group < source_group")))
    return rows.select("target_group", "source_group", r("distance"), r("base_affinity"), r("group_size_factor"))


# ---- diagnostics

W = "WITH " + weight_sql("cell-distance-group-anchored", "gaussian")


@query("ess", W + " SELECT target_group, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_sample_size FROM w GROUP BY target_group")
def _(s, d):
    return diagnostics.weight_summary(anchored(s, d), quantiles=False).select("target_group", r("effective_sample_size"))


@query("weight_mass", W + """, m AS (SELECT target_group, grp AS source_group, sum(w) AS m FROM w GROUP BY ALL) SELECT target_group, source_group, target_group = source_group AS source_is_target,
  round(m, 6) AS source_weight, round(m / sum(m) OVER (PARTITION BY target_group) * 100, 6) AS source_mass_percent FROM m""")
def _(s, d):
    return diagnostics.weight_mass(stored_weights(s, d)).select("target_group", "source_group", "source_is_target", r("source_weight"), r("source_mass_percent"))


@query("weight_diagnostics", W + """ SELECT target_group, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(*) FILTER (WHERE grp = target_group) AS BIGINT) AS n_target_cells, round(sum(w), 6) AS total_weight,
  round(sum(w) FILTER (WHERE grp = target_group), 6) AS target_weight, round(coalesce(sum(w) FILTER (WHERE grp <> target_group), 0), 6) AS external_weight, round(min(w), 6) AS min_weight, round(max(w), 6) AS max_weight,
  round(avg(w), 6) AS mean_weight, round(quantile_cont(w, 0.5), 6) AS median_weight, CAST(count(*) FILTER (WHERE w > 0) AS BIGINT) AS positive_cell_count FROM w GROUP BY target_group""")
def _(s, d):
    rows = diagnostics.weight_summary(stored_weights(s, d))
    doubles = ("total_weight", "target_weight", "external_weight", "min_weight", "max_weight", "mean_weight", "median_weight")
    return rows.select("target_group", "n_cells", "n_target_cells", *[r(c) for c in doubles], "positive_cell_count")


@query("weight_quartiles", W + """ SELECT target_group, grp AS source_group, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(w, 0.25), 6) AS q25, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.75), 6) AS q75,
  round(min(w), 6) AS min, round(max(w), 6) AS max, round(avg(w), 6) AS mean, CAST(count(*) FILTER (WHERE w > 0) AS BIGINT) AS positive FROM w GROUP BY ALL""")
def _(s, d):
    return diagnostics.weight_quartiles(stored_weights(s, d)).select("target_group", "source_group", "n", *[r(c) for c in ("q25", "median", "q75", "min", "max", "mean")], "positive")


@query("weight_warnings", W + """, t AS (SELECT target_group, count(*) AS n, sum(w) AS s, sum(w) * sum(w) / sum(w * w) AS ess, sum(w) FILTER (WHERE grp = target_group) AS own FROM w GROUP BY ALL),
  m AS (SELECT target_group, grp, sum(w) AS m FROM w GROUP BY ALL), dom AS (SELECT target_group, string_agg(grp, ',' ORDER BY grp) AS g FROM m JOIN t USING (target_group) WHERE grp <> target_group AND m / s > 0.05 GROUP BY ALL)
  SELECT target_group, s <= 0 AS degenerate, ess < greatest(2, 0.9 * n) AS low_ess, s - own > own AS external_exceeds_target, coalesce(g, '') AS dominant FROM t LEFT JOIN dom USING (target_group)""")
def _(s, d):
    w = stored_weights(s, d)
    flags = diagnostics.warning_flags(diagnostics.weight_summary(w, quantiles=False), diagnostics.weight_mass(w), 0.9, 0.05)
    return flags.select("target_group", "degenerate", "low_ess", "external_exceeds_target", F.array_join("dominant_groups", ",").alias("dominant"))


ALLOC = """n AS (SELECT CAST(label AS VARCHAR) AS grp, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT sum(n) AS c, count(*) AS g FROM n),
q AS (SELECT grp, n, least(greatest(0, 97 - g), c - g) AS spare, CAST(least(greatest(0, 97 - g), c - g) AS DOUBLE) * (n - 1) / (c - g) AS q FROM n CROSS JOIN t),
k AS (SELECT *, row_number() OVER (ORDER BY q - floor(q) DESC, grp) AS pos, spare - sum(floor(q)) OVER () AS rest FROM q),
alloc AS (SELECT grp, CAST(n AS BIGINT) AS n, CAST(1 + floor(q) + CASE WHEN pos <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM k)"""


@query("sample_allocation", f"WITH {ALLOC} SELECT * FROM alloc")
def _(s, d):
    return sampling.allocation(weighting.group_sizes(cells(s, d)), 97)


@query("stratified_sample", f"""WITH {ALLOC}, ranked AS (SELECT vec_id AS cell, CAST(label AS VARCHAR) AS grp, substring(sha256(CAST(vec_id AS VARCHAR)), 1, 16) AS hash,
  row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id) AS pos FROM embeddings) SELECT cell, ranked.grp AS grp, hash FROM ranked JOIN alloc USING (grp) WHERE pos <= allocated""")
def _(s, d):
    c = cells(s, d).select("cell", "grp")
    return sampling.stratified(c, sampling.allocation(weighting.group_sizes(c), 97)).select("cell", "grp", "hash")


# ---- models


@query("constant_predictors", f"""WITH {E}{G}, {XT}, y AS (SELECT grp AS target_group, gene, CASE WHEN gene = 'd5' AND grp = '1' THEN 7 ELSE x END AS x FROM g WHERE gene IN (SELECT gene FROM xt))
  SELECT target_group, gene FROM y GROUP BY ALL HAVING min(CAST(x AS FLOAT)) = max(CAST(x AS FLOAT))""")
def _(s, d):
    return screening.constant_predictors(_spread(s, d), embedding_tfs(s))


def _spread(s, d):
    x = expression(s, d).withColumn("x", F.when((F.col("gene") == "d5") & (F.col("grp") == "1"), 7.0).otherwise(F.col("x")))
    return screening.ranges(x.select("gene", "cell", "x"), cells(s, d).select(F.col("grp").alias("target_group"), "cell"))


@query("model_preflight_status", f"""WITH {E}{G}, {XT}, y AS (SELECT grp AS target_group, gene, CASE WHEN gene = 'd5' AND grp = '1' THEN 7 ELSE x END AS x FROM g),
  sp AS (SELECT target_group, gene, min(x) AS lo, max(x) AS hi, min(CAST(x AS FLOAT)) = max(CAST(x AS FLOAT)) AS k, count(*) AS n FROM y GROUP BY ALL),
  nk AS (SELECT target_group, count(*) FILTER (WHERE k AND gene IN (SELECT gene FROM xt)) AS nk FROM sp GROUP BY ALL),
  m AS (SELECT target_group, gene AS target, n, lo, hi, 6 - nk - CASE WHEN gene IN (SELECT gene FROM xt) AND NOT k THEN 1 ELSE 0 END AS p FROM sp JOIN nk USING (target_group))
  SELECT target_group, target, CAST(n AS BIGINT) AS n_positive, CAST(p AS BIGINT) AS n_predictors, CASE WHEN n < 2 THEN 'insufficient_positive_weight_samples' WHEN lo = hi THEN 'constant_target' WHEN p = 0 THEN 'no_variable_predictors' ELSE 'fit' END AS status FROM m""")
def _(s, d):
    spread = _spread(s, d)
    sizes = spread.groupBy("target_group").agg(F.max("n").alias("n_positive"))
    targets = spread.select("target_group", F.col("gene").alias("target"))
    return screening.preflight(spread, targets, embedding_tfs(s), screening.constant_predictors(spread, embedding_tfs(s)), sizes)


@query("pca_embedding")
def _(s, d):
    found = representation.principal_components(cells(s, d), 3)
    return found.cells.select("cell", "grp", *[F.get("v", F.lit(i)).alias(f"pc{i + 1}") for i in range(3)])


@query("pca_cell_norms", f"""WITH {E}, m AS (SELECT dim, avg(z) AS m FROM x GROUP BY dim)
  SELECT cell, round(sum((z - m) * (z - m)), 6) AS squared_norm FROM x JOIN m USING (dim) GROUP BY cell""")
def _(s, d):
    """With all components, a cell is as far from the mean as it was."""
    found = representation.principal_components(cells(s, d), 64)
    return found.cells.select("cell", F.round(F.aggregate("v", F.lit(0.0), lambda t, z: t + z * z), DIGITS).alias("squared_norm"))


@query("pca_range_norms", f"""WITH {E}, m AS (SELECT dim, avg(z) AS m FROM x GROUP BY dim)
  SELECT round(sum((z - m) * (z - m)), 4) AS total_variance, true AS ordered, true AS within_bound FROM x JOIN m USING (dim)""")
def _(s, d):
    """The range finder's components hold the whole variance, in falling order, within the stated bound of the exact ones."""
    exact, found = (representation.principal_components(cells(s, d), 64, seed=5, solver=k) for k in ("full", "randomized"))
    near = max(abs(a - b) for a, b in zip(exact.ratios, found.ratios, strict=True)) <= found.error_bound + 1e-9
    total = found.cells.agg(F.sum(F.aggregate("v", F.lit(0.0), lambda t, z: t + z * z)).alias("t"))
    falling = all(a >= b for a, b in zip(found.ratios, found.ratios[1:], strict=False))
    return total.select(F.round("t", 4).alias("total_variance"), F.lit(falling).alias("ordered"), F.lit(near).alias("within_bound"))


def _results(s, d, method="extra-trees", counts=None):
    """Every dimension is a target, in every group, with the run's own number of trees."""
    c = cells(s, d)
    order = numbered(c.select("cell"), ["cell"], into="cell_ord")
    vectors = written(forest.gene_vectors(expression(s, d).join(order, "cell")), "genes")
    w = stored_weights(s, d).join(order, "cell")
    groups = c.select(F.col("grp").alias("target_group")).distinct()
    tasks = vectors.select(F.col("gene").alias("target")).crossJoin(groups)
    return fit(vectors, forest.share(vectors, EMBEDDING_TFS, w, c.count()), tasks, ForestParams(method), 123, counts)


@query("network_extra_trees")
def _(s, d):
    return forest.edges(_results(s, d))


@query("network_random_forest")
def _(s, d):
    return forest.edges(_results(s, d, "random-forest"), "random-forest")


@query("forest_prefixes")
def _(s, d):
    return _results(s, d, counts=(2, 5, 10, ForestParams().n_estimators)).select("target_group", "target", "n_estimators", "status", "n_edges", "importance_sum")


@query("model_diagnostics")
def _(s, d):
    return forest.model_diagnostics(_results(s, d)).drop("fit_seconds")


@query("model_counts", W + f""", {XT}, k AS (SELECT target_group, count(*) AS n, count(*) FILTER (WHERE w > 0) AS p, sum(w) AS s FROM w GROUP BY target_group)
  SELECT target_group, 'd' || dim AS target, CAST(n AS BIGINT) AS n_samples, CAST(p AS BIGINT) AS n_positive_weight_samples, round(s, 6) AS weight_sum, CAST(6 AS BIGINT) AS n_predictors_input,
  CAST(6 - CASE WHEN 'd' || dim IN (SELECT gene FROM xt) THEN 1 ELSE 0 END AS BIGINT) AS n_predictors_used, true AS has_sources, true AS sums_to_one FROM k, range(1, 65) t(dim)""")
def _(s, d):
    """What SQL knows of every model, and that its edges come from other listed factors, once each, with scores that sum to one."""
    m = _results(s, d)
    others = F.array_except(F.lit(EMBEDDING_TFS), F.array("target"))
    sources = F.transform("edges", lambda e: e["source"])
    listed = (F.size(F.array_except(sources, others)) == 0) & (F.size(F.array_distinct(sources)) == F.size("edges")) & (F.size("edges") > 0)
    total = F.aggregate("edges", F.lit(0.0), lambda t, e: t + e["score"])
    return m.select("target_group", "target", "n_samples", "n_positive_weight_samples", r("weight_sum"), "n_predictors_input", "n_predictors_used", listed.alias("has_sources"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query("run_counts", "SELECT CAST(count(*) * 64 AS BIGINT) AS models, CAST(count(*) * 64 AS BIGINT) AS trained, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed FROM (SELECT DISTINCT label FROM embeddings)")
def _(s, d):
    return forest.statistics(_results(s, d)).select("models", "trained", "skipped", "failed")


@query("skipped_targets", "SELECT DISTINCT CAST(label AS VARCHAR) AS target_group, 'd2' AS target, 'constant_target' AS reason, 'the target does not vary among cells of positive weight' AS detail FROM embeddings")
def _(s, d):
    c = cells(s, d).withColumn("v", F.transform("v", lambda x, i: F.when(i == 1, F.lit(2.0)).otherwise(x)))
    order = numbered(c.select("cell"), ["cell"], into="cell_ord")
    rows = distance.exploded(c).select(F.concat(F.lit("d"), "dim").alias("gene"), "cell", F.col("z").alias("x")).join(order, "cell")
    vectors = written(forest.gene_vectors(rows), "genes")
    groups = c.select(F.col("grp").alias("target_group")).distinct()
    even = order.crossJoin(F.broadcast(groups)).withColumn("final_weight", F.lit(1.0))
    tasks = vectors.select(F.col("gene").alias("target")).crossJoin(groups)
    return forest.skipped(fit(vectors, forest.share(vectors, EMBEDDING_TFS, even, c.count()), tasks, ForestParams(), 123))


@query("run_statistics")
def _(s, d):
    return forest.statistics(_results(s, d)).drop("fit_seconds")


STEPS = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(11)]


@query("bootstrap_interval", f"""WITH u AS (SELECT s_nationkey % 5 AS grp, CAST(s_acctbal AS DOUBLE) AS x, rep, CAST(CAST('0x' || substr(sha256('7:' || s_suppkey || ':' || rep), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0e0 AS u FROM supplier, range(0, 200) t(rep)),
  w AS (SELECT grp, x, rep, {' + '.join(f'CASE WHEN u >= {c!r}e0 THEN 1 ELSE 0 END' for c in STEPS)} AS times FROM u),
  m AS (SELECT grp, rep, quantile_cont(x, 0.5) AS q FROM w, range(0, times) t(i) GROUP BY grp, rep),
  i AS (SELECT grp, quantile_cont(q, 0.025) AS low, quantile_cont(q, 0.975) AS high FROM m GROUP BY grp)
  SELECT CAST(grp AS BIGINT) AS grp, round(e.estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high FROM i JOIN (SELECT s_nationkey % 5 AS grp, quantile_cont(CAST(s_acctbal AS DOUBLE), 0.5) AS estimate FROM supplier GROUP BY ALL) e USING (grp)""")
def _(s, d):
    rows = table(s, d, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("grp"), F.col("s_suppkey").alias("row"), F.col("s_acctbal").cast("double").alias("x"))
    found = resampling.bootstrap(rows, ["grp"], "row", "x", replicates=200, seed=7)
    return found.select("grp", r("estimate"), r("low"), r("high"))


@query("nested_targets", """WITH k AS (SELECT p_name AS target, row_number() OVER (ORDER BY sha256('3:' || p_name), p_name) AS nth FROM (SELECT DISTINCT p_name FROM part))
  SELECT size, target FROM k, (VALUES (16), (64), (256)) t(size) WHERE nth <= size""")
def _(s, d):
    return resampling.nested(table(s, d, "part").select(F.col("p_name").alias("target")), "target", [16, 64, 256], seed=3)


FLAGSHIP_SQL = W + """ SELECT target_group, CAST(count(*) AS BIGINT) AS n_cells, round(sum(w), 6) AS total_weight, round(sum(w) FILTER (WHERE grp = target_group), 6) AS target_weight,
  round(sum(w) * sum(w) / sum(w * w), 6) AS effective_sample_size FROM w GROUP BY target_group"""


@query("flagship", FLAGSHIP_SQL)
def flagship(s: SparkSession, d: str) -> DataFrame:
    """Centroids, distances, bandwidth, anchored weights and their audit, end to end."""
    rows = diagnostics.weight_summary(anchored(s, d), quantiles=False)
    return rows.select("target_group", "n_cells", r("total_weight"), r("target_weight"), r("effective_sample_size"))


def _files() -> None:
    """The queries over files are in a module of their own, which takes its parts from here."""
    from popnet.plans import io_queries  # noqa: F401


def queries() -> dict[str, Query]:
    """All queries by name."""
    _files()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their SQL, where there is one."""
    _files()
    return dict(SQL)
