"""Genes collapsed in one pass over repeated coordinates."""

import duckdb

from popnet.operators import prepare
from popnet.plans import queries

DIR = "/root/testdata/sf0.001"


def test_one_pass_equals_coordinates_first(spark):
    """Repeated, cancelling, null and zero coordinates; names that several features have."""
    rows = [(0, 1, 2.0), (0, 1, 3.0), (1, 1, 4.0), (2, 1, None), (2, 2, 0.0), (2, 3, 5.0), (2, 3, -5.0), (0, 3, 1.0), (2, 4, None), (2, 4, 7.0), (9, 1, 1.0)]
    counts = spark.createDataFrame(rows, "feature_idx long, barcode_idx long, x double")
    features = spark.createDataFrame([(i, n, prepare.GENE_EXPRESSION) for i, n in enumerate("aab")], "feature_idx long, name string, feature_type string")
    found = [sorted(map(tuple, prepare.collapse_genes(c, features)[1].collect())) for c in (counts, prepare.canonical(counts))]
    assert found[0] == found[1] == [("a", 1, 9.0), ("a", 3, 1.0), ("b", 4, 7.0)]


def test_query_shuffles_entries_once_and_equals_its_sql(spark):
    df = queries.QUERIES["gene_collapse_sum"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate(keys=[gene" in plan and "Aggregate(keys=[feature_idx" not in plan
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(queries.SQL["gene_collapse_sum"]).fetchall())
