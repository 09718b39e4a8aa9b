"""Queries that must cover every target, every unit and any size."""

from popnet.plans import queries as plans

DIR = "/root/testdata/sf0.001"


def test_every_dimension_is_a_target(spark):
    groups, dimensions = 10, 64
    rows = plans.queries()["forest_prefixes"](spark, DIR).collect()
    assert {r["target"] for r in rows} == {f"d{i}" for i in range(1, dimensions + 1)}
    assert sorted({r["n_estimators"] for r in rows}) == [2, 5, 10, 50] and len(rows) == 4 * groups * dimensions


def test_wide_rows_of_every_unit(spark):
    rows = plans.queries()["wide_rows_by_unit"](spark, DIR).collect()
    sizes = {}
    for r in plans.unit_entries(spark, DIR).select("analysis_unit", "gene", "cell").collect():
        sizes.setdefault(r["analysis_unit"], set()).add(r["cell"])
    filled = {(r["analysis_unit"], r["gene"]): r["count"] for r in plans.unit_entries(spark, DIR).groupBy("analysis_unit", "gene").count().collect()}
    assert len(sizes) == 5 and {(r["analysis_unit"], r["gene"]): r["filled"] for r in rows} == filled and len(rows) == len(filled)
    assert all(r["fields"] == len(sizes[r["analysis_unit"]]) for r in rows)
