"""Cells of a unit that have no counts: customers whose orders have no lines."""

import json

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from popnet.config import PrepareConfig
from popnet.operators.checks import InputError
from popnet.plans import queries
from popnet.plans.prepare import prepare
from popnet.sources import counts

TABLES = ("customer", "orders", "part", "lineitem", "nation", "region")


def test_query_equals_its_sql(spark, tmp_path):
    """ASIA: five customers order, four have lines; EUROPE: four order, all have lines; a customer without a nation has lines too."""
    customers = {"c_custkey": list(range(1, 11)), "c_nationkey": [1] * 5 + [2] * 4 + [9], "c_mktsegment": ["A", "B"] * 5}
    orders = {"o_orderkey": list(range(101, 111)), "o_custkey": list(range(1, 11))}  # order 105, the only one of customer 5, has no lines
    placed = [o for o in orders["o_orderkey"] if o != 105]
    lines = {"l_orderkey": placed * 2, "l_partkey": [1] * len(placed) + [2, 1, 2] * (len(placed) // 3), "l_quantity": [float(i + 1) for i in range(2 * len(placed))]}
    made = [customers, orders, {"p_partkey": [1, 2], "p_brand": ["Brand#11", "Brand#23"]}, lines, {"n_nationkey": [1, 2], "n_regionkey": [1, 2]}, {"r_regionkey": [1, 2], "r_name": ["ASIA", "EUROPE"]}]
    con = duckdb.connect()
    for name, columns in zip(TABLES, made, strict=True):
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["prepared_units"]).fetchall())
    assert {r[0] for r in want} == {"ASIA"} and {r[2] for r in want} == {"1", "2", "3", "4"}
    assert sorted(map(tuple, queries.queries()["prepared_units"](spark, str(tmp_path)).collect())) == want


@pytest.fixture
def mex(tmp_path):
    """c4 is no barcode, c3 one without counts of genes."""
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 3 4\n1 1 5\n1 2 1\n2 2 4\n2 3 9\n")
    (tmp_path / "features.tsv").write_text("i\tA\tGene Expression\nj\tB\tAntibody Capture\n")
    (tmp_path / "barcodes.tsv").write_text("c1\nc2\nc3\n")
    (tmp_path / "tf.txt").write_text("A\n")
    return tmp_path


@pytest.mark.parametrize(("cells", "message"), [(("c1", "c4"), "not in the matrix: 'c4'"), (("c1", "c3"), "without counts: 'c3'"), (("c1", "c2", "c3", "c4"), None)])
def test_policies(spark, mex, cells, message):
    (mex / "a.tsv").write_text("cell\tanalysis_unit\tcluster\n" + "".join(f"{c}\tU\tk\n" for c in cells))
    config = {"counts": str(mex), "annotations": str(mex / "a.tsv"), "tf_list": str(mex / "tf.txt"), "output_dir": str(mex / "out"), "min_cells": 4 if message is None else 1}
    if message:
        with pytest.raises(InputError, match=message):
            prepare(spark, PrepareConfig(**config))
        return
    done = prepare(spark, PrepareConfig(**config, uncounted_cells="exclude"))
    assert (done.input_cells, done.annotated_cells, done.excluded_unannotated_cells) == (3, 3, 0)
    unit = mex / "out" / "unit-001-u"
    assert (unit / "expression.tsv").read_text().splitlines()[0] == "gene\tc1\tc2" and (unit / "groups.tsv").read_text() == "cell\tcluster\nc1\tk\nc2\tk\n"
    assert json.loads((mex / "out" / "prepare_manifest.json").read_text())["matrix"]["excluded_uncounted_cells"] == 2


def test_parsed_triplets_are_many_tasks(spark, tmp_path):
    n = 200
    (tmp_path / "matrix.mtx").write_text(f"%%MatrixMarket matrix coordinate integer general\n1 {n} {n}\n" + "".join(f"1 {j} {j}\n" for j in range(1, n + 1)))
    (tmp_path / "features.tsv").write_text("i\tA\tGene Expression\n")
    (tmp_path / "barcodes.tsv").write_text("".join(f"c{j}\n" for j in range(1, n + 1)))
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would else go together
    spark.conf.set(key, "false")
    try:
        m = counts.from_mex(spark, str(tmp_path))
    finally:
        spark.conf.unset(key)
    assert len(m.counts.inputFiles()) > 1 and sorted(map(tuple, m.counts.collect())) == [(0, j, j + 1.0) for j in range(n)]
