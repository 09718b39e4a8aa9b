"""Comparison of tables, synthetic data and file digests."""

import hashlib

from popnet.operators.compare import differences
from popnet.sources import synthetic, text


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, float("nan"), "z"), (4, 1.0, "w")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-13, "x"), (2, 2.1, None), (3, float("nan"), "y"), (5, 1.0, "w")], "k int, v double, s string")
    got = {(r["k"], r["column"]) for r in differences(a, b, ["k"]).collect()}
    assert got == {(2, "v"), (3, "s"), (4, "<row>"), (5, "<row>")} and differences(a, a, ["k"]).isEmpty()


def test_synthetic_expression(spark):
    x = synthetic.expression(spark, 60, 12, 4, 3)
    rows = x.collect()
    assert len(rows) == 720 and min(r["x"] for r in rows) >= 0 and len({r["grp"] for r in rows}) == 3
    assert sorted(rows) == sorted(synthetic.expression(spark, 60, 12, 4, 3).repartition(3).collect()) != sorted(synthetic.expression(spark, 60, 12, 4, 3, 2).collect())


def test_fingerprint(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc\r\n" * 1000)
    assert text.fingerprint(spark, str(tmp_path / "f")) == {"path": str(tmp_path / "f"), "bytes": 5000, "sha256": hashlib.sha256(b"abc\r\n" * 1000).hexdigest()}
