"""Results by target group: order, how far ahead, errors and cancellation."""

import time

import pytest
from pyspark.sql import functions as F

from popnet.storage import shared_dir
from popnet.streaming.groups import GroupResults


def stored(spark):
    import os

    return [p for p in os.listdir(shared_dir(spark).removeprefix("file://")) if p.startswith("popnet-group-results")]


def test_order_and_bound(spark):
    begun = []

    def fit(g):
        begun.append(g)
        return spark.createDataFrame([(g, len(begun))], "g string, n int")

    names, before = list("fbdace"), len(stored(spark))
    with GroupResults(spark, names, fit, ahead=2) as results:
        seen = []
        for at, (g, rows) in enumerate(results):
            time.sleep(0.5)
            assert len(begun) <= at + 1 + 2 and rows.first()["g"] == g  # this one and two ahead
            assert len(stored(spark)) - before <= 3
            seen.append(g)
    assert seen == names == begun and len(stored(spark)) == before


def test_an_error_comes_in_its_place(spark):
    def fit(g):
        if g == "b":
            raise RuntimeError("no fit")
        return spark.createDataFrame([(g,)], "g string")

    seen = []
    with pytest.raises(RuntimeError, match="no fit"), GroupResults(spark, "abc", fit) as results:
        for g, _ in results:
            seen.append(g)
    assert seen == ["a"]


def test_closing_cancels_the_running_job(spark):
    @F.udf("int")
    def slow(x):
        time.sleep(30 if x else 0)
        return 1

    before = len(stored(spark))
    with GroupResults(spark, "ab", lambda g: spark.range(1).select(slow(F.lit(g == "b")).alias("x"))) as results:
        assert next(iter(results))[0] == "a"
        time.sleep(1)
        began = time.monotonic()
    assert time.monotonic() - began < 15 and not results._thread.is_alive() and len(stored(spark)) - before <= 1
    with pytest.raises(ValueError, match="ahead"):
        GroupResults(spark, "a", lambda g: None, 0)
