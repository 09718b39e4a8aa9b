"""The driver's contract, without the llm subpackage's queries."""

import __spark_entry__ as entry
from popnet.plans import queries as plans


def test_names():
    assert set(plans.oracle_sql()) <= set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 < r["target_weight"] <= r["total_weight"] for r in rows)
