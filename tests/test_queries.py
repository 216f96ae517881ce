"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import log_queries, service_queries, stream_queries, table_queries
from checks.compare import difference

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    wrong, rows = difference(spark, SF_DIR, QUERIES[name], SQL.get(name))
    assert wrong is None
    assert rows > 0 or name == "report_top_outliers"


def test_every_query_has_sql():
    """All but those of optional packages, which say themselves what SQL can't express."""
    checked = {name for module in (log_queries, table_queries, service_queries, stream_queries) for name in module.QUERIES}
    assert checked <= set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_tasks"] > 0
