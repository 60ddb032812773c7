"""Every registered inventory query against its SQL counterpart."""

from __future__ import annotations

import pytest
from compare import assert_same, duck
from tallyframe.plans.oracle import ORACLES
from tallyframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    assert_same(QUERIES[name](spark, SF), sql.sql(ORACLES[name]))


def test_all_but_the_folds_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"folder_classify", "import_guards"}


def test_measured_statuses(spark):
    rows = {r["status"]: r["sku_count"] for r in QUERIES["status_rollup"](spark, SF).collect()}
    assert rows == {"out_of_stock": 13, "low_stock": 15, "dead_stock": 126, "overstock": 17, "healthy": 20, "returned": 2}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
