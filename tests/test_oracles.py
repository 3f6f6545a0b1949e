"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from eventloom.plans.catalogue import REGISTERED
from tools.check import compare


def test_entry_runs(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["project_id", "event", "bucket", "count", "unique_users"]
    assert frame.limit(1).count() == 1


def test_every_twin_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_agrees_with_sql(spark, folder, name):
    assert compare(spark, folder, name) == ""
