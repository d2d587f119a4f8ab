"""Every registered query against its SQL counterpart on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    assert len(oracle_sql()) > 120


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 20
    assert {"behavior", "p_value", "p_holm"} <= set(df.columns)
