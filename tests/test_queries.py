"""Every registered query against its SQL statement."""

import sys

import pytest

from conftest import ROOT

sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_sql import connect, rows_of  # noqa: E402


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_matches_sql(spark, data, duck, name):
    names, got = rows_of(contract.queries()[name](spark, data).toArrow())
    want_names, want = rows_of(duck.sql(contract.oracle_sql()[name]).to_arrow_table())
    assert names == want_names
    assert got == want


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in contract.oracle_sql()])
def test_returns_rows(spark, data, name):
    assert contract.queries()[name](spark, data).count() > 0
