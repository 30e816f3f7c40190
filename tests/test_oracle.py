"""All checked queries against DuckDB at the smallest scale."""

from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
import check
from mailsift import checks

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_matches_oracle(spark, duck, name):
    text, good = check.compare(spark, duck, name, SF)
    assert good, text


def test_every_query_has_an_oracle():
    assert set(checks.QUERIES) == set(checks.ORACLES)
    assert set(checks.QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
