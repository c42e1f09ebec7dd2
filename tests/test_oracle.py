"""Every registered query equals its DuckDB oracle (order-insensitive)."""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL
from workboard.registry import QUERIES

sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="module")
def results(spark):
    from check_oracle import compare
    return compare(spark, SF_SMALL, list(QUERIES), verbose=False)


def test_all_queries_match_oracle(results):
    bad = {n: r for n, r in results.items() if r[0] != "OK"}
    assert not bad, bad
